"""Word normalisation shared by the operators on running text."""

from __future__ import annotations

import re
import unicodedata

#: Characters of scripts written without spaces are words of their own.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"[^\W{_UNSPACED}]+|[{_UNSPACED}]")
_LATIN_MARKS = re.compile("[\u0300-\u036f]+")
#: Where other combining marks stand.
_OTHER_MARKS = re.compile("[\u0483-\u1fff\u20d0-\u20ff\u302a-\u302f\u3099\u309a\ua66f-\uabff\ufb1e\ufe20-\ufe2f\U00010000-\U0010ffff]")
_PLAIN = re.compile(r"^[\x00-\x7f]*$")


def plain(text: str) -> str:
    """Case-folded text without accents."""
    text = text.casefold()
    if _PLAIN.match(text):
        return text
    text = _LATIN_MARKS.sub("", unicodedata.normalize("NFKD", text))
    return "".join(c for c in text if not unicodedata.combining(c)) if _OTHER_MARKS.search(text) else text


def words(text: str | None) -> list[str]:
    """Words without case, accents and punctuation; none of a null or empty text."""
    return _WORD.findall(plain(text)) if text else []
