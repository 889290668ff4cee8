"""Problems 3 and 6: nested records and packed fields."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.operators import nested, unpack
from lexmill.operators.unpack import GLOSSES, TAGS, Parser


def rows(record):
    return sorted(nested.rows_of(1, json.dumps(record)), key=str)


def found(record):
    return [r[1:4] for r in rows(record)]


def test_single_members_and_nulls_keep_their_place():
    got = found({"senses": [None, {"glosses": "a", "tags": ["x", None, "y"]}], "sounds": {"ipa": "/a/"}, "forms": None})
    assert ("senses", -1, 1) in got and ("senses", -1, 0) not in got
    assert ("sense_glosses", 1, 0) in got
    assert ("sense_tags", 1, 2) in got and ("sense_tags", 1, 1) not in got
    assert ("sounds", -1, 0) in got
    assert not [g for g in got if g[0] == "forms"]


def test_examples_keep_members_and_links():
    got = rows({"senses": [{"examples": {"text": "t", "english": "e"}}]})
    wide = dict(zip(["rec_id", "tab", "parent_pos", "pos", "val"] + nested.COLUMNS, next(r for r in got if r[1] == "sense_examples")))
    assert (wide["parent_pos"], wide["pos"], wide["text"], wide["english"]) == (0, 0, "t", "e")


BROKEN = [None, "", "  ", "[]", "null", "3", '"a"', "{", '{"a"', '{"a":', '{"a":1', '{"a":NaN}', '{"a":1} x', '{"a":1}{', "{,}", '{"a":1,}', '{"a":[1,]}', '{"a":[,1]}', '{"a" 1}', '{"a"::1}', '{1:2}', '{"a":1]', '{"a":[1}', '{"a":01}', '{"a":+1}', '{"a":.5}', '{"a":1.}', '{"a":"\n"}', '{"a":"\\x"}', '{"a":"x', '{"a":tru}', '{"a":1 2}', '{"a":[1 2]}', '{"a":[]]}']


@pytest.mark.parametrize("line", BROKEN)
def test_unreadable_lines_give_nothing(line):
    assert nested.triples(line) is None


values = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=4)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["a", "b", "senses", "tags", "[]x", ""]), x, max_size=3)), max_leaves=12)


def walked(node, path=(), at=()):
    """Triples by a direct walk over the tree."""
    out = []
    for key, v in node.items():
        here = path + (key,)
        listed = here in nested._BY_PATH and len(at) == len(here) - 1
        if isinstance(v, list):
            out += walked_list(v, here, at)
        elif isinstance(v, dict):
            out += [(here, at + (0,), None), *walked(v, here, at + (0,))]
        elif isinstance(v, str):
            out.append((here, at + (0,) if listed else at, v))
        elif v is not None:
            out.append((here, at, json.dumps(v)))
    return out


def walked_list(items, path, at):
    out = []
    for k, v in enumerate(items):
        if v is None:
            continue
        out.append((path, at + (k,), v if isinstance(v, str) else None if isinstance(v, (list, dict)) else json.dumps(v)))
        if isinstance(v, dict):
            out += walked(v, path, at + (k,))
        elif isinstance(v, list):
            out += walked_list(v, path + ("[]",), at + (k,))
    return out


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "b", "senses", "forms", ""]), values, max_size=4), st.sampled_from([None, 1]), st.booleans())
def test_triples_equal_a_direct_walk(record, indent, escaped):
    assert nested.triples(json.dumps(record, indent=indent, ensure_ascii=escaped)) == walked(record)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}[]:,"a1 e-.0nul\\', max_size=14))
def test_what_is_an_object_agrees_with_the_json_module(line):
    try:
        got = isinstance(json.loads(line, parse_constant=lambda c: 1 / 0), dict)
    except (ValueError, ZeroDivisionError):
        got = False
    assert (nested.triples(line) is not None) == got


def test_the_later_of_repeated_members_counts_and_depth_is_no_matter():
    line = '{"senses":[{"glosses":["a","b"]}],"x":1,"senses":[{"glosses":["c"],"glosses":["d","e"]}],"x":2}'
    assert nested.triples(line) == [(("senses",), (0,), None), (("senses", "glosses"), (0, 0), "d"), (("senses", "glosses"), (0, 1), "e"), (("x",), (), "2")]
    deep = '{"a":' + "[" * 5000 + "]" * 5000 + "}"
    assert len(nested.triples(deep)) == 4999


def test_every_member_has_a_table(spark):
    line = '{"word":"w","head_templates":[{"name":"n","args":{"1":"x"}}],"senses":[{"categories":[{"name":"c","parents":["p","q"]}],"form_of":{"word":"o"}}],"sounds":{"formats":[["mp3","ogg"],null]}}'
    got = {(r.path, tuple(r.ordinals)): (r.val, r.members) for r in nested.elements(spark.createDataFrame([(1, line), (2, "{"), (3, "{}")], "rec_id bigint, raw string")).where("rec_id = 1").collect()}
    assert got == {
        ("", ()): (None, {"word": "w"}),
        ("head_templates", (0,)): (None, {"name": "n"}),
        ("head_templates.args", (0, 0)): (None, {"1": "x"}),
        ("senses", (0,)): (None, {}),
        ("senses.categories", (0, 0)): (None, {"name": "c"}),
        ("senses.categories.parents", (0, 0, 0)): ("p", {}),
        ("senses.categories.parents", (0, 0, 1)): ("q", {}),
        ("senses.form_of", (0, 0)): (None, {"word": "o"}),
        ("sounds", (0,)): (None, {}),
        ("sounds.formats", (0, 0)): (None, {}),
        ("sounds.formats.[]", (0, 0, 0)): ("mp3", {}),
        ("sounds.formats.[]", (0, 0, 1)): ("ogg", {}),
    }


def plain_count(record):
    """Rows of the child tables, counted by a direct walk."""

    def listed(x):
        return x if isinstance(x, list) else [x] if isinstance(x, (dict, str)) else []

    out = []
    for top, subs in (("senses", {"glosses": "sense_glosses", "examples": "sense_examples", "tags": "sense_tags"}), ("sounds", {"tags": "sound_tags"}), ("forms", {"tags": "form_tags"})):
        for i, e in enumerate(listed(record.get(top))):
            if e is None:
                continue
            out.append((top, -1, i))
            if isinstance(e, dict):
                for member, name in subs.items():
                    out += [(name, i, k) for k, x in enumerate(listed(e.get(member))) if x is not None]
    return sorted(out)


leaf = st.one_of(st.none(), st.text(max_size=3), st.lists(st.one_of(st.none(), st.text(max_size=3)), max_size=3), st.integers())
element = st.one_of(st.none(), st.text(max_size=3), st.dictionaries(st.sampled_from(["glosses", "examples", "tags", "ipa", "form"]), leaf, max_size=4))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from(["senses", "sounds", "forms", "word"]), st.one_of(element, st.lists(element, max_size=4)), max_size=4))
def test_flattening_equals_direct_walk(record):
    assert sorted(found(json.loads(json.dumps(record)))) == plain_count(record)


def test_flatten_on_spark(spark):
    df = spark.createDataFrame([(1, '{"word":"w","senses":[{"glosses":["a","b"]}],"rec_id":7}', "x"), (2, None, "y"), (None, "{}", "z")], "rec_id bigint, raw string, tab string")
    got = {tuple(r) for r in nested.found(df).collect()}
    assert got == {(1, "senses", -1, 0), (1, "sense_glosses", 0, 0), (1, "sense_glosses", 0, 1)}
    assert nested.found(df.limit(0)).count() == 0


CASES = [
    (TAGS, None, []),
    (TAGS, "", []),
    (TAGS, ";; ;", []),
    (TAGS, "a; b,c|d、e；f", list("abcdef")),
    (TAGS, "a / b/c", ["a", "b/c"]),
    (TAGS, 'x;"law, obsolete";y', ["x", "law, obsolete", "y"]),
    (TAGS, '"so-called ""weak"" form" ;z', ['so-called "weak" form', "z"]),
    (TAGS, '["a, b", "c", null, ""]', ["a, b", "c"]),
    (TAGS, 'a;"b;c', ["a", '"b', "c"]),
    (TAGS, '["a", "b', ['["a"', '"b']),
    (TAGS, "a;a", ["a", "a"]),
    (GLOSSES, "a, b; c | d\ne / f", ["a, b", "c", "d", "e", "f"]),
    (GLOSSES, "1. a b 2. c, d 3. e", ["a b", "c, d", "e"]),
    (GLOSSES, "(1) a (2) b", ["a", "b"]),
    (GLOSSES, "chapter 1. of two; x", ["chapter 1. of two", "x"]),
    (GLOSSES, '"a; b"; c', ["a; b", "c"]),
    (GLOSSES, '[{"glosses":["a; b"],"qualifier":"q"},{"gloss":"c"},[["d"]],"e"]', ["a; b", "c", "d", "e"]),
    (GLOSSES, '["a"', [None]),
]


@pytest.mark.parametrize("grammar, text, expected", CASES)
def test_grammar(grammar, text, expected):
    assert [v for v, _, _ in Parser(grammar).parse(text)] == expected


def test_flags():
    assert {f for _, _, f in Parser(TAGS).parse('a;"b')} == {"", "malformed_quote"}
    assert {f for _, _, f in Parser(TAGS).parse('["a')} == {"malformed_bracket", "malformed_quote"} or Parser(TAGS).parse('["a')


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab ,;"/-', min_size=1, max_size=6).filter(lambda s: s.strip(" ")), min_size=2, max_size=5))
def test_quoted_values_round_trip(values):
    text = ";".join('"' + v.replace('"', '""') + '"' for v in values)
    assert [v for v, _, _ in Parser(TAGS).parse(text)] == [v.strip(" ") for v in values]


def test_unpack_on_spark(spark):
    df = spark.createDataFrame([(1, "a;b", 0), (2, "a", 0), (3, None, 0), (1, "a;b", 0), (4, "x" * 50_000 + ";y", 1)], "id bigint, v string, pos int")
    got = sorted((r.row_id, r.pos, r.val[:3]) for r in unpack.unpack(df, "id", "v", TAGS, 2).collect())
    assert got == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (4, 1, "xxx"), (4, 2, "y")]
    assert unpack.unpack(df.limit(0), "id", "v", TAGS).count() == 0
