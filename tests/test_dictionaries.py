"""Published dictionary formats, Japanese inflection and surface parts on small cases."""

from lexmill.operators import alignment, inflection
from lexmill.sources import dictionaries, files


def written(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def one(df):
    return [tuple(r) for r in df.collect()]


def test_krdict(spark, tmp_path):
    path = written(tmp_path, "k.xml", """<LexicalResource><Lexicon><LexicalEntry att="id" val="7"><feat att="partOfSpeech" val="명사"/><feat att="homonym_number" val="0"/><Lemma><feat att="writtenForm" val="말"/></Lemma>
<WordForm><feat att="type" val="발음"/><feat att="pronunciation" val="mal"/></WordForm><WordForm><feat att="type" val="활용"/><feat att="writtenForm" val="말이"/></WordForm>
<Sense att="id" val="1"><feat att="definition" val="x"/><Equivalent><feat att="language" val="몽골어"/><feat att="lemma" val="no"/></Equivalent><Equivalent><feat att="language" val="영어"/><feat att="lemma" val="horse"/><feat att="definition" val="an animal"/></Equivalent></Sense></LexicalEntry>
<LexicalEntry att="id" val="8"><Lemma><feat att="writtenForm" val="빈"/></Lemma></LexicalEntry></Lexicon></LexicalResource>""")
    assert one(dictionaries.read_krdict(spark, path)) == [("7", "말", "mal", "명사", ["horse; an animal"], ["말이"])]


def test_jmdict(spark, tmp_path):
    path = written(tmp_path, "j.xml", "<JMdict><entry><ent_seq>1</ent_seq><k_ele><keb>山</keb></k_ele><k_ele><keb>嶽</keb></k_ele><r_ele><reb>やま</reb></r_ele><sense><pos>noun</pos><gloss>mountain</gloss><gloss>hill</gloss></sense><sense><gloss>pile</gloss></sense></entry><entry><ent_seq>2</ent_seq><r_ele><reb>あ</reb></r_ele><sense><gloss>ah</gloss></sense></entry><entry><ent_seq>3</ent_seq><r_ele><reb>い</reb></r_ele></entry></JMdict>")
    assert sorted(one(dictionaries.read_jmdict(spark, path))) == [("1", "山", "やま", "noun", ["mountain", "hill", "pile"], ["嶽", "やま"]), ("2", "あ", "", "", ["ah"], [])]


def test_lsj_and_treebank(spark, tmp_path):
    path = written(tmp_path, "l.xml", '<text><entryFree id="n1" key="lo/gos" type="main"><orth>lo/gos</orth><gen>m</gen><sense id="a"><tr>word</tr><tr>reason</tr></sense></entryFree><entryFree id="n2" key="x" type="xref"><orth>x</orth></entryFree></text>')
    assert [(r[1], r[3], r[4]) for r in one(dictionaries.read_lsj(spark, path))] == [("λόγος", "noun", ["word", "reason"])]
    path = written(tmp_path, "t.xml", '<treebank><sentence id="5"><word id="1" form="μῆνιν" lemma="μῆνις" postag="n-s---fa-" head="2" relation="OBJ_CO"/><word id="2" form="ἄειδε" lemma="ἀείδω" postag="v2spma---" head="0" relation="PRED"/></sentence></treebank>')
    assert [(r.sent_id, r.id, r.form, r.head, r.deprel) for r in dictionaries.read_treebank(spark, path).orderBy("id").collect()] == [("5", 1, "μῆνιν", 2, "OBJ"), ("5", 2, "ἄειδε", 0, "PRED")]


def test_line_formats(spark, tmp_path):
    path = written(tmp_path, "b.txt", "<HEADER>x</HEADER>\n\n<B>abacan,</B> <I>v. a.</I> to bake; to\nroast\n\n<PAGE 2>\n\n<B>ac;</B> <I>m.</I> An oak")
    assert sorted((r.headword, r.pos, r.glosses) for r in dictionaries.read_bold_entries(spark, path).collect()) == [("abacan", "verb", ["to bake", "to roast"]), ("ac", "noun", ["An oak"])]
    path = written(tmp_path, "m.txt", "<L>1<pc>1,1<k1>deva<k2>deva<h>1<e>1\n<s>deva</s> ¦ <lex>m.</lex> a god,\n<LEND>\n<L>1.1<pc>1,1<k1>deva<k2>deva<h>1<e>1A\na king\n<LEND>\n<L>2<pc>1,1<k1>x<k2>x<e>1\n{{Lbody=1}}\n<LEND>\n")
    assert [(r.headword, r.romanization, r.pos, r.glosses) for r in dictionaries.read_marked_records(spark, path).collect()] == [("deva", "deva", "m.", ["m. a god", "a king"])]
    path = written(tmp_path, "n.tsv", "traditional\tpinyin\tgrammar\tenglish\n之\tzhī\tParticle\tof\n之\tzhī\tparticle\tit\n之\tzhī\tparticle\tof\n\tx\ty\tz\n")
    assert [(r.headword, r.pos, r.glosses) for r in dictionaries.read_note_table(spark, path).collect()] == [("之", "particle", ["of", "it"])]


def test_vectors_inside_an_archive(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "v.zip", "w") as z:
        z.writestr("a.vec", "3 2\none 3 4\ntwo 0 2\nthree 1 0\n")
        z.writestr("readme.txt", "one 9 9\n")
    words = spark.createDataFrame([("one",), ("two",), ("four",), (None,)], "word string")
    assert {r.word: r.v for r in files.read_zipped_vec(spark, str(tmp_path / "v.zip"), words).collect()} == {"one": [0.6, 0.8], "two": [0.0, 1.0]}


def has(lemma, form, *tags, pos="verb"):
    return (form, tags) in inflection.forms(lemma, pos)


def test_japanese_forms(spark):
    assert has("書く", "書かない", "Negative") and has("書く", "書いて", "Te") and has("書く", "書ける", "Potential", "Dictionary") and has("書く", "書きました", "Polite", "Past")
    assert has("行く", "行った", "Past") and has("食べる", "食べられる", "Passive", "Dictionary") and has("食べる", "食べたくない", "Desiderative", "Negative") and has("食べる", "食べていました", "TeIru", "Polite", "Past")
    assert has("勉強する", "勉強すれば", "Conditional") and has("来る", "来ない", "Negative") and has("くる", "こない", "Negative") and has("くる", "きた", "Past")
    assert has("高い", "高かった", "Past", pos="i-adj") and has("静か", "静かだった", "Past", pos="na-adj")
    assert inflection.forms("山") == [] and inflection.forms("") == [] and all(f != "書く" for f, _ in inflection.forms("書く"))
    table = inflection.inflected(spark.createDataFrame([("書く", "verb"), ("書ける", None), (None, "verb")], "lemma string, pos string"))
    got = {(r.lemma, r.tags) for r in inflection.deconjugated(spark.createDataFrame([("書けない",), ("",), (None,)], "surface string"), table).collect()}
    assert got == {("書く", "Potential;Negative"), ("書ける", "Negative")}


def test_surface_parts():
    assert alignment.surface_parts("abcd", ["ab", "cd"]) == ("exact", [(0, 2, (0,)), (2, 4, (1,))])
    assert alignment.surface_parts("갔다", ["가", "았", "다"]) == ("units", [(0, 1, (0, 1)), (1, 2, (2,))])
    assert alignment.surface_parts("xyz!", ["ab", "c"])[0] == "proportional" and alignment.surface_parts("xyz!", ["ab", "c"])[1] == [(0, 3, (0,)), (3, 4, (1,))]
    assert alignment.surface_parts("", ["a"]) == ("none", []) and alignment.surface_parts("a", []) == ("none", [])
    assert alignment.surface_parts("x", ["aa", "bb", "cc"])[1] == [(0, 1, (0,))]


def test_sqlite_files(spark, tmp_path):
    import sqlite3

    (tmp_path / "db").mkdir()
    for name, rows in (("de", [(1, "Haus", 2.5), (2, None, None)]), ("fr-x", [(3, "café", 1.0)])):
        with sqlite3.connect(tmp_path / "db" / f"{name}.sqlite") as con:
            con.execute("create table entries (id integer, headword text, w real)")
            con.executemany("insert into entries values (?, ?, ?)", rows)
    with sqlite3.connect(tmp_path / "db" / "other.sqlite") as con:
        con.execute("create table meta (k text)")
    got = files.read_sqlite(spark, str(tmp_path / "db"), "entries", "id bigint, headword string, w double, pos string")
    assert {tuple(r) for r in got.collect()} == {(1, "Haus", 2.5, None, "de"), (2, None, None, None, "de"), (3, "café", 1.0, None, "fr-x")}
