"""The parser's trees, refusals and printing; analysis and matching on small literal tables."""

import pytest
from pyspark.sql import functions as F

from harrow.functions.analysis import analyze, concat_docs, from_text_form, from_tsvector, set_zone, strip_positions, text_form
from harrow.operators.approximate import matcher
from harrow.operators.match import matches
from harrow.plans.query import QueryError, from_tsquery, parse, show, without_stopwords


@pytest.mark.parametrize(("text", "want"), [
    ("quick brown fox", "(('quick' & 'brown') & 'fox')"),
    ("a | b & c", "('a' | ('b' & 'c'))"),
    ("!!!!a", "!!!!'a'"),
    ("Quick OR brown AND NOT fox", "('quick' | ('brown' & !'fox'))"),
    ("pkg-config", "'pkg-config'"),
    ("a -b", "('a' & !'b')"),
    ("fo* x~ y~1 z~0", "((('fo'* & 'x'~2) & 'y'~1) & 'z')"),
    ("t:ad", "'t':AD"),
    (r"'It\'s A'", r"'It\'s A'"),
    (r"'a\\b' And 'and'", r"('a\\b' & 'and')"),
    ("'tis and 'twas", "('tis' & 'twas')"),
    ("don't ''", "('don' & 't')"),
    ("Near(a b, 3) Or nOT c", "(('a' <=3> 'b') | !'c')"),
    ('"a b c"', "(('a' <=1> 'b') <=1> 'c')"),
    ("NEAR(a b c, 4)", "('a' <=4> ('b' <=4> 'c'))"),
    ("a <-> b <3> c", "(('a' <-> 'b') <3> 'c')"),
    ("a <=2> b", "('a' <=2> 'b')"),
    ("/ab+c/", "/ab+c/"),
    ("NEAR(near and)", "('near' <=10> 'and')"),
])
def test_trees(text, want):
    node = parse(text)
    assert show(node) == want
    assert parse(show(node)) == node


@pytest.mark.parametrize("text", ["quick &", "(quick", "a & & b", "a)", "NEAR(a)", "NEAR(a b, 0)", "NEAR(a b, c)", '"a', '"a /b/"', "| a", "a <=0> b", "t*:A", "!"])
def test_refused(text):
    with pytest.raises(QueryError):
        parse(text)


def test_empty_and_stopwords():
    assert parse("") is None and parse(" ; ") is None
    stop = {"the", "of"}
    assert show(without_stopwords(parse("the quick & !of"), stop)) == "'quick'"
    assert without_stopwords(parse("the | of"), stop) is None
    assert show(without_stopwords(parse('"quick the fox"'), stop)) == "('quick' <=2> 'fox')"


def test_tsquery():
    assert show(from_tsquery("'a' <-> 'b' & 'c':*")) == "(('a' <-> 'b') & 'c'*)"
    assert show(from_tsquery("'a':AB | !'b'")) == "('a':AB | !'b')"
    assert show(from_tsquery("'it''s' & 'c':*")) == r"('it\'s' & 'c'*)"
    for bad in ("'a' <-> 'b':*", "'a' <-> ('b' | 'c')", "'a':A*"):
        with pytest.raises(QueryError):
            from_tsquery(bad)


def test_analysis(spark):
    df = spark.createDataFrame([("The quick brown fox, the QUICK fox!",), ("a b c a b a",), ("",), (None,), ("Café İX ΣΣ 12",)], "t string").withColumn("d", analyze(F.col("t")))
    got = df.select(text_form(F.col("d")).alias("f"), F.col("d.length").alias("n")).collect()
    assert got[0].f == "'brown':1@3 'fox':2@4,7 'quick':2@2,6 'the':2@1,5" and got[1].n == 6
    assert (got[2].f, got[2].n) == ("", 0) and got[3].f is None and got[3].n is None
    assert "'café':1@1" in got[4].f and "'ix':1@2" in got[4].f and "'σσ':1@3" in got[4].f


def test_truth(spark):
    df = spark.createDataFrame([(1, "quick brown fox"), (2, "brown quick fox"), (3, "quick red brown"), (4, ""), (5, None)], "id int, t string").withColumn("d", analyze(F.col("t")))

    def found(q, doc="d"):
        return [r.id for r in df.where(matches(F.col(doc), parse(q))).orderBy("id").collect()]

    assert found('"quick brown"') == [1] and found("quick <2> brown") == [3] and found("quick <=2> brown") == [1, 3]
    assert found("!quick") == [4] and found("") == [] and found("qui*") == [1, 2, 3] and found("quick <0> quick") == [1, 2, 3]
    assert found('"quick bro*"') == [1, 2, 3] and found('"quick bro* fox"') == []
    assert found("quick <-> (brown | red)") == [] and found("brwn~1") == [1, 2, 3] and found("/^r.d$/") == [3]
    assert found("NEAR(quick fox, 2)") == [1, 2] and found("(quick <-> brown) <-> fox") == [1] and found("quick <-> (brown <-> fox)") == [1]
    df = df.withColumn("s", strip_positions(F.col("d"))).withColumn("z", concat_docs(set_zone(analyze(F.lit("red")), "A"), F.col("d")))
    assert found('"quick brown"', "s") == [] and found("quick", "s") == [1, 2, 3]
    assert found("red:A", "z") == [1, 2, 3, 4] and found("red:D", "z") == [3] and found('"red quick"', "z") == [1, 3]
    assert df.where("id = 5").select(matches(F.col("d"), parse("!a")).alias("m")).first().m is None


def test_approximate_regex():
    assert matcher("(hello){~1}")("xhelo") and not matcher("^(hello){~1}$")("hexxo")
    assert matcher("^(abc){~0}d$")("abcd") and not matcher("^(abc){~0}d$")("abxd") and matcher("a{~1}")("")
    for bad in ("{~1}a", "(a|b){~1}", "a{~1}b{~1}c{~1}d{~1}", "a{~x}"):
        with pytest.raises(ValueError):
            matcher(bad)


def test_tsvector_and_text_forms(spark):
    df = spark.createDataFrame([(1, "'fox':2A,6 'it''s' 'the':1"), (2, "'a' 'b'"), (3, "")], "id int, t string").withColumn("d", from_tsvector(F.col("t")))
    got = {r.id: r for r in df.select("id", text_form(F.col("d")).alias("f"), F.col("d.has_pos").alias("h")).collect()}
    assert got[1].f == "'fox':2@2A,6 'it''s':1@0 'the':1@1" and got[2].f == "'a':1 'b':1" and not got[2].h and got[3].f == ""
    found = lambda q: [r.id for r in df.where(matches(F.col("d"), parse(q))).collect()]
    assert found("the <-> fox") == [1] and found(r"'it\'s' <-> the") == [] and found("a & b") == [2] and found("a <-> b") == [] and found("fox:A") == [1]
    back = df.where("id = 1").select(text_form(from_text_form(text_form(F.col("d")))).alias("f")).first()
    assert back.f == got[1].f
