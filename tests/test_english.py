import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harrow import entries
from harrow.functions import english
from harrow.functions.analysis import text_form
from harrow.functions.english import analyze_english, normalize_query, stem
from harrow.operators.match import matches
from harrow.plans.query import parse, show


@pytest.mark.parametrize(("word", "want"), [("running", "run"), ("races", "race"), ("quickly", "quick"), ("generously", "generous"), ("nationalization", "nation"), ("happily", "happili"), ("hopping", "hop"), ("hoping", "hope"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("this", "this"), ("kiwis", "kiwi"), ("agreed", "agre"), ("controlling", "control"), ("sky", "sky"), ("skies", "sky"), ("knackeries", "knackeri"), ("consignment", "consign"), ("say", "say"), ("by", "by"), ("apology", "apolog"), ("relational", "relat"), ("é", "é")])
def test_stems(word, want):
    assert stem(word) == want


def test_analyzer_and_query(spark):
    df = spark.createDataFrame([(1, "running the races quickly"), (2, None)], "id int, t string").withColumn("d", analyze_english(F.col("t")))
    got = df.select("id", text_form(F.col("d")).alias("f"), F.col("d.length").alias("n")).orderBy("id").collect()
    assert (got[0].f, got[0].n) == ("'quick':1@4 'race':1@3 'run':1@1", 3) and got[1].f is None
    assert show(normalize_query(parse("the races & !running"))) == "('race' & !'run')"
    assert df.where(matches(F.col("d"), normalize_query(parse('"running the race"')))).count() == 1


def test_each_distinct_token_is_looked_at_once(monkeypatch):
    seen = []
    monkeypatch.setattr(english, "stem", lambda w: seen.append(w) or w.removesuffix("s"))
    lists = pa.array([["the", "dogs", "ran", "dogs"], None, [], ["of", "the"], ["ran", "été"]])
    want = [(["dog", "ran", "dog"], [2, 3, 4], 3), None, ([], [], 0), ([], [], 0), (["ran", "été"], [1, 2], 2)]
    for size, calls in ((1 << 20, 3), (4, 4)):
        monkeypatch.setattr(english, "TOKENS", size)
        seen.clear()
        got = english.stopped_and_stemmed.func(lists, pa.array([8] * 5)).to_pylist()
        assert [d and (d["tokens"], d["pos"], d["length"]) for d in got] == want and len(seen) == calls
        assert [d["zone"] for d in got if d] == [[8] * d["length"] for d in got if d] and all(d["has_pos"] for d in got if d)
    sliced = english.stopped_and_stemmed.func(lists.slice(3), pa.array([1, 1])).to_pylist()
    assert [d["tokens"] for d in sliced] == [[], ["ran", "été"]] and english.stopped_and_stemmed.func(lists.slice(0, 0), pa.array([], pa.int32())).to_pylist() == []


def test_english_match_splits_a_text_once(spark, sf):
    plan = entries.QUERIES["english_match"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
