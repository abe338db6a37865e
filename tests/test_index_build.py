from pyspark.sql import functions as F

from harrow.functions.analysis import analyze, set_zone, strip_positions
from harrow.operators import index as stored
from harrow.operators import measures, vocabulary


def test_postings_are_grouped_without_an_exchange(spark):
    texts = [(i, f"a b{i % 5} a c{i} " * (i % 4)) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("doc", analyze(F.col("text")))
    assert "Exchange" not in vocabulary.postings(docs)._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, t in texts:
        for k, w in enumerate((t or "").split(), 1):
            want.setdefault((w, i), []).append(k)
    assert {(r.term, r.doc_id): r.positions for r in vocabulary.postings(docs).collect()} == want


def test_ranges_of_postings_grow_with_the_tokens(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "RANGE_TOKENS", 20)
    texts = [(f"k{i}", "the " * 20 + f"w{i}" if i % 3 else None) for i in range(90)]
    docs = spark.createDataFrame(texts, "id string, text string").withColumn("doc", F.when(F.col("id") == "k1", strip_positions(analyze(F.col("text")))).otherwise(set_zone(analyze(F.col("text")), "B")))
    stored.build_index(docs, f"file://{tmp_path}/i", id_column="id")
    assert len(list((tmp_path / "i/postings").glob("*.parquet"))) > int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    assert not (tmp_path / "i/made").exists()
    i = stored.StoredIndex(spark, f"file://{tmp_path}/i")
    assert {(r.term, r.doc_id, r.tf, r.length) for r in i.postings.collect()} == {x for k, t in texts if t for x in (("the", k, 20, 21), (f"w{k[1:]}", k, 1, 21))}
    held = {r.doc_id: r for r in i.postings.where("term = 'the'").collect()}
    assert held["k1"].positions is None and held["k1"].zones is None
    assert held["k2"].positions == list(range(1, 21)) and set(held["k2"].zones) == {4}
    assert {r.doc_id: r.length for r in i.documents.collect()} == {k: 21 if t else None for k, t in texts}
    assert i.corpus.first().n_docs == 60 and i.corpus.first().n_terms == 61


def test_stored_postings_are_checked_by_one_exchange(spark, monkeypatch):
    """Lost, doubled, foreign, wrong and empty postings, and descending positions, as the join of all postings counts them."""
    analysed = analyze(F.col("text"))
    turned = F.when(F.col("doc_id") == 3, analysed.withField("pos", F.reverse(analysed["pos"]))).otherwise(analysed)
    texts = [(i, f"a b{i % 5} a c{i} " * (1 + i % 4)) for i in range(40)] + [(40, None), (41, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("doc", turned)
    good = vocabulary.postings(docs).select("term", "doc_id", "tf").collect()
    held = [tuple(r) for r in good if (r.term, r.doc_id) not in {("a", 5), ("c6", 6)}]
    held += [("a", 7, 4), ("a", 7, 8), ("a", 7, 8), ("a", 3, 1), ("zz", 8, 2), ("zz", 8, 2), ("zz", 9, 0), ("", 9, 1), ("a", 99, 3), ("a", 40, 1), ("a", 41, 1), (None, 11, 4)]
    stored_rows = spark.createDataFrame(held, "term string, doc_id long, tf int")
    full = vocabulary.postings(docs).drop("tf").join(stored_rows, ["term", "doc_id"], "full")
    want = measures.check_index(docs, full.withColumns({"tf": F.coalesce("tf", F.lit(0)), "positions": F.coalesce("positions", F.array().cast("array<int>"))}))
    want = {r.check: r.violations for r in want.collect()}
    for size in (1 << 20, 3):
        monkeypatch.setattr(measures, "TASK_POSTINGS", size)
        got = measures.check_stored(docs, stored_rows)
        assert {r.check: r.violations for r in got.collect()} == want and min(want.values()) > 0
        plan = got._jdf.queryExecution().executedPlan().toString()
        final = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
        assert "Join" not in plan and final.count("Exchange hashpartitioning") == 1


def test_places_that_do_not_ascend_are_put_in_order(spark):
    analysed = analyze(F.col("text"))
    docs = spark.createDataFrame([(1, "a b a a"), (2, "a a b")], "doc_id long, text string").withColumn("doc", F.when(F.col("doc_id") == 1, analysed.withField("pos", F.reverse(analysed["pos"]))).otherwise(analysed))
    listed = lambda **x: {(r.term, r.doc_id): r.positions for r in vocabulary.postings_and_documents(docs, **x).where("term is not null").collect()}
    assert listed() == {("a", 1): [1, 2, 4], ("b", 1): [3], ("a", 2): [1, 2], ("b", 2): [3]}
    assert listed(in_order=False)["a", 1] == [4, 2, 1]
    brief = vocabulary.postings_and_documents(docs, in_order=False, lists=False)
    assert {(r.term, r.doc_id): (r.tf, r.descends) for r in brief.where("term is not null").collect()} == {("a", 1): (3, True), ("b", 1): (1, False), ("a", 2): (2, False), ("b", 2): (1, False)}
