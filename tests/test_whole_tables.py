"""Queries that run over whole tables, against brute force."""

import copy
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow import entries
from harrow.operators import measures, vector

TEXTS = [(0, "de", "WITH and With, wıth waſ wİth Was"), (1, "en", "x " * 5000 + "with a was b with c was " + "y " * 4000), (2, "fr", None), (3, "ja", "日本 with 日本with was"), (4, "en", "?!"), (5, "es", "The running él " * 1500), (6, "en", "was with " + "z " * 9 + "with was with")]
FOLD = {"İ": "i", "Σ": "σ"}


def folded(t):
    return "".join(FOLD.get(c, c.lower()) for c in t)


def words(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", text)


def marked(t):
    return f"[{t}]" if folded(t) in ("with", "was") else t


def best_window(text, width=6):
    p = words(text)
    hits = [folded(t) in ("with", "was") for t in p]
    i = max(range(max(len(p) - width, 0) + 1), key=lambda i: (sum(hits[i : i + width]), -i))
    return ("..." if i else "") + " ".join(map(marked, p[i : i + width])) + ("..." if i + width < len(p) else "")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('whole')}"
    rows = [(*r, len(r[2] or "")) for r in TEXTS] + [(i, "fr", "with " * (i % 5), 5 * (i % 5)) for i in range(7, 900)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string, n_chars int").write.parquet(f"{d}/documents.parquet")
    x = np.random.default_rng(3).normal(size=(700, 4)).astype("float32")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d, rows, x.astype(float)


def test_highlight_and_snippet(spark, tables):
    d, rows, _ = tables
    got = {r.doc_id: r.h for r in entries.QUERIES["highlight_all"](spark, d).collect()}
    want = {i: t if t is None else re.sub(r"[0-9A-Za-z\x80-\U0010FFFF]+", lambda m: marked(m[0]), t) for i, _, t, _ in rows}
    assert got == want
    got = {r.doc_id: r.h for r in entries.QUERIES["snippet_all"](spark, d).collect()}
    assert got == {i: t if t is None else best_window(t) for i, _, t, _ in rows}


def test_fuse_value(spark, tables):
    d, rows, x = tables
    cos = x @ x[7] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[7])
    got = [(r.doc_id, r.f) for r in entries.QUERIES["fuse_value_all"](spark, d).collect()]
    assert sorted(i for i, _ in got) == sorted(r[0] for r in rows)
    assert all(f is None for _, f in got[-199:]) and all(i >= 700 or i == 2 for i, f in got if f is None)
    for i, f in got:
        if f is not None:
            tf = [folded(t) for t in words(rows[i][2])].count("with")
            assert abs(f + 0.5 * np.log(4 / 3) * tf * 2.2 / (tf + 1.2) + 3 * cos[i]) < 2e-6
    scores = [f for _, f in got if f is not None]
    assert scores == sorted(scores)


def test_english_match_reads_every_language(spark, tables):
    assert {r.doc_id for r in entries.QUERIES["english_match"](spark, tables[0]).collect()} == {5}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distances_over_all_tokens(spark, tmp_path):
    texts = ["wïth with", "wíth other", "日本 wit", "théreon", "thereö", "日本", "", None, "𝔴ith"]
    d = f"file://{tmp_path}"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    seen = {}
    for i, t in enumerate(texts):
        for w in words(t or ""):
            seen.setdefault(folded(w), set()).add(i)
    want = sorted((w, len(at), edits(w, "with")) for w, at in seen.items() if edits(w, "with") <= 2)
    got = sorted(map(tuple, entries.QUERIES["fuzzy_vocabulary_all"](spark, d).collect()))
    assert got == want and ("wïth", 1, 1) in got and ("日本", 2, 4) not in got
    want = sorted((float(min((edits(folded(w), "thereon") for w in words(t)), default=np.inf)), i) for i, t in enumerate(texts) if t is not None) + [(None, 7)]  # null comes last
    got = [(r.distance, r.doc_id) for r in entries.QUERIES["edit_distance_order_all"](spark, d).collect()]
    assert got == want and got[0] == (1.0, 3)


def test_more_queries_than_a_block(spark):
    x = np.random.default_rng(5).integers(-9, 9, size=(30, 2)).astype(float)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    q = spark.range(9000).selectExpr("id as query_id", "array(cast(id % 17 - 8 as float), cast(id % 11 - 5 as float)) as query")
    got = {}
    for r in vector.nearest_many(e, q, 3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.distance, r.vec_id)
    assert len(got) == 9000
    for i, best in got.items():
        d = np.sqrt(((x - [i % 17 - 8, i % 11 - 5]) ** 2).sum(axis=1))
        assert [best[n] for n in (1, 2, 3)] == sorted((round(float(v), 6), j) for j, v in enumerate(d))[:3]


def test_text_forms_of_documents(spark, tables):
    d, rows, _ = tables
    got = {r.doc_id: (r.form, r.zoned) for r in entries.QUERIES["document_text_form_all"](spark, d).collect()}
    for i, _, t, _ in rows:
        at = {}
        for k, w in enumerate(map(folded, words(t or "")), 1):
            at.setdefault(w, []).append(k)
        form = lambda z: " ".join(f"'{w}':{len(p)}@{','.join(f'{k}{z}' for k in p)}" for w, p in sorted(at.items(), key=lambda x: x[0].encode()))
        assert got[i] == ((None, None) if t is None else (form(""), form("B")))
    same = {r.doc_id: r.same for r in entries.QUERIES["document_round_trip_all"](spark, d).collect()}
    assert same == {i: None if t is None else True for i, _, t, _ in rows}


def test_invariants_see_the_stored_index(spark, tables, monkeypatch):
    d, good = tables[0], entries.index
    assert {r.violations for r in entries.QUERIES["index_invariants"](spark, d).collect()} == {0}

    def spoilt(change):
        def index(s, d):
            i = copy.copy(good(s, d))
            i.postings = change(i.postings)
            return i

        monkeypatch.setattr(entries, "index", index)
        return {r.check: r.violations for r in entries.QUERIES["index_invariants"](spark, d).collect()}

    one = "doc_id = 1 and term = 'with'"
    lost = spoilt(lambda p: p.where(f"not ({one})"))
    assert lost["frequencies differ from the length"] == 1 and lost["positions differ from the frequency"] == 1
    assert spoilt(lambda p: p.unionByName(p.where(one)))["frequencies differ from the length"] == 1
    assert spoilt(lambda p: p.unionByName(p.where(one).withColumn("doc_id", F.lit(-5).cast("long"))))["postings without a document"] == 1


def test_quantized_is_exact_with_copies_and_zeros(spark, sf):
    rng = np.random.default_rng(9)
    x = np.concatenate([np.ones((300, 8)) + rng.normal(size=(300, 8)) * 1e-3, rng.normal(size=(50, 8)), np.zeros((2, 8))]).astype("float32")
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for probe in (x[5].tolist(), [0.0] * 8):
        assert vector.nearest_two_stage(e, probe, 10, 4, 2).collect() == vector.nearest(e, probe, 10).collect()
    held = spark.read.parquet(f"{sf}/embeddings.parquet")
    for r in held.where("vec_id % 50 = 0").collect():
        assert vector.nearest_two_stage(held, list(r.embedding)).collect() == vector.nearest(held, list(r.embedding)).collect()


def test_ranking_measures_gather_no_group(spark):
    rng = np.random.default_rng(2)
    judged = [(q, i, int(rng.integers(0, 4))) for q in (1, 2, 3) for i in range(60 if q < 3 else 4)]
    run = [(q, int(i), r) for q in (1, 2) for r, i in enumerate(rng.permutation(60)[:20], 1)]
    out = measures.ranking_measures(spark.createDataFrame(run, "qid int, doc_id int, rank int"), spark.createDataFrame(judged, "qid int, doc_id int, rel int"), 10)
    rel = {(q, i): r for q, i, r in judged}
    gain = lambda r, k: (2**r - 1) / np.log2(k + 1)
    for row in out.collect():
        best = sorted((r for q, _, r in judged if q == row.qid and r > 0), reverse=True)
        hits = [(rel[q, i], k) for q, i, k in run if q == row.qid and k <= 10 and rel[q, i] > 0]
        assert row.ndcg == pytest.approx(sum(gain(*h) for h in hits) / sum(gain(r, k) for k, r in enumerate(best[:10], 1)), abs=1e-6)
        assert row.recall == pytest.approx(len(hits) / len(best), abs=1e-6)
        assert row.mrr == pytest.approx(1 / min(k for _, k in hits) if hits else 0, abs=1e-6)
    assert out.count() == 3 and "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
