"""The shuffle's law, exactness of the matrix, and uniformity."""

import numpy as np
from pyspark.sql import functions as F

from harrow.llm import sharding
from harrow.llm.sharding import communication_matrix, hypergeometric, permuted, shard_documents, write_shards


def test_matrix():
    counts = np.array([0, 5, 1000, 17, 3])
    m = communication_matrix(counts, 24, 1)
    assert (m.sum(axis=1) == counts).all()
    assert m.sum(axis=0).max() - m.sum(axis=0).min() <= 1


def test_large_hypergeometric():
    rng = np.random.default_rng(0)
    x = np.array([hypergeometric(rng, 10**9, 3 * 10**9, 400) for _ in range(3000)])
    assert abs(x.mean() - 100) < 1 and abs(x.var() - 75) < 8


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = [r.x for r in spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit(5)).alias("x")).collect()]
        assert sorted(got) == list(range(n))
    assert sum(a == b for a, b in enumerate(got)) < 20


def test_law(spark):
    rows = [(i % 900 if i else None, None if i % 50 == 0 else "same" if i % 3 == 0 else f"text {i}", "clash", i) for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int").repartition(5)
    for shards in (24, 7, 2000):
        out = shard_documents(df, shards)
        got = out.collect()
        assert len(got) == 1003
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r.slot)
        assert all(0 <= s < shards for s in by)
        sizes = [len(by.get(s, [])) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((r[0] or -1, r[1] or "") for r in rows)


def test_same_seed_same_result_and_uniform(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    one = {r.doc_id: (r.shard, r.slot) for r in shard_documents(docs, 4, stable=True).collect()}
    assert one == {r.doc_id: (r.shard, r.slot) for r in shard_documents(docs, 4, stable=True).collect()}
    runs = [{r.doc_id: r.shard for r in shard_documents(docs, 4, seed=10 * s, stable=True).collect()} for s in range(8)]
    many = np.array([[x[d] for d in range(200)] for x in runs])
    together = np.mean([(many[:, i] == many[:, i + 1]).mean() for i in range(199)])
    assert abs(together - 0.25) < 0.06


def test_empty_and_files(spark, tmp_path):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    write_shards(spark.range(100).withColumnRenamed("id", "doc_id"), f"file://{tmp_path}/s", 4)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == 100 and {r["count"] for r in back.groupBy("shard").count().collect()} == {25}


def test_splits_change_between_passes(spark, tmp_path, monkeypatch):
    path, key = f"file://{tmp_path}/d", "spark.sql.files.maxPartitionBytes"
    spark.range(1000).withColumnRenamed("id", "doc_id").repartition(8).write.parquet(path)
    drawn, usual = sharding.communication_matrix, spark.conf.get(key)

    def resplit(*args):
        spark.conf.set(key, "300")
        return drawn(*args)

    monkeypatch.setattr(sharding, "communication_matrix", resplit)
    docs = spark.read.parquet(path)
    try:
        for df, stable, n in ((docs, True, 1000), (docs, False, 1000), (docs.where("doc_id % 3 = 0"), True, 334)):
            spark.conf.set(key, usual)
            got = shard_documents(df, 7, stable=stable).collect()
            assert len({r.doc_id for r in got}) == len(got) == n
            by = {}
            for r in got:
                by.setdefault(r.shard, []).append(r.slot)
            assert sorted(by) == list(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
            assert all(sorted(v) == list(range(len(v))) for v in by.values())
    finally:
        spark.conf.set(key, usual)


def test_query_against_its_rows(spark, sf):
    import zlib
    from collections import Counter

    from harrow.llm import entries

    rows = entries.QUERIES["op2_shards"](spark, sf).collect()
    want = [(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == sorted(want)
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    count = Counter(r.shard for r in rows)
    assert set(count) == set(range(24)) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))


def test_buckets_by_bytes(spark, tmp_path, monkeypatch):
    from harrow.llm import sharding

    monkeypatch.setattr(sharding, "BUCKET_BYTES", 2000)
    rows = [(i, "x" * (i % 90), None if i % 3 else b"yy") for i in range(700)] + [(700, "z" * 100_000, b""), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, raw binary").repartition(3)
    got = sharding.shard_documents(df, 5).collect()
    assert sorted(map(repr, [tuple(r)[:3] for r in got])) == sorted(repr((i, t, b)) for i, t, b in rows)
    for s in range(5):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own))) and len(own) in (140, 141)
