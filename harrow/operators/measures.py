"""Invariants of an index, and retrieval measures against relevance judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vocabulary import postings_and_documents

#: Postings of a task that counts them, about.
TASK_POSTINGS = 1 << 20


def check_index(docs: DataFrame, postings: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(check, violations): postings belong to documents, frequencies add up to lengths, positions ascend, terms are not empty."""
    sums = postings.groupBy(id_column).agg(F.sum("tf").alias("s"), F.count_if(F.array_sort("positions") != F.col("positions")).alias("p"), F.count_if(F.size("positions") != F.col("tf")).alias("q"), F.count_if(F.col("term") == "").alias("e"))
    joined = docs.where("doc is not null").select(id_column, F.col("doc.length").alias("n")).join(sums, id_column, "full")
    return _violations(joined)


def _violations(of_documents: DataFrame) -> DataFrame:
    """Of n, the length of a document, and s, p, q, e of its postings."""
    r = of_documents.agg(F.count_if(F.col("n").isNull()).alias("postings without a document"), F.count_if(F.col("n").isNotNull() & (F.col("n") != F.coalesce("s", F.lit(0)))).alias("frequencies differ from the length"), F.coalesce(F.sum("p"), F.lit(0)).alias("positions out of order"), F.coalesce(F.sum("q"), F.lit(0)).alias("positions differ from the frequency"), F.coalesce(F.sum("e"), F.lit(0)).alias("empty terms"))
    return r.unpivot([], r.columns, "check", "violations")


def check_stored(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """``check_index`` of a stored index's postings (term, doc_id, tf) against the positions of ``docs``: lost, doubled and foreign postings count."""
    made = postings_and_documents(docs, in_order=False, lists=False).where("term is not null or length is not null")
    # what a row is: 0 a document, with its length as ``tf``; 1 a posting made, 2 one whose positions descend; 3 a stored one
    kind = F.when(F.col("term").isNull(), 0).when(F.col("descends"), 2).otherwise(1)
    made = made.select("doc_id", "term", F.when(kind == 0, F.col("length")).otherwise(F.col("tf")).alias("tf"), kind.cast("byte").alias("kind"))
    rows = made.unionByName(stored.select("doc_id", "term", F.coalesce(F.col("tf").cast("int"), F.lit(0)).alias("tf"), F.lit(3).cast("byte").alias("kind")))
    # one exchange, on the document; what follows is grouped where it is
    tasks = stored.count() // TASK_POSTINGS
    dealt = rows.repartition(tasks, "doc_id") if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition("doc_id")
    alike = dealt.groupBy("doc_id", "term", "tf").agg(F.coalesce(F.max(F.when(F.col("kind") < 3, F.col("kind"))), F.lit(-1)).alias("own"), F.count_if(F.col("kind") == 3).alias("held"))
    odd = F.when(F.col("own") < 1, F.col("held")).otherwise(0)
    of_terms = alike.groupBy("doc_id", "term").agg(F.max(F.when(F.col("own") == 0, F.col("tf"))).alias("n"), F.max("own").alias("own"), F.sum("held").alias("held"), F.sum(F.col("tf") * F.col("held")).alias("s"), F.sum(odd).alias("odd"), F.sum(F.when(F.col("tf") != 0, odd).otherwise(0)).alias("foreign"))
    # a posting made that isn't stored counts as stored once, at 0; a stored one that isn't made has no positions
    times = F.when(F.col("own") > 0, F.greatest("held", F.lit(1))).otherwise(F.col("held"))
    differ = F.when(F.col("own") < 1, F.col("foreign")).when(F.col("held") == 0, 1).otherwise(F.col("odd"))
    return _violations(of_terms.groupBy("doc_id").agg(F.max("n").alias("n"), F.sum("s").alias("s"), F.sum(F.when(F.col("own") == 2, times).otherwise(0)).alias("p"), F.sum(differ).alias("q"), F.sum(F.when(F.col("term") == "", times).otherwise(0)).alias("e")))


def ranking_measures(run: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """Per query nDCG@k, recall@k and reciprocal rank of run (qid, doc_id, rank) against judgements (qid, doc_id, rel)."""
    gain = lambda rel, rank: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)
    hits = run.where(F.col("rank") <= k).join(judged.where("rel > 0"), ["qid", "doc_id"])
    got = hits.groupBy("qid").agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"), F.count("*").alias("found"), F.min("rank").alias("first"))
    counts = judged.where("rel > 0").groupBy("qid", "rel").agg(F.count("*").alias("n"))
    relevant = counts.groupBy("qid").agg(F.sum("n").alias("relevant"))
    # ranks 1 to k of the ideal order need the k largest relevances at most, and only how often each occurs
    down = Window.partitionBy("qid").orderBy(F.desc("rel"))
    most = counts.withColumn("i", F.row_number().over(down)).where(F.col("i") <= k)
    runs = most.withColumn("end", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("n")).where(F.col("start") < k)
    ranks = runs.select("qid", "rel", F.explode(F.sequence(F.col("start") + 1, F.least("end", F.lit(k).cast("long")))).alias("i"))
    ideal = ranks.groupBy("qid").agg(F.sum(gain(F.col("rel"), F.col("i"))).alias("idcg")).join(relevant, "qid")
    z = ideal.join(got, "qid", "left")
    return z.select("qid", F.round(F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)), 6).alias("ndcg"), F.round(F.coalesce(F.col("found") / F.col("relevant"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))
