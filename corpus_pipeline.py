"""The corpus pipeline: quality, near duplicates, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir), where docs are the rows that its predecessor kept, with the columns of ``documents``; ``run`` writes each
stage's rows to the shared folder and reads them back for the next. Null ids and texts, repeated rows, empty texts and empty tables pass
through every stage: a null text counts as empty for quality and tokens, has no near duplicate, and holds no benchmark words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.bpe import decode, encode
from harrow.llm.decontamination import decontaminate
from harrow.llm.near_duplicates import BROADCAST_IDS, near_duplicates
from harrow.llm.quality import fit_quality, score_quality
from harrow.llm.shared import written

#: No SQL can express the classifier, the sketches or the tokens.
ORACLE_SQL = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named by number, which no column of an operator clashes with; and the numbers' names."""
    names = {c: f"column_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _named(plain: DataFrame, docs: DataFrame) -> DataFrame:
    return plain.select(*[F.col(f"column_{k}").alias(c) for k, c in enumerate(docs.columns)])


def _small_batches(spark: SparkSession) -> None:
    """The pipeline's own session sends texts to Python in batches of at most 1,000 rows: its stages follow each other in the same executors, whose
    Python workers keep the memory of their largest batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.5 or more; the classifier learns from the labels' learning side of these documents."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain, names = _numbered(docs)
    at = names["text"]
    return _named(score_quality(plain, fit_quality(docs, labels), at, "score").where("score >= 0.5"), docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row: with the smallest id, or any where all ids are null. Rows without a text stay."""
    _small_batches(spark)
    found = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if found.ids == found.rows:
        classes = written(near_duplicates(docs), "classes")
        removed = classes.where("doc_id <> class_id").select("doc_id")
        n_removed = removed.count()
        return docs.join(F.broadcast(removed) if n_removed <= BROADCAST_IDS else removed, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    # ids repeat or are null: rows are named by their place in a written copy, and classes are of rows
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    classes = written(near_duplicates(rows, "_row"), "classes").withColumnRenamed("doc_id", "_row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row")
    kept = rows.select("_row", "doc_id").join(classes, "_row").groupBy("class_id").agg(first).select("_row")
    return rows.join(kept, "_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated: under a twentieth of their words lies inside benchmark windows, or none."""
    plain, names = _numbered(docs)
    _small_batches(spark)
    found = decontaminate(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names["doc_id"], names["text"], keep=tuple(plain.columns))
    clean = ~((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return _named(found.where(clean), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether the ids decode to the text's bytes."""
    import public_tokenizers

    _small_batches(spark)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = encode(docs.withColumn("_digest", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)), path, pattern, keep=("lang", "source", "_digest"))
    back = decode(coded, path, pattern)
    return back.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.sha2("decoded", 256) == F.col("_digest")).alias("round_trip"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("decontamination", decontamination), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
