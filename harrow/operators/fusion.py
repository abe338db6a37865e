"""Fused ranking: a weighted sum of scores, the fused search over text and vector channels with its normalizer, and reciprocal ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import literals, parse
from .index import StoredIndex
from .match import matches
from .rank import CorpusStats, bm25, corpus_stats, idf, lexscore
from .vector import cosine_score, l2_score, l2_squared, literal, negated_score, negative_inner_product

K1, B = 1.2, 0.75


def check_weights(weights: list[float] | None, n: int) -> list[float]:
    if weights is None:
        return [1.0] * n
    if len(weights) != n or any(w is None or not math.isfinite(w) or w <= 0 for w in weights):
        raise ValueError("one finite positive weight a score")
    return list(weights)


def fuse(scores: list[Column], weights: list[float] | None = None) -> Column:
    """Minus the weighted sum, from left to right; null if any score is null."""
    if not 2 <= len(scores) <= 8:
        raise ValueError("2 to 8 scores")
    total = None
    for s, w in zip(scores, check_weights(weights, len(scores)), strict=True):
        total = w * s if total is None else total + w * s
    return -total


def lexical_ceiling(query: str, stats: CorpusStats) -> float:
    """The most that a document can score: every term at its largest frequency, in the shortest document."""
    total = 0.0
    for t in literals(parse(query)):
        m = stats.max_tf.get(t, 0)
        total += idf(stats.n_docs, stats.df.get(t, 0)) * m * (K1 + 1) / (m + K1 * (1 - B)) if m else 0.0
    return total


def fused_search(table: DataFrame, texts: list[str], vectors: list[list[float]], weights: list[float] | None = None, k: int = 10, metric: str = "l2", normalize: bool = True, gate: str | None = None, condition: Column | None = None, doc: str = "doc", vector: str = "embedding", id_column: str = "doc_id") -> DataFrame:
    """id, score, parts of the k best by the weighted sum over channels.

    A text channel is the disjunction of its terms, whatever its operators say; ``gate`` (a query) and ``condition`` decide what is ranked at all. A document
    without a vector is not ranked where there is a vector channel; one without a term scores 0 on that text. ``normalize`` divides a channel's weight by the most
    its score can reach; where that is not positive and finite the weight stays as it is.
    """
    weights = check_weights(weights, len(texts) + len(vectors))
    d, v = F.col(doc), F.col(vector)
    stats = corpus_stats(table, [t for q in texts for t in literals(parse(q))], doc)
    ceilings: list[float] = [lexical_ceiling(q, stats) for q in texts]
    parts = [F.coalesce(bm25(d, parse(q), stats.n_docs, stats.avgdl, stats.df), F.lit(0.0)) for q in texts]
    if vectors:
        longest = table.agg(F.max(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()[0] or 0.0
        for q in vectors:
            own = math.sqrt(sum(x * x for x in q))
            ceilings.append(longest * own if metric == "ip" else -own * own + 2 * longest * own)
            parts.append(-negative_inner_product(v, literal(q)) if metric == "ip" else -l2_squared(v, literal(q)))
    if normalize:
        weights = [w / c if c > 0 and math.isfinite(c) else w for w, c in zip(weights, ceilings, strict=True)]
    rows = table.where(d.isNotNull()) if texts and not vectors else table
    if vectors:
        rows = rows.where(v.isNotNull())
    if gate is not None:
        rows = rows.where(matches(d, parse(gate)))
    if condition is not None:
        rows = rows.where(condition)
    total = parts[0] * weights[0]
    for p, w in zip(parts[1:], weights[1:], strict=True):
        total = total + p * w
    out = rows.select(id_column, F.round(total, 6).alias("score"), F.array(*[F.round(p, 6) for p in parts]).alias("parts"))
    return out.orderBy(F.desc("score"), id_column).limit(k)


def fused_index_search(index: StoredIndex, vectors_table: DataFrame, texts: list[str], vectors: list[list[float]], weights: list[float] | None = None, k: int = 10, metric: str = "l2", normalize: bool = True, gate: str | None = None, condition: Column | None = None, vector: str = "embedding") -> DataFrame:
    """As ``fused_search``, over a stored index and a table (doc_id, ``vector``): text channels read the postings of their terms; ``condition`` is on facets."""
    weights = check_weights(weights, len(texts) + len(vectors))
    if not 2 <= len(weights) <= 31:
        raise ValueError("2 to 31 channels")
    stats = index.stats([t for q in texts for t in literals(parse(q))])
    v = F.col(vector)
    known = index.documents.where("length is not null") if texts and not vectors else index.documents
    rows = (known if condition is None else known.where(condition)).select("doc_id")
    ceilings = [lexical_ceiling(q, stats) for q in texts]
    parts = []
    if vectors:
        owned = index.documents.select("doc_id").join(vectors_table.where(v.isNotNull()).select("doc_id", v), "doc_id")
        rows = rows.join(owned, "doc_id")
        longest = owned.agg(F.max(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()[0] or 0.0
    if gate is not None:
        rows = rows.join(index.matching(gate), "doc_id", "left_semi")
    for i, q in enumerate(texts):
        rows = rows.join(index.scored(q, stats, matched=False).withColumnRenamed("score", f"text{i}"), "doc_id", "left")
        parts.append(F.coalesce(f"text{i}", F.lit(0.0)))
    for q in vectors:
        own = math.sqrt(sum(x * x for x in q))
        ceilings.append(longest * own if metric == "ip" else -own * own + 2 * longest * own)
        parts.append(-negative_inner_product(v, literal(q)) if metric == "ip" else -l2_squared(v, literal(q)))
    if normalize:
        weights = [w / c if c > 0 and math.isfinite(c) else w for w, c in zip(weights, ceilings, strict=True)]
    total = parts[0] * weights[0]
    for p, w in zip(parts[1:], weights[1:], strict=True):
        total = total + p * w
    out = rows.select("doc_id", F.round(total, 6).alias("score"), F.array(*[F.round(p, 6) for p in parts]).alias("parts"))
    return out.orderBy(F.desc("score"), "doc_id").limit(k)


def score_of(distance: Column, kind: str) -> Column:
    """What a distance is worth as a score: ``lexical`` 1/d - 1, ``cosine`` 1 - d, ``l2`` minus its square, ``ip`` and ``edit`` minus itself; ``score`` is one already."""
    kinds = {"lexical": lexscore, "cosine": cosine_score, "l2": l2_score, "ip": negated_score, "edit": negated_score, "score": lambda d: d}
    if kind not in kinds:
        raise ValueError(f"no such distance: {kind}")
    return kinds[kind](distance)


def fuse_distances(distances: list[tuple[Column, str]], weights: list[float] | None = None) -> Column:
    """``fuse`` of distances of known kinds, each as its score."""
    return fuse([score_of(d, kind) for d, kind in distances], weights)


def reciprocal_rank_fusion(lists: list[DataFrame], id_column: str, order: list[tuple[str, bool]], k: int = 10, constant: int = 60) -> DataFrame:
    """Sum of 1 / (60 + rank) over ranked lists (column, whether descending) that each hold a top k: id, score."""
    every = None
    for df, (column, down) in zip(lists, order, strict=True):
        w = Window.orderBy(F.desc(column) if down else F.asc(column), id_column)  # a top k is small
        one = df.withColumn("r", F.row_number().over(w)).select(id_column, (1.0 / (constant + F.col("r"))).alias("s"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(id_column).agg(F.round(F.sum("s"), 6).alias("score")).orderBy(F.desc("score"), id_column).limit(k)
