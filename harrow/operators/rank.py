"""BM25 ranking in one pass per need: a first aggregate takes the corpus statistics of the query's terms, a second pass scores and keeps the
top k. Neither shuffles rows: the first sends one row a task, the second k rows a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import term_frequency
from ..plans.query import Node, literals, parse
from .match import matches

VARIANTS = {"lucene": "lucene", "robertson": "robertson", "atire": "atire", "bm25+": "plus", "bm25plus": "plus", "bm25l": "l", "l": "l"}


@dataclass(frozen=True)
class CorpusStats:
    n_docs: int
    avgdl: float
    df: dict[str, int]
    max_tf: dict[str, int]


def corpus_stats(docs: DataFrame, terms: list[str], doc: str = "doc") -> CorpusStats:
    """N, average length, and each term's document frequency and largest term frequency, of the documents that aren't null."""
    d = F.col(doc)
    known = sorted(set(terms))
    wanted = [F.count(d["length"]).alias("n"), F.coalesce(F.avg(d["length"]), F.lit(0.0)).alias("avgdl")]
    for i, t in enumerate(known):
        tf = term_frequency(d, t)
        wanted += [F.count_if(tf > 0).alias(f"df{i}"), F.coalesce(F.max(tf), F.lit(0)).alias(f"tf{i}")]
    r = docs.agg(*wanted).first()
    return CorpusStats(r["n"], r["avgdl"], {t: r[f"df{i}"] for i, t in enumerate(known)}, {t: max(0, r[f"tf{i}"]) for i, t in enumerate(known)})


def idf(n: float, df: float, variant: str = "lucene") -> float:
    """The inverse document frequency of a variant; df is kept within 1 to n, and n at 1 or more."""
    n = max(1.0, float(n))
    df = min(max(1.0, float(df or 1)), n)
    kind = VARIANTS[variant]
    if kind == "robertson":
        return math.log((n - df + 0.5) / (df + 0.5))
    if kind == "atire":
        return math.log(n / df)
    if kind == "l":
        return math.log((n + 1) / (df + 0.5))
    if kind == "plus":
        return math.log((n + 1) / df)
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(doc: Column, query: Node | None, n_docs: float, avgdl: float, df: dict[str, float] | None = None, k1: float = 1.2, b: float = 0.75, variant: str = "lucene") -> Column:
    """The score of a document: a sum over every literal of the query, repeated and negated ones too; null for null."""
    terms = literals(query)
    total = bm25_sum({t: term_frequency(doc, t) for t in terms}, doc["length"], terms, n_docs, avgdl, df, k1, b, variant)
    return F.when(doc.isNotNull(), total)


def bm25_sum(frequency: dict[str, Column], length: Column, terms: list[str], n_docs: float, avgdl: float, df: dict[str, float] | None = None, k1: float = 1.2, b: float = 0.75, variant: str = "lucene") -> Column:
    """The sum over ``terms`` by their frequencies in a document of that length."""
    if variant not in VARIANTS:
        raise ValueError(f"no such variant: {variant}")
    kind = VARIANTS[variant]
    avgdl = avgdl if avgdl > 0 else 1.0
    total: Column = F.lit(0.0)
    for t in terms:
        tf = frequency[t].cast("double")
        norm = 1 - b + b * length.cast("double") / avgdl
        w = idf(n_docs, (df or {}).get(t, 1), variant)
        if kind == "l":
            c = tf / norm + 0.5
            part = w * (k1 + 1) * c / (k1 + c)
        else:
            part = w * (tf * (k1 + 1) / (tf + k1 * norm) + (1.0 if kind == "plus" else 0.0))
        total = total + F.when(tf > 0, part).otherwise(0.0)
    return total


def bm25f(fields: list[Column], query: Node | None, weights: list[float], n_docs: float, avgdls: list[float], df: dict[str, float] | None = None, k1: float = 1.2, b: float = 0.75) -> Column:
    """Several fields of a document: term frequencies normalised by field, weighted, added, and saturated once."""
    if not len(fields) == len(weights) == len(avgdls):
        raise ValueError("fields, weights and average lengths differ in number")
    total: Column = F.lit(0.0)
    for t in literals(query):
        tf: Column = F.lit(0.0)
        for f, w, a in zip(fields, weights, avgdls, strict=True):
            norm = 1 - b + b * f["length"].cast("double") / (a if a > 0 else 1.0)
            tf = tf + F.coalesce(w * term_frequency(f, t).cast("double") / norm, F.lit(0.0))
        total = total + idf(n_docs, (df or {}).get(t, 1)) * tf * (k1 + 1) / (tf + k1)
    return total


def distance(score: Column) -> Column:
    return 1 / (1 + score)


def lexscore(d: Column) -> Column:
    """The score of a distance: 1/d - 1; infinite for none or less."""
    return F.when(d > 0, 1 / d - 1).when(d.isNotNull(), F.lit(float("inf")))


def quantized_length(length: Column) -> Column:
    """A length as an index of eight-bit lengths keeps it: exact below 16, beyond that its four leading binary digits."""
    digits = F.length(F.bin(length)) - 4
    whole = F.pow(F.lit(2.0), digits.cast("double"))
    return F.when(length < 16, length.cast("long")).otherwise((F.floor(length / whole) * whole).cast("long"))


def value_score(doc: Column, query: Node | None) -> Column:
    """Without a corpus: one document, so every present term weighs ln(4/3) against the document's own length."""
    n = doc["length"].cast("double")
    total: Column = F.lit(0.0)
    for t in literals(query):
        tf = term_frequency(doc, t).cast("double")
        total = total + F.when(tf > 0, idf(1, 1) * tf * 2.2 / (tf + 1.2)).otherwise(0.0)
    return F.when(n.isNotNull(), total)


def search(docs: DataFrame, query: str | Node, k: int = 10, doc: str = "doc", id_column: str = "doc_id", gate: Column | None = None, stats: CorpusStats | None = None, variant: str = "lucene") -> DataFrame:
    """The k best matches: id, score. Documents that match without any literal term follow at score 0; ties by id.

    ``gate``: a condition on other columns, checked before anything is scored; statistics stay those of the whole corpus.
    """
    node = parse(query) if isinstance(query, str) else query
    stats = stats or corpus_stats(docs, literals(node), doc)
    found = docs if gate is None else docs.where(gate)
    found = found.where(matches(F.col(doc), node))
    score = bm25(F.col(doc), node, stats.n_docs, stats.avgdl, stats.df, variant=variant)
    return found.select(F.col(id_column), F.round(score, 6).alias("score")).orderBy(F.desc("score"), F.col(id_column)).limit(k)


def ordered(docs: DataFrame, query: str | Node, k: int, doc: str = "doc", id_column: str = "doc_id", stats: CorpusStats | None = None) -> DataFrame:
    """An ordering scan without a filter: every row by distance, those without a literal term at 1, null documents last."""
    node = parse(query) if isinstance(query, str) else query
    stats = stats or corpus_stats(docs, literals(node), doc)
    d = F.round(distance(bm25(F.col(doc), node, stats.n_docs, stats.avgdl, stats.df)), 6)
    return docs.select(F.col(id_column), d.alias("distance")).orderBy(F.asc_nulls_last("distance"), F.col(id_column)).limit(k)


def count_matches(docs: DataFrame, query: str | Node, doc: str = "doc") -> DataFrame:
    node = parse(query) if isinstance(query, str) else query
    return docs.agg(F.count_if(F.coalesce(matches(F.col(doc), node), F.lit(False))).alias("n"))
