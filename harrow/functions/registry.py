"""The scalar and table functions under SQL names, as temporary SQL functions: their bodies are expressions that Catalyst inlines, so they cost what the columns cost."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .analysis import SEPARATOR

_SEPARATOR = SEPARATOR.replace("\\", "\\\\")
_DOT = "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"
_NORM = "sqrt(aggregate({0}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"
_CHECKED = "CASE WHEN size(a) <> size(b) THEN raise_error('different vector dimensions') ELSE {} END"
_V = "ARRAY<FLOAT>"

#: name: (parameters, type, body)
SCALARS: dict[str, tuple[str, str, str]] = {
    "harrow_tokens": ("body STRING", "ARRAY<STRING>", f"filter(split(lower(translate(body, 'İΣ', 'iσ')), '{_SEPARATOR}'), t -> t <> '')"),
    "harrow_length": ("body STRING", "INT", "size(harrow_tokens(body))"),
    "harrow_tf": ("body STRING, term STRING", "INT", "size(filter(harrow_tokens(body), t -> t = term))"),
    "harrow_positions": ("body STRING, term STRING", "ARRAY<INT>", "filter(transform(harrow_tokens(body), (t, i) -> IF(t = term, i + 1, NULL)), p -> p IS NOT NULL)"),
    "harrow_phrase": ("body STRING, first STRING, second STRING, gap INT", "BOOLEAN", "arrays_overlap(transform(harrow_positions(body, first), p -> p + gap), harrow_positions(body, second))"),
    "harrow_idf": ("n DOUBLE, df DOUBLE", "DOUBLE", "ln(1 + (greatest(1D, n) - least(greatest(1D, df), greatest(1D, n)) + 0.5D) / (least(greatest(1D, df), greatest(1D, n)) + 0.5D))"),
    "harrow_bm25": ("tf DOUBLE, length DOUBLE, n DOUBLE, df DOUBLE, avgdl DOUBLE", "DOUBLE", "harrow_idf(n, df) * tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * length / avgdl))"),
    "harrow_edits": ("body STRING, word STRING", "DOUBLE", "coalesce(CAST(array_min(transform(harrow_tokens(body), t -> levenshtein(t, word))) AS DOUBLE), CASE WHEN body IS NOT NULL THEN double('Infinity') END)"),
    "harrow_inner_product": (f"a {_V}, b {_V}", "DOUBLE", _CHECKED.format(_DOT)),
    "harrow_l2": (f"a {_V}, b {_V}", "DOUBLE", _CHECKED.format("sqrt(aggregate(zip_with(a, b, (x, y) -> pow(CAST(x AS DOUBLE) - CAST(y AS DOUBLE), 2)), 0D, (s, x) -> s + x))")),
    "harrow_l1": (f"a {_V}, b {_V}", "DOUBLE", _CHECKED.format("aggregate(zip_with(a, b, (x, y) -> abs(CAST(x AS DOUBLE) - CAST(y AS DOUBLE))), 0D, (s, x) -> s + x)")),
    "harrow_norm": (f"a {_V}", "DOUBLE", _NORM.format("a")),
    "harrow_cosine": (f"a {_V}, b {_V}", "DOUBLE", _CHECKED.format(f"CASE WHEN {_NORM.format('a')} * {_NORM.format('b')} > 0 THEN 1 - greatest(-1D, least(1D, {_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}))) ELSE double('NaN') END")),
    "harrow_compare": (f"a {_V}, b {_V}", "INT", "CASE WHEN a < b THEN -1 WHEN a > b THEN 1 WHEN a = b THEN 0 END"),
    "harrow_lexscore": ("d DOUBLE", "DOUBLE", "CASE WHEN d > 0 THEN 1 / d - 1 WHEN d IS NOT NULL THEN double('Infinity') END"),
    "harrow_cosscore": ("d DOUBLE", "DOUBLE", "1 - d"),
    "harrow_l2score": ("d DOUBLE", "DOUBLE", "-(d * d)"),
    "harrow_ipscore": ("d DOUBLE", "DOUBLE", "-d"),
    "harrow_editscore": ("d DOUBLE", "DOUBLE", "-d"),
    "harrow_fuse": ("scores ARRAY<DOUBLE>, weights ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(scores) <> size(weights) OR exists(weights, w -> w IS NULL OR NOT w > 0) THEN raise_error('one positive weight a score') ELSE -aggregate(zip_with(scores, weights, (s, w) -> s * w), 0D, (t, x) -> t + x) END"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Defines the scalar functions for SQL in this session, and returns their names."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(SCALARS)


def register_index(spark: SparkSession, index, prefix: str = "harrow_index") -> list[str]:
    """Views and table functions over a stored index for SQL: ``{prefix}_documents``, ``_postings``, ``_vocabulary``, ``_corpus``; {prefix}_search(term, k), the best documents of a
    term, {prefix}_terms(start), terms by prefix with their frequencies, and {prefix}_near(word, edits). Longer queries go through ``index.search``."""
    for name in ("documents", "postings", "vocabulary", "corpus"):
        getattr(index, name).createOrReplaceTempView(f"{prefix}_{name}")
    tables = {
        f"{prefix}_search": ("wanted STRING, k INT", "doc_id BIGINT, score DOUBLE", f"SELECT doc_id, score FROM (SELECT p.doc_id, round(harrow_bm25(p.tf, p.length, c.n_docs, v.df, c.avgdl), 6) AS score, row_number() OVER (ORDER BY round(harrow_bm25(p.tf, p.length, c.n_docs, v.df, c.avgdl), 6) DESC, p.doc_id) AS place FROM {prefix}_postings p JOIN {prefix}_vocabulary v ON v.term = p.term CROSS JOIN {prefix}_corpus c WHERE p.term = wanted AND v.term = wanted) WHERE place <= k"),
        f"{prefix}_terms": ("start STRING", "term STRING, df BIGINT, max_tf INT", f"SELECT term, df, max_tf FROM {prefix}_vocabulary WHERE startswith(term, start)"),
        f"{prefix}_near": ("word STRING, edits INT", "term STRING, df BIGINT, distance INT", f"SELECT term, df, levenshtein(term, word) FROM {prefix}_vocabulary WHERE abs(length(term) - length(word)) <= edits AND levenshtein(term, word) <= edits"),
    }
    for name, (parameters, columns, body) in tables.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    return list(tables)
