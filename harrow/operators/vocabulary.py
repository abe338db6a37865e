"""Operators over the vocabulary: statistics, postings, edit-distance order, rare-term documents, substring search, trigram similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens whose postings are made at once.
TOKENS = 1 << 20


def postings_and_documents(docs: DataFrame, doc: str = "doc", id_column: str = "doc_id", more: tuple[str, ...] = (), in_order: bool = True, lists: bool = True) -> DataFrame:
    """(term, id, tf, length, positions, zones, has_pos, ``more``): a row for each distinct term of a document, and one without a term, with the columns ``more``, for each
    row of ``docs``. A document's tokens stand in one row, so they are grouped where they are: nothing is exchanged, and the text is analysed once. Positions are in
    order of place and zone, or with ``in_order`` false in order of the tokens. With ``lists`` false ``descends``, whether a place is below the one before it, stands for positions, zones and has_pos."""
    d = F.col(doc)
    listed_only = [d["zone"].cast("array<tinyint>").alias("zone"), d["has_pos"].alias("has_pos")] if lists else []
    wide = docs.select(F.col(id_column), d["length"].cast("int").alias("length"), d["tokens"].alias("tokens"), d["pos"].alias("pos"), *listed_only, *more)
    kept = [wide.schema[c] for c in (id_column, "length", *(["has_pos"] if lists else []), *more)]
    places = [T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("zones", T.ArrayType(T.ByteType()))] if lists else [T.StructField("descends", T.BooleanType())]
    schema = T.StructType([T.StructField("term", T.StringType()), kept[0], T.StructField("tf", T.IntegerType()), kept[1], *places, *kept[2:]])
    names = schema.names

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        every = batch.column("tokens")
        n = np.diff(every.offsets.to_numpy())
        tokens = every.flatten().dictionary_encode()
        pos = batch.column("pos").flatten()
        at, zone = pos.to_numpy(), batch.column("zone").flatten() if lists else None
        row = np.repeat(np.arange(len(n)), n)
        key = row * np.int64(len(tokens.dictionary) + 1) + tokens.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        if in_order and (np.diff(at) <= 0)[np.diff(row) == 0].any():  # places that don't ascend as the tokens do
            order = np.lexsort((zone.to_numpy(), at, key))
        key = key[order]
        start = np.flatnonzero(np.diff(key, prepend=-1))
        ends = np.append(start, len(key)).astype(np.int32)
        first = order[start]
        own = batch.select([c.name for c in kept if c.name not in more]).take(pa.array(row[first]))
        cells = {"term": tokens.dictionary.take(tokens.indices.take(pa.array(first))), "tf": pa.array(np.diff(ends))}
        if lists:
            cells |= {c: pa.ListArray.from_arrays(pa.array(ends), x.take(pa.array(order))) for c, x in (("positions", pos), ("zones", zone))}
        else:
            down = np.zeros(len(at) + 1, np.int64)  # so many places before one are below their own predecessor, of the same term
            down[2:] = np.cumsum((np.diff(at[order]) < 0) & (np.diff(key) == 0))
            cells["descends"] = pa.array(np.diff(down[ends]) > 0)
        return pa.RecordBatch.from_arrays([cells[c] if c in cells else pa.nulls(len(own), batch.column(c).type) if c in more else own.column(c) for c in names], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = {"term": pa.string(), "tf": pa.int32(), "positions": pa.list_(pa.int32()), "zones": pa.list_(pa.int8()), "descends": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, alone[c]) if c in alone else batch.column(c) for c in names], names=names)
            batch = batch.filter(batch.column("tokens").is_valid())
            end, at = batch.column("tokens").offsets.to_numpy()[1:].astype(np.int64), 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + TOKENS, side="right")))
                yield made(batch.slice(at, stop - at))
                at = stop

    return wide.mapInArrow(rows, schema)


def postings(docs: DataFrame, doc: str = "doc", id_column: str = "doc_id") -> DataFrame:
    """(term, id, tf, positions): one row for each distinct term of an id, linear in the tokens."""
    return postings_and_documents(docs, doc, id_column, in_order=False).where("term is not null").select("term", id_column, "tf", "positions")


def term_pairs(docs: DataFrame, doc: str = "doc", id_column: str = "doc_id") -> DataFrame:
    """(term, id, tf) without positions: linear in the tokens."""
    return docs.select(F.col(id_column), F.explode(f"{doc}.tokens").alias("term")).groupBy(id_column, "term").agg(F.count("*").alias("tf"))


def term_stats(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(term, df): in how many documents. Distinct terms within a document are taken before the exchange."""
    return docs.select(F.explode(F.array_distinct(f"{doc}.tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def index_stats(docs: DataFrame, doc: str = "doc") -> DataFrame:
    d = F.col(doc)
    size = docs.agg(F.count(d["length"]).alias("n_docs"), F.round(F.avg(d["length"]), 6).alias("avgdl"))
    return size.crossJoin(term_stats(docs, doc).agg(F.count("*").alias("n_terms")))  # one row each


def edit_distance(doc: Column, word: str) -> Column:
    """Smallest edit distance of a token to ``word``; infinite for a document without tokens."""
    least = F.array_min(F.transform(F.array_distinct(doc["tokens"]), lambda t: F.levenshtein(t, F.lit(word))))
    return F.when(doc.isNotNull(), F.coalesce(least.cast("double"), F.lit(float("inf"))))


def nearest_by_edits(docs: DataFrame, word: str, k: int = 10, doc: str = "doc", id_column: str = "doc_id") -> DataFrame:
    """Documents without tokens stand at infinity, null documents last."""
    return docs.select(id_column, edit_distance(F.col(doc), word).alias("distance")).orderBy(F.asc_nulls_last("distance"), id_column).limit(k)


def fuzzy_terms(docs: DataFrame, word: str, k: int, doc: str = "doc") -> DataFrame:
    """(term, df, distance) of the vocabulary within k edits."""
    d = F.levenshtein("term", F.lit(word), k)
    return term_stats(docs, doc).where(F.abs(F.length("term") - len(word)) <= k).withColumn("distance", d).where("distance >= 0")


def anomalous_docs(docs: DataFrame, k: int = 100, max_df: int | None = None, doc: str = "doc", id_column: str = "doc_id") -> DataFrame:
    """The k documents with the rarest term: id, term, df, idf. Terms in more than ``max_df`` documents (N / 1000, 1 at least) don't count."""
    if k <= 0:
        raise ValueError("k must be positive")
    n = docs.agg(F.count(F.col(doc)["length"])).first()[0]
    most = max_df if max_df is not None else max(n // 1000, 1)
    rare = term_stats(docs, doc).where(F.col("df") <= most)
    pairs = docs.select(id_column, F.explode(F.array_distinct(f"{doc}.tokens")).alias("term")).join(rare, "term")
    best = pairs.groupBy(id_column).agg(F.min(F.struct("df", "term")).alias("b"))
    return best.select(id_column, F.col("b.term").alias("term"), F.col("b.df").alias("df"), F.round(_idf(n, F.col("b.df")), 6).alias("idf")).orderBy(F.desc("idf"), id_column).limit(k)


# --- over a stored index: each distinct term is looked at once -----------------------------------------------------------------------


def index_fuzzy_terms(index, word: str, k: int) -> DataFrame:
    """(term, df, distance) of the stored vocabulary within k edits."""
    near = index.vocabulary.where(F.abs(F.length("term") - len(word)) <= k).withColumn("distance", F.levenshtein("term", F.lit(word), k))
    return near.where("distance >= 0").select("term", "df", "distance")


def index_nearest_by_edits(index, word: str, k: int = 10) -> DataFrame:
    """The k documents whose nearest token is fewest edits from ``word``, as ``nearest_by_edits``; those without tokens, then null documents, come last.

    A term that is in k documents bounds the distance: postings of terms farther away are not read.
    """
    terms = index.vocabulary.select("term", "df", F.levenshtein("term", F.lit(word)).alias("distance"))
    edge = terms.where(F.col("df") >= k).agg(F.min("distance")).first()[0]
    wanted = terms if edge is None else terms.where(F.col("distance") <= edge)
    near = index.postings.select("term", "doc_id").join(wanted.select("term", "distance"), "term").groupBy("doc_id").agg(F.min("distance").cast("double").alias("distance"))
    if edge is None:
        none = F.when(F.col("length").isNotNull(), F.lit(float("inf")))
        near = index.documents.join(near, "doc_id", "left").select("doc_id", F.coalesce("distance", none).alias("distance"))
    return near.orderBy(F.asc_nulls_last("distance"), "doc_id").limit(k)


def index_anomalous_docs(index, k: int = 100, max_df: int | None = None) -> DataFrame:
    """As ``anomalous_docs``: postings of rare terms only."""
    if k <= 0:
        raise ValueError("k must be positive")
    n = index.corpus.first()["n_docs"]
    rare = index.vocabulary.where(F.col("df") <= (max_df if max_df is not None else max(n // 1000, 1))).select("term", "df")
    best = index.postings.select("term", "doc_id").join(rare, "term").groupBy("doc_id").agg(F.min(F.struct("df", "term")).alias("b"))
    return best.select("doc_id", F.col("b.term").alias("term"), F.col("b.df").alias("df"), F.round(_idf(n, F.col("b.df")), 6).alias("idf")).orderBy(F.desc("idf"), "doc_id").limit(k)


def _idf(n: int, df: Column) -> Column:
    return F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))


# --- substrings ---------------------------------------------------------------------------------------------------------------------


def required_grams(pattern: str, ignore_case: bool = False) -> list[str] | None:
    """Byte trigrams (folded) that any match of a LIKE pattern holds; None where there is nothing to look for."""
    if ignore_case and any(ord(c) > 127 for c in pattern):
        return None
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1  # a lone one at the end ends the pattern
            run += pattern[i : i + 1]
        elif c in "%_":
            runs.append(run)
            run = ""
        else:
            run += c
        i += 1
    grams = set()
    for r in [*runs, run]:
        b = bytes(x + 32 if 65 <= x <= 90 else x for x in r.encode())
        grams.update(b[k : k + 3].hex() for k in range(len(b) - 2))
    return sorted(grams) or None


def like_to_regex(pattern: str) -> str:
    """An anchored regular expression of a LIKE pattern with backslash escapes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            c = pattern[i]
        elif c in "%_":
            out += ".*" if c == "%" else "."
            i += 1
            continue
        out += "\\" + c if c in r".^$*+?()[]{}|\/-" else c
        i += 1
    return f"(?s)^{out}$"


def contains_like(table: DataFrame, column: str, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Rows whose text matches; plain LIKE is pushed to the scan as a prefix or substring test where it can be."""
    c = F.col(column)
    return table.where(c.ilike(pattern) if ignore_case else c.like(pattern))


def gram_index(table: DataFrame, column: str, id_column: str) -> DataFrame:
    """(gram, id): distinct folded byte trigrams of each row, as hex."""
    b = F.hex(F.translate(F.col(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary"))
    n = (F.length(b) / 2).cast("int")
    grams = F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.lower(F.substr(b, 2 * i + 1, F.lit(6)))))).otherwise(F.array().cast("array<string>"))
    return table.where(F.col(column).isNotNull()).select(F.explode(grams).alias("gram"), id_column)


def like_by_grams(table: DataFrame, index: DataFrame, column: str, id_column: str, pattern: str, ignore_case: bool = False) -> DataFrame:
    """As ``contains_like``, reading only rows that hold every required gram; the answer is the same."""
    grams = required_grams(pattern, ignore_case)
    if grams is None:
        return contains_like(table, column, pattern, ignore_case)
    found = index.where(F.col("gram").isin(grams)).groupBy(id_column).agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    return contains_like(table.join(found.select(id_column), id_column, "left_semi"), column, pattern, ignore_case)


# --- trigram similarity -------------------------------------------------------------------------------------------------------------


def word_trigrams(text: Column) -> Column:
    """Distinct trigrams of each word padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^0-9a-z\x{80}-\x{10FFFF}]+"), lambda w: w != "")
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, one)))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of word trigrams; 0 where neither has any."""
    x, y = word_trigrams(a), word_trigrams(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(either > 0, both.cast("double") / either).otherwise(0.0))


def _extents(text: Column) -> Column:
    """Trigrams of every run of words of a text."""
    words = F.filter(F.split(F.lower(text), r"[^0-9a-z\x{80}-\x{10FFFF}]+"), lambda w: w != "")
    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(words, i, k), " "))))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<string>"))


def strict_word_similarity(a: Column, b: Column) -> Column:
    """Largest similarity of a with a run of whole words of b."""
    best = F.array_max(F.transform(_extents(b), lambda e: similarity(a, e)))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(best, F.lit(0.0)))


def word_similarity(a: Column, b: Column) -> Column:
    """Largest share of a's trigrams that a run of words of b holds."""
    x = word_trigrams(a)
    best = F.array_max(F.transform(_extents(b), lambda e: F.size(F.array_intersect(x, word_trigrams(e))).cast("double")))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(F.size(x) > 0, F.coalesce(best, F.lit(0.0)) / F.size(x)).otherwise(0.0))


