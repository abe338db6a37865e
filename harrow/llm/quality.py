"""A quality classifier by positive-unlabelled learning.

A linear model on features of the whole text (shares of kinds of bytes, repetition of words and word runs, and shares of hashed byte
pairs) is fitted to trusted positives and unlabelled text by minimising the non-negative unbiased risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

with the logistic loss. The class prior is estimated from positives and unlabelled texts alone: models are fitted to halves of both, and on the
other half the share of unlabelled texts above a score, over that of positives, is smallest where only positives score so high; that least ratio is the
prior. Known negatives are used for nothing, but for ``labelled_share``, which is reported beside the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_bytes
from .textbytes import WINDOW, chunks, shingles_of, words_of

#: Hashed byte pairs; and the most positives and the most unlabelled texts that a fit takes, those whose hashed ids are smallest.
PAIRS, SAMPLE = 512, 5000
#: Bytes that a text's pair counts are shrunk by, so that few pairs of a short text don't decide.
SHRINK = 200
STEPS, RATE, PENALTY = 400, 0.05, 1e-3
_KINDS = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b".,", b"!", b"?;:'\"-()", b"|", b"#$%&*", bytes(range(128, 256))), 1):
    _KINDS[list(_chars)] = _k
_N_KINDS = 12


def features(texts: list[bytes | None]) -> np.ndarray:
    """A row of features for each text; null counts as empty."""
    n = len(texts)
    size = np.array([len(t or b"") for t in texts], dtype=np.int64)
    buf = np.frombuffer(b"".join(t or b"" for t in texts), dtype=np.uint8)
    per = 1 / np.maximum(1, size)[:, None]
    kinds, pairs, ends = np.zeros(n * _N_KINDS, dtype=np.int64), np.zeros(n * PAIRS, dtype=np.int64), np.cumsum(size)
    for a in range(0, len(buf), WINDOW):  # memory follows the window, not the text
        own = buf[a : a + WINDOW + 1]
        doc = np.repeat(np.arange(n), np.diff(np.clip(ends, a, a + len(own)), prepend=a))
        kinds += np.bincount(doc[:WINDOW] * _N_KINDS + _KINDS[own[:WINDOW]], minlength=n * _N_KINDS)
        pair = (own[:-1].astype(np.uint32) * 256 + own[1:]) * np.uint32(2654435761) >> np.uint32(23)
        pairs += np.bincount((doc[1:] * PAIRS + pair)[doc[1:] == doc[:-1]], minlength=n * PAIRS)
    kinds = kinds.reshape(n, _N_KINDS) * per
    pairs = pairs.reshape(n, PAIRS) / (size + SHRINK)[:, None]
    word_doc, start, end, h = words_of(texts)
    words = np.bincount(word_doc, minlength=n)
    runs_doc, runs = shingles_of(word_doc, h, n, 3)
    few = np.maximum(1, words)

    def distinct(d: np.ndarray, v: np.ndarray) -> np.ndarray:
        order = np.lexsort((v, d))
        d, v = d[order], v[order]
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
        return np.bincount(d[new], minlength=n)

    n_runs = np.bincount(runs_doc, minlength=n)
    again = (word_doc[1:] == word_doc[:-1]) & (h[1:] == h[:-1])
    stutter = np.sqrt(np.bincount(word_doc[1:][again], minlength=n) / few)
    dense = np.column_stack((np.log1p(size), np.log1p(words), np.bincount(word_doc, weights=end - start, minlength=n) / few, distinct(word_doc, h) / np.sqrt(few), distinct(runs_doc, runs) / np.maximum(1, n_runs), stutter, size == 0, words == 0))
    return np.concatenate((dense, np.sqrt(kinds), np.sqrt(pairs)), axis=1).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float
    #: The share of positives among the labels of the fitting side: reported, not used.
    labelled_share: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-z.clip(-60, 60)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """Adam on the non-negative unbiased risk; where the part that must not be negative is, its gradient is followed back up."""
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    p, u = (((x - mean) / scale).clip(-8, 8).astype(np.float32) for x in (positive, unlabelled))
    p, u = (np.concatenate((x, np.ones((len(x), 1), dtype=np.float32)), axis=1) for x in (p, u))
    w = np.zeros(p.shape[1], dtype=np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-z.clip(-60, 60)))
    for step in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        negative = u.T @ sigmoid(zu) / len(u) - prior * (p.T @ sigmoid(zp)) / len(p)
        if as_negative < 0:
            g = -negative
        else:
            g = -prior * (p.T @ sigmoid(-zp)) / len(p) + negative
        g = g + penalty * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - rate * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.2, rounds: int = 2) -> float:
    """The class prior of ``unlabelled``, within 0.05 to 0.95: the least ratio of the shares of unlabelled and of positive texts above a score, over
    scores that a share ``least`` of the positives reach. Each half is scored by a model of the other; the estimate of a round is the prior that the
    next round's models are fitted with, as better models overestimate less."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    prior = 0.5
    for _ in range(rounds):
        found = []
        for own, other in ((0, 1), (1, 0)):
            model = fit_nnpu(positive[own::2], unlabelled[own::2], prior)
            found.append(_least_ratio(model.scores(positive[other::2]), model.scores(unlabelled[other::2]), least))
        prior = float(min(0.95, max(0.05, sum(found) / 2)))
    return prior


def _least_ratio(p: np.ndarray, u: np.ndarray, least: float) -> float:
    p, u = np.sort(p), np.sort(u)
    cuts = np.unique(np.quantile(p, np.linspace(0, 1 - least, 81)))
    above_p, above_u = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
    # what chance allows is added before the least is chosen, so that a small top bin doesn't decide
    slack = np.sqrt(above_u * (1 - above_u) / len(u)) + np.sqrt(above_p * (1 - above_p) / len(p))
    best = int(np.argmin((above_u + slack) / np.maximum(above_p, 1e-9)))
    return float(above_u[best] / max(above_p[best], 1e-9))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_quality(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits to at most ``sample`` positives and ``sample`` unlabelled texts of the side that is not held out.

    ``sample`` bounds what the fit holds; the choice is by a hash of the id, and of the rows of one id that with the smallest hash of its text is taken. Without
    any positive the model gives 0.5 to every text. Rows with a null id or label teach nothing; a null text counts as empty; other columns are ignored.
    """
    spark = documents.sparkSession
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id")))
    count, share = known.agg(F.count("*"), F.avg(F.when(F.col("y") == 1, 1.0).otherwise(0.0))).first()
    order = F.xxhash64(F.col("id").cast("string"), F.lit("sample"))
    chosen = known.where("y = 1").select("id").distinct().orderBy(order, "id").limit(sample).withColumn("side", F.lit(1))
    every = documents.select(F.col(id_column).alias("id")).where("id is not null").where(~held_out(F.col("id"))).distinct().orderBy(order, "id").limit(sample).withColumn("side", F.lit(0))
    sides = chosen.unionByName(every).groupBy("id").agg(F.max("side").alias("positive"), (F.min("side") == 0).alias("unlabelled"))  # at most 2 * sample rows
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text")).join(F.broadcast(sides), "id")
    texts = texts.groupBy("id", "positive", "unlabelled").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("positive", "unlabelled", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            values = batch.column(2).to_pylist()
            rows = [r.tobytes() for a, b in chunks(values) for r in features(values[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["positive", "unlabelled", "x"])

    got = texts.mapInArrow(run, "positive int, unlabelled boolean, x binary").collect()  # at most 2 * sample rows
    width = len(features([b"a"])[0])
    matrix = np.frombuffer(b"".join(bytes(r.x) for r in got), dtype=np.float32).reshape(-1, width)
    p = matrix[[r.positive == 1 for r in got]] if got else matrix
    u = matrix[[bool(r.unlabelled) for r in got]] if got else matrix
    if not len(p) or not len(u):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.5, share)
    # a fixed order of rows, so that sums round alike
    mixed = lambda x: x[np.lexsort(x.T[:3])][np.random.default_rng(0).permutation(len(x))]
    p, u = mixed(p), mixed(u)
    model = fit_nnpu(p, u, estimated_prior(p, u))
    model.labelled_share = share
    return model


def score_quality(documents: DataFrame, model: Model, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``documents`` with a column ``score_column`` (0 to 1; higher: better quality likelier) of the whole text; a column of that name is replaced.

    A null text counts as empty; both have a score. All rows and other columns stay as they are. An empty table gives an empty result.
    """
    rows = documents.drop(score_column)
    schema = T.StructType([*rows.schema.fields, T.StructField(score_column, T.DoubleType())])
    at = rows.columns.index(text_column)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, at):
            values = batch.column(at).cast(pa.binary()).to_pylist()
            scores = [np.zeros(0)] + [held.value.scores(features(values[a:b]).astype(np.float64)) for a, b in chunks(values)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores), pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)
