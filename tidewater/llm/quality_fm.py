"""Quality classifier: a factorisation machine over hashed words and text structure.

Features of a text are its words (lower-cased, hashed into BUCKETS, weighted by
damped frequency and scaled to unit length) and structure statistics and
metadata of the text itself (lengths, shares of character classes, repetition),
each also one hashed feature.  Score = sigmoid(b + sum w_i x_i + pairwise),
with the pairwise term by the identity
  sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
so a text costs time linear in its distinct words.

Training takes at most MAX_TRAIN labelled rows, those with the smallest hash of
their id (a documented, deterministic bound; ids pick rows and are never
inputs), on the driver; scoring is row-local over all documents with a model of
fixed size (BUCKETS * (RANK + 1) floats).

Defined results: null text counts as empty and gets a score like any other;
without labels every score is 0.5 and predicted is 1; labels other than 0 and 1
are ignored, and an id with labels of both kinds counts as 0; rows that repeat
an id, or have none, are each scored (held_out is false without an id); an
empty table gives an empty result; extra columns are not read (keep_good returns
them as they are); a very long text is scored whole, with memory for its words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import id_text, pieces, table

WORD = re.compile(r"[^ \t-\r]+")
BUCKETS = 1 << 16
RANK = 8
MAX_TRAIN = 8_000
CACHE = 200_000
SYMBOLS = "#*$%&|<>!?@{}[]\\/_=+~^;:,.\"'()-"


class _Buckets(dict):
    """word -> bucket, remembered for the commonest words only by virtue of being emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        at = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        self[word] = at
        return at


def _slot(name: str) -> int:
    return zlib.crc32(b"\x00" + name.encode()) % BUCKETS


STRUCTURE = ("chars", "words", "word length", "upper", "digits", "non-ascii", "distinct words", "twice running", "top word", "lines", "dup lines", "line length", "capital words", *(f"sign {c}" for c in SYMBOLS))
STRUCTURE_SLOTS = np.array([_slot(x) for x in STRUCTURE], np.int64)


def structure(text: str, words: list[str]) -> np.ndarray:
    """Statistics of the text, each about 0 to 1."""
    n, c = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    ascii_part = text.encode("ascii", "ignore")
    upper = sum(map(str.isupper, words))
    out = [
        np.log1p(len(text)) / 12,
        np.log1p(len(words)) / 10,
        min(1.0, sum(map(len, words)) / n / 20),
        upper / n,
        sum(ascii_part.count(d) for d in b"0123456789") / c,
        1 - len(ascii_part) / c,
        len(counts) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        max(counts.values(), default=0) / n,
        np.log1p(len(lines)) / 8,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, c / max(1, len(lines)) / 1000),
        sum(w[0].isupper() for w in words) / n,
    ]
    out += [min(1.0, 5 * text.count(x) / n) for x in SYMBOLS]
    return np.array(out, np.float32)


def features(text: str, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature indexes and their values."""
    words = WORD.findall(text)
    at, count = np.unique(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), return_counts=True)
    x = np.log1p(count).astype(np.float32)
    if len(x):
        x /= np.linalg.norm(x)
    return np.concatenate([at, STRUCTURE_SLOTS]), np.concatenate([x, structure(text, words)])


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @classmethod
    def blank(cls) -> FactorisationMachine:
        return cls(0.0, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, RANK), np.float32))

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        s = v.sum(0)
        return self.bias + float(self.weights[at] @ x) + 0.5 * float(s @ s - np.einsum("ij,ij->", v, v))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(at, x), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on the logistic loss; both classes weigh the same in total."""
    model = FactorisationMachine.blank()
    if not len(rows):
        return model
    rng = np.random.default_rng(seed)
    model.factors = rng.normal(0, 0.01, (BUCKETS, RANK)).astype(np.float32)
    y = np.asarray(labels, np.float32)
    share = y.mean()
    if share in (0.0, 1.0):
        model.bias, model.factors[:] = (4.0 if share else -4.0), 0
        return model
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    gw, gv, gb = np.full(BUCKETS, 1e-6, np.float32), np.full((BUCKETS, RANK), 1e-6, np.float32), 1e-6
    lengths = np.array([len(a) for a, _ in rows])
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            take = order[k : k + batch]
            at, x = np.concatenate([rows[i][0] for i in take]), np.concatenate([rows[i][1] for i in take])
            starts = np.concatenate([[0], np.cumsum(lengths[take])[:-1]])
            row = np.repeat(np.arange(len(take)), lengths[take])
            v = model.factors[at]
            vx = v * x[:, None]
            s = np.add.reduceat(vx, starts)
            raw = model.bias + np.add.reduceat(model.weights[at] * x, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[take]) * weight[take] / len(take)
            e = err[row] * x
            used, back = np.unique(at, return_inverse=True)
            by = np.argsort(back, kind="stable")
            edges = np.searchsorted(back[by], np.arange(len(used)))
            dw = np.add.reduceat(e[by], edges) + decay * model.weights[used]
            dv = np.add.reduceat((e[:, None] * (s[row] - vx))[by], edges) + decay * model.factors[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            db = float(err.sum())
            gb += db * db
            model.weights[used] -= rate * dw / np.sqrt(gw[used])
            model.factors[used] -= rate * 0.5 * dv / np.sqrt(gv[used])
            model.bias -= rate * db / gb**0.5
    return model


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> tuple[list, np.ndarray]:
    """Features and labels of at most `limit` labelled documents that aren't held out."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    # at most `limit` rows, so this side can be broadcast
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = id_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            quality = batch.column(2).to_pylist()
            rows = [features(t or "", buckets) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.astype(np.int32).tobytes() for a, _ in rows]), pa.array([x.tobytes() for _, x in rows]), pa.array(quality, pa.int32())], ["doc_id", "at", "x", "quality"])

    found = sorted(texts.mapInArrow(run, "doc_id long, at binary, x binary, quality int").collect())
    return [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(x, np.float32)) for _, a, x, _ in found], np.array([q for *_, q in found], np.float32)


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> FactorisationMachine:
    return fit(*training_rows(docs, labels, limit))


def quality_score(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.factors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, buckets = FactorisationMachine(*shared.value), _Buckets()
        for batch in batches:
            for ids, texts in pieces(batch):
                yield pa.RecordBatch.from_arrays([ids, pa.array([own.score(*features(t, buckets)) for t in texts], pa.float64())], ["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The input rows, all columns, whose score is at least `least`; row-local, no join."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.factors))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, buckets = FactorisationMachine(*shared.value), _Buckets()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                good = [own.score(*features(t or "", buckets)) >= least for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
