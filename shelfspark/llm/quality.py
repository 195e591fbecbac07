"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k | text) = sigmoid(w.x - t_k) with one shared weight vector ``w`` over hashed text features and ordered
thresholds ``t_1 < t_2 < ...``, which are fitted as the first one and the logarithms of the gaps, so they stay ordered
for any number of grades.  From these come the expected grade and the tail probability used for selection.
Features are the distinct tokens of the whole text (runs of word bytes and runs of symbols) and a few bucketed
shape tokens (repetition, share of symbols, variety).  Weights are fitted by FTRL-proximal steps, whose L1 term
keeps words seen by chance at zero, so long texts gain no noise.

Defined results: a null or empty text has no evidence and gets grade 0 with tail probability 0; with no rated row
every text gets the prior of one grade (expected grade 0); repeated rows are rated alike, and of rows that repeat a
rated id one is learned from; a null id is never learned from; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm._batches import flat, runs, ship, two

BITS = 18
#: The probability of the highest grade from which a document is kept.
LEAST = 0.35
SHAPES = 4096  # the last places of the table hold shape tokens
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[128:] = 1
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _KIND[_a:_b] = 1
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += 32
_POWER = np.array([pow(0x100000001B3, i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)


def tokens(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token (a run of bytes of one kind inside one text): its hash, its kind and its text."""
    kind = _KIND[data]
    edge = np.ones(len(data), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[starts[starts < len(data)]] = True
    at = np.flatnonzero(edge)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
    place = np.arange(len(data)) - np.repeat(at, np.diff(np.append(at, len(data))))
    h = np.add.reduceat(_LOW[data] * _POWER[place & 63], at)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    text = np.searchsorted(ends, at, side="right")
    real = kind[at] > 0
    return h[real], kind[at][real], text[real]


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) places, as two arrays sorted by text."""
    data, starts, ends = flat(texts)
    n = len(starts)
    h, kind, text = tokens(data, starts, ends)
    size = 1 << bits
    word = kind == 1
    wh, wt = h[word], text[word]
    same = np.zeros(len(wh), bool)
    same[1:] = (wh[1:] == wh[:-1]) & (wt[1:] == wt[:-1])
    words = np.maximum(np.bincount(wt, minlength=n), 1)
    key = np.unique((text.astype(np.uint64) << np.uint64(bits)) | (h % np.uint64(size - SHAPES)))
    at, place = (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64(size - 1)).astype(np.int64)
    variety = np.bincount(at, minlength=n) / np.maximum(np.bincount(text, minlength=n), 1)
    shapes = (
        np.minimum(np.bincount(wt[same], minlength=n) / words * 20, 9),
        np.minimum(np.bincount(text[~word], minlength=n) / words * 10, 15),
        np.minimum(variety * 10, 9) + 10 * np.minimum(np.log2(words), 15).astype(int),
    )
    full = np.flatnonzero(ends > starts)
    extra = [size - SHAPES + 512 * i + s[full].astype(np.int64) for i, s in enumerate(shapes)]
    at, place = np.concatenate([at, *[full] * len(extra)]), np.concatenate([place, *extra])
    order = np.argsort(at, kind="stable")
    return at[order], place[order]


@dataclass
class OrdinalModel:
    w: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) by text (rows) and k (columns 1, 2, ...)."""
        at, place = features(texts)
        n = len(texts)
        eta = np.bincount(at, weights=self.w[place], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(eta[:, None] - self.thresholds[None, :], -30, 30)))
        p[np.bincount(at, minlength=n) == 0] = 0
        return p


def ordered(u: np.ndarray) -> np.ndarray:
    """Thresholds from the first one and the logarithms of the gaps."""
    return np.cumsum(np.concatenate([u[:1], np.exp(u[1:])]))


def train(rows: list[np.ndarray], grades: np.ndarray, levels: int, *, bits: int = BITS, rounds: int = 12, batch: int = 128, rate: float = 0.3, l1: float = 0.6, seed: int = 11) -> OrdinalModel:
    """Mini-batch FTRL-proximal for the weights of the cumulative-link likelihood, adaptive steps for the thresholds."""
    z, sq = np.zeros(1 << bits), np.zeros(1 << bits)
    w = np.zeros(1 << bits)
    share = np.array([(grades >= k).mean() for k in range(1, levels)]).clip(0.02, 0.98)
    start = np.log((1 - share) / share)
    u_t = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])  # the first threshold, then log gaps
    t, t_sq = ordered(u_t), np.ones(levels - 1)
    weight = np.array([len(grades) / (levels * max((grades == g).sum(), 1)) for g in range(levels)])
    rng, order = np.random.default_rng(seed), np.arange(len(rows))
    for _ in range(rounds):
        rng.shuffle(order)
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            place = np.concatenate([rows[i] for i in own])
            of = np.repeat(np.arange(len(own)), [len(rows[i]) for i in own])
            eta = np.bincount(of, weights=w[place], minlength=len(own))
            y = grades[own]
            cut = np.concatenate([[-np.inf], t, [np.inf]])
            hi = 1 / (1 + np.exp(np.clip(cut[y][:, None][:, 0] - eta, -30, 30)))  # P(grade >= y)
            lo = 1 / (1 + np.exp(np.clip(cut[y + 1] - eta, -30, 30)))  # P(grade >= y + 1)
            p = np.maximum(hi - lo, 1e-6)
            d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
            d_hi[y == 0], d_lo[y == levels - 1] = 0, 0
            g_eta = -weight[y] * (d_hi - d_lo) / p
            g_t = np.bincount(y, weights=weight[y] * d_hi / p, minlength=levels)[1:] - np.bincount(y + 1, weights=weight[y] * d_lo / p, minlength=levels + 1)[1:levels]
            u, back = np.unique(place, return_inverse=True)
            g = np.bincount(back, weights=g_eta[of])
            step = (np.sqrt(sq[u] + g * g) - np.sqrt(sq[u])) / rate
            z[u] += g - step * w[u]
            sq[u] += g * g
            w[u] = np.where(np.abs(z[u]) <= l1 * batch**0.5, 0, -(z[u] - np.sign(z[u]) * l1 * batch**0.5) / ((1 + np.sqrt(sq[u])) / rate))
            later = np.cumsum(g_t[::-1])[::-1]  # a gap moves all thresholds from its own on
            g_u = np.concatenate([later[:1], later[1:] * np.exp(u_t[1:])])
            t_sq += g_u * g_u
            u_t = u_t - rate * g_u / np.sqrt(t_sq)
            u_t[1:] = np.clip(u_t[1:], -7, 4)
            t = ordered(u_t)
    return OrdinalModel(w, t)


def fit(docs: DataFrame, grades: DataFrame, *, text_col: str = "text", grade_col: str = "grade", id_col: str = "doc_id", rows_per_grade: int = 4000) -> OrdinalModel:
    """Fit on the documents that ``grades`` (rows of an id and a grade 0, 1, 2, ...) has a grade of.

    ``rows_per_grade`` bounds the sample: of each grade that many ids are expected, chosen by a hash of the id, and only
    those few ids are sent to the documents, so no text is shuffled.  Of rows that repeat an id one comes to the driver.
    """
    ship(docs.sparkSession)
    ids = grades.select(grades[id_col].cast("long").alias("doc_id"), grades[grade_col].cast("int").alias("grade")).where("doc_id is not null and grade is not null")
    ids = ids.groupBy("doc_id").agg(F.min("grade").alias("grade"))  # of several grades the lowest
    counts = {r["grade"]: r["n"] for r in ids.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if not counts or max(counts) == 0:
        return OrdinalModel(np.zeros(1 << BITS), np.array([30.0]))
    share = F.lit(0.0)
    for grade, n in counts.items():
        share = F.when(F.col("grade") == grade, F.lit(rows_per_grade / n)).otherwise(share)
    sample = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    picked = two(docs, id_col, text_col).where("text is not null").join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            at, place = features(batch.column("text"))
            cut = np.searchsorted(at, np.arange(batch.num_rows + 1))
            places = [place[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(places, pa.binary())], ["doc_id", "grade", "places"])

    one = picked.mapInArrow(work, "doc_id long, grade int, places binary").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("places").alias("places"))
    got = sorted((r["grade"], bytes(r["places"])) for r in one.collect())
    if len({g for g, _ in got}) < 2:
        return OrdinalModel(np.zeros(1 << BITS), np.array([30.0] * max(counts)))
    return train([np.frombuffer(r[1], "<u4").astype(np.int64) for r in got], np.array([r[0] for r in got]), max(counts) + 1)


def rate(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expected_grade, tail_prob, grade``: tail_prob is the probability of the highest grade."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            p = shared.value.tails(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p.sum(1)), pa.array(p[:, -1].copy()), pa.array((p >= 0.5).sum(1).astype(np.int32))], ["doc_id", "expected_grade", "tail_prob", "grade"])

    return two(docs, id_col, text_col).mapInArrow(work, "doc_id long, expected_grade double, tail_prob double, grade int")


def keep_good(docs: DataFrame, model: OrdinalModel, *, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose probability of the highest grade is ``least`` or more."""
    ship(docs.sparkSession)
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, text_col):
            p = shared.value.tails(batch.column(text_col))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names], names).filter(pa.array(p[:, -1] >= least))

    return docs.mapInArrow(work, docs.schema)
