"""Language identification by hierarchical discrimination.

A text's language family is chosen first by one-against-rest linear support vector machines; inside the family,
one-versus-one linear support vector machines separate the related languages and vote.  Features are hashed byte
trigrams of the whole text, as relative frequencies, so a text's decision value is the mean weight of its trigrams
and one table look-up per byte is all that prediction costs.

Defined results: a null text or a text without a letter is ``und`` with score 0; a text whose language family has
one language takes that language; ties go to the alphabetically first value; with no labelled row everything is
``und``; rows that repeat are predicted alike and learned from once; a null id is in no fold: it is predicted, with
``held_out`` false, and never learned from; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm._batches import flat, runs, ship, two

#: Language families by ISO 639-1 code.  A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
}
BITS = 14
SCALE = 20.0


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in range(26):
    _FOLD[65 + _c] = _FOLD[97 + _c] = 97 + _c


def trigrams(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed byte trigrams of every text (letters lower-cased, the rest of ASCII as blanks), and where each text's lie."""
    data, starts, ends = flat(texts)
    n = len(starts)
    low = _FOLD[data]
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    low[upper] += 0x20
    padded = np.full(len(low) + 2 * n + 2, 32, np.uint8)
    padded[np.arange(len(low)) + np.repeat(2 * np.arange(n) + 1, ends - starts)] = low
    b = padded.astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - bits)
    first = starts + 2 * np.arange(n)
    return code, first, first + (ends - starts)


def _per_text(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (total[last] - total[first]) / np.maximum(last - first, 1)


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = 4.0, rounds: int = 25, seed: int = 7) -> np.ndarray:
    """Dual coordinate descent for a linear support vector machine with squared hinge loss; the last weight is the bias."""
    w = np.zeros(size + 1)
    alpha, diag = np.zeros(len(rows)), 0.5 / cost
    square = np.array([float(v @ v) + 1 for _, v in rows]) + diag
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        for i in order:
            at, v = rows[i]
            g = y[i] * (w[at] @ v + w[-1]) - 1 + diag * alpha[i]
            new = max(alpha[i] - g / square[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
    return w


@dataclass
class LanguageModel:
    langs: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    family_w: np.ndarray | None = None
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        code, first, last = trigrams(texts)
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        margin = lambda w: SCALE * _per_text(w[:-1].astype(np.float32)[code], first, last) + w[-1]
        sure = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
        if len(self.families) > 1:
            p = np.stack([sure(margin(w)) for w in self.family_w])
            p /= p.sum(0)
        else:
            p = np.ones((1, n))
        chosen = p.argmax(0)
        out, score = np.full(n, "und", object), np.zeros(n)
        for f, family in enumerate(self.families):
            own = [x for x in self.langs if family_of(x) == family]
            votes, belief = np.zeros((len(own), n)), np.zeros((len(own), n))
            for a, b in combinations(range(len(own)), 2):
                q = sure(margin(self.pairs[own[a], own[b]]))
                votes[a] += q >= 0.5
                votes[b] += q < 0.5
                belief[a] += q
                belief[b] += 1 - q
            rank = votes + belief / (2 * len(own))
            best = rank.argmax(0)
            inside = belief[best, np.arange(n)] / max(len(own) - 1, 1) if len(own) > 1 else np.ones(n)
            here = letters & (chosen == f)
            out[here] = np.array(own, object)[best[here]]
            score[here] = (p[f] * inside)[here]
        return out.tolist(), score


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def learnable(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull())


def share_of(counts: dict[str, int], rows: int) -> Column:
    """For each value of ``lang`` the share of its rows that a sample of ``rows`` takes.

    The branches stand side by side: one inside the other, some hundred labels would overflow Spark's stack.
    """
    return reduce(lambda of, x: of.when(F.col("lang") == x[0], F.lit(rows / x[1])), counts.items(), F).otherwise(0.0)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 400) -> LanguageModel:
    """Fit on labelled rows outside fold 2; rows without an id belong to no fold and are left out.

    ``rows_per_language`` bounds the sample: from each value of the label at most that many rows are
    expected, chosen by a hash of id and text; rows that repeat both count once.
    """
    rows = learnable(docs, text_col, lang_col).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 2))
    ship(docs.sparkSession)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a value of the label
    if not counts:
        return LanguageModel()
    share = share_of(counts, rows_per_language)
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    picked = rows.where(F.pmod("key", F.lit(1 << 30)) < share * (1 << 30)).select("lang", "key", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            code, first, last = trigrams(batch.column("text"))
            at, times = [], []
            for a, b in zip(first, last, strict=True):
                u, c = np.unique(code[a:b], return_counts=True)
                at.append(u.astype("<u2").tobytes())
                times.append((c * (SCALE / max(b - a, 1))).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("key"), pa.array(at, pa.binary()), pa.array(times, pa.binary())], ["lang", "key", "at", "times"])

    once = picked.mapInArrow(features, "lang string, key long, at binary, times binary").groupBy("lang", "key").agg(F.min(F.struct("at", "times")).alias("x"))
    got = sorted((r["lang"], bytes(r["x"]["at"]), bytes(r["x"]["times"])) for r in once.collect())
    labels = np.array([r[0] for r in got], object)
    vectors = [(np.frombuffer(r[1], "<u2").astype(np.int64), np.frombuffer(r[2], "<f4").astype(np.float64)) for r in got]
    langs = sorted(set(labels.tolist()))
    families = sorted({family_of(x) for x in langs})
    of_family = np.array([family_of(x) for x in labels], object)
    model = LanguageModel(langs, families)
    if len(families) > 1:
        model.family_w = np.stack([train_svm(vectors, np.where(of_family == f, 1.0, -1.0), 1 << BITS) for f in families])
    for a, b in combinations(langs, 2):
        if family_of(a) == family_of(b):
            own = [i for i, x in enumerate(labels) if x in (a, b)]
            model.pairs[a, b] = train_svm([vectors[i] for i in own], np.where(labels[own] == a, 1.0, -1.0), 1 << BITS)
    return model


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            lang, score = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    out = two(docs, id_col, text_col).mapInArrow(work, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (F.coalesce(fold_of(F.col("doc_id")), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: LanguageModel, *, least: float = 0.25, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a score of ``least`` or more."""
    ship(docs.sparkSession)
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, text_col):
            lang, score = shared.value.predict(batch.column(text_col))
            kept = np.array([x != "und" for x in lang]) & (score >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names], names).filter(pa.array(kept))

    return docs.mapInArrow(work, docs.schema)
