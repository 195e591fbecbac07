"""Collocations: phrases whose words stand together more often than their parts would.

A shard of the texts becomes a count trie of limited depth: level 0 is the language, level d holds the phrases of d words.
Levels are sorted arrays of (parent, word) with counts, so a trie is serialised sorted, cut at the bounds of prefix ranges,
and the runs of all shards are merged range by range.  A range that begins inside a subtree also gets the nodes above its
first phrase (the proper prefixes of its bound, at most one a level), so that walking up from a phrase to its left parts
never leaves the range.  A phrase's right parts are its suffix links; they point to any range and are a join.

A phrase of three or four words can't be more frequent than the pairs in it.  A first pass therefore counts pairs only, and
the frequent ones set bits of a table of fixed size; the second, deep pass leaves out windows whose pairs aren't set.  Two
pairs on one bit cost work, never a result: all counts are exact, and no phrase at or above the bound is lost.

Defined results: a null text counts as empty; a null language is ``und``; repeated rows count as often as they stand there;
phrases never go over a separator or from one text into the next; an empty table, or one without frequent phrases, gives no
rows; ids and other columns are not read.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm._batches import runs, saved, ship
from shelfspark.llm.skew import salted

#: Separators of pieces all become a full stop, a tab a space, capitals A-Z small letters.
_TABLE = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
SHARD_BYTES, RANGE_BYTES, FILTER_BITS = 6 << 20, 8 << 20, 27
DEPTH = 4


def words_of(texts: list[str]) -> pa.Array:
    """The words of all texts in order, with a full stop at each end of a piece and of a text."""
    data = ".".join(texts).encode().translate(_TABLE).replace(b".", b" . ") + b" . "
    return pc.ascii_split_whitespace(pa.array([data.decode()], pa.large_string())).values


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each row's place among them, the sorting order and where each key begins in it."""
    order = np.argsort(key)
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return s[starts], place, order, starts


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a ^ (b * np.uint64(0x9E3779B97F4A7C15) + (a << np.uint64(6)) + (a >> np.uint64(2)))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


class Trie:
    """``langs``, sorted ``words`` and, for each level, ``parent, word, count`` in sorted order."""

    def __init__(self, texts: dict[str, list[str]], depth: int, pairs: np.ndarray | None = None) -> None:
        self.langs = sorted(texts)
        each = [words_of(texts[x]) for x in self.langs]
        coded = pa.chunked_array(each).combine_chunks() if len(each) > 1 else each[0]
        coded = coded.dictionary_encode()
        by_name = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(by_name), np.int32)
        rank[by_name] = np.arange(len(by_name))
        self.words: list[str] = coded.dictionary.take(pa.array(by_name)).to_pylist()
        ids = rank[coded.indices.to_numpy()]
        lang = np.repeat(np.arange(len(each), dtype=np.int32), [len(x) for x in each])
        del each, coded
        blank, stop = (bisect_left(self.words, x) for x in ("", "."))
        if blank < len(self.words) and self.words[blank] == "":
            lang, ids = lang[ids != blank], ids[ids != blank]
        n, v = len(ids), max(len(self.words), 1)
        is_word = ids != stop
        place = np.arange(n, dtype=np.int32)
        room = np.minimum.accumulate(np.where(is_word, np.int32(n), place)[::-1])[::-1] - place  # words from here to the end of the piece
        if pairs is not None:
            h, of_lang = hashes(self.words), hashes(self.langs)
            some = np.flatnonzero(room >= 2)
            spot = mixed(mixed(of_lang[lang[some]], h[ids[some]]), h[ids[some + 1]]) >> np.uint64(64 - FILTER_BITS)
            frequent = np.zeros(n, bool)
            frequent[some] = (pairs[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
        self.levels = [(np.zeros(len(self.langs), np.int64), np.arange(len(self.langs)), np.bincount(lang[is_word], minlength=len(self.langs)))]
        at = np.flatnonzero(is_word)
        node = lang[at].astype(np.int64)
        for d in range(1, depth + 1):
            if d > 1:
                here = room[at] >= d
                if pairs is not None:
                    here &= frequent[np.minimum(at + d - 2, n - 1)]
                at, node = at[here], node[here]
            key, node, _, starts = grouped(node * v + ids[at + d - 1])
            self.levels.append((key // v, key % v, np.diff([*starts, len(at)])))

    def cuts(self, bound: tuple[str, ...]) -> tuple[list[int], list[bool]]:
        """For each level how many nodes come before ``bound``, and whether the last of them is above it."""
        v, at, above, node = max(len(self.words), 1), [], [], 0
        inside = bool(bound)
        for d, (parent, word, _) in enumerate(self.levels):
            names = self.langs if d == 0 else self.words
            if not inside or len(bound) <= d:
                at.append(0 if not at else int(np.searchsorted(parent, at[-1])))
                above.append(False)
                inside = False
                continue
            r = bisect_left(names, bound[d])
            same = r < len(names) and names[r] == bound[d]
            a, b = (0, len(word)) if d == 0 else np.searchsorted(parent, [node, node + 1])
            spot = int(a + np.searchsorted(word[a:b], r))
            same = same and spot < b and word[spot] == r
            inside = same and len(bound) > d + 1
            at.append(spot + inside)
            above.append(inside)
            node = spot
        return at, above

    def blobs(self, bounds: list[tuple[str, ...]]) -> Iterator[tuple[int, bytes]]:
        """The serialised part of each range that has one; ``bounds`` begins with the empty one."""
        packer = zstandard.ZstdCompressor(level=1)
        low, above = self.cuts(bounds[0])
        for i in range(len(bounds)):
            high, next_above = self.cuts(bounds[i + 1]) if i + 1 < len(bounds) else ([len(x[0]) for x in self.levels], [])
            a = [x - y for x, y in zip(low, above, strict=True)]
            if any(x < y for x, y in zip(a, high, strict=True)):
                used = np.unique(np.concatenate([w[x:y] for (_, w, _), x, y in zip(self.levels[1:], a[1:], high[1:], strict=True)]))
                parts = []
                for d, ((parent, word, count), x, y) in enumerate(zip(self.levels, a, high, strict=True)):
                    own = parent[x:y] - (a[d - 1] if d else 0)
                    parts.append([np.diff(own, prepend=0).astype("<i4").tobytes(), (np.searchsorted(used, word[x:y]) if d else word[x:y] - x).astype("<i4").tobytes(), count[x:y].astype("<i8").tobytes()])
                yield i, packer.compress(pickle.dumps((self.langs[a[0] : high[0]], "\n".join(self.words[j] for j in used), above, parts)))
            low, above = high, next_above


class Merged:
    """The merged trie of one range: ``levels`` of ``parent, word, count, above``."""

    def __init__(self, blobs: list[bytes]) -> None:
        unpack = zstandard.ZstdDecompressor()
        got = [pickle.loads(unpack.decompress(b)) for b in blobs]
        self.langs = sorted({x for langs, *_ in got for x in langs})
        lists = [words.split("\n") if words else [] for _, words, *_ in got]
        coded = pa.array([w for x in lists for w in x], pa.large_string()).dictionary_encode()
        by_name = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(by_name), np.int64)
        rank[by_name] = np.arange(len(by_name))
        self.words = coded.dictionary.take(pa.array(by_name))
        to_word = np.split(rank[coded.indices.to_numpy()] if len(rank) else np.zeros(0, np.int64), np.cumsum([len(x) for x in lists])[:-1])
        v, to_node = max(len(self.words), 1), [None] * len(got)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for d in range(len(got[0][3])):
            keys, counts = [], []
            for b, (langs, _, _, parts) in enumerate(got):
                parent, word, count = (np.frombuffer(x, t) for x, t in zip(parts[d], ("<i4", "<i4", "<i8"), strict=True))
                keys.append(np.array([bisect_left(self.langs, x) for x in langs], np.int64) if d == 0 else to_node[b][np.cumsum(parent, dtype=np.int64)] * v + to_word[b][word])
                counts.append(count)
            key, place, order, starts = grouped(np.concatenate(keys))
            total = np.add.reduceat(np.concatenate(counts)[order], starts) if len(starts) else np.zeros(0, np.int64)
            to_node = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
            above = np.zeros(len(key), bool)
            above[[x[0] for x, (_, _, is_above, _) in zip(to_node, got, strict=True) if is_above[d] and len(x)]] = True
            self.levels.append((key // v if d else np.zeros(len(key), np.int64), key % v if d else key, total, above))

    def phrases(self, d: int, least: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of the range's own phrases of ``d`` words that stand there ``least`` times: counts, word numbers and the counts of the ways up (left parts, then the language)."""
        parent, word, count, above = self.levels[d]
        own = np.flatnonzero((count >= least) & ~above)
        total, words, left, node = count[own], [word[own]], [], parent[own]
        for up in range(d - 1, 0, -1):
            words.insert(0, self.levels[up][1][node])
            left.insert(0, self.levels[up][2][node])
            node = self.levels[up][0][node]
        return total, [node, *words], [*left, self.levels[0][2][node]]


def tries(docs: DataFrame, bounds: list[tuple[str, ...]], depth: int, pairs: np.ndarray | None) -> DataFrame:
    """``range, blob`` of all shards."""
    shared = docs.sparkSession.sparkContext.broadcast((bounds, pairs))  # at most 16 MB of bits, and the bounds

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, bits = shared.value
        held: dict[str, list[str]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            got = list(Trie(held, depth, bits).blobs(limits)) if held else []
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in got], pa.int32()), pa.array([b for _, b in got], pa.binary())], ["range", "blob"])

        for batch in runs(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
            if size >= SHARD_BYTES:
                yield from flushed()
                held.clear()
                size = 0
        yield from flushed()

    return docs.mapInArrow(work, "range int, blob binary")


def bounds_of(docs: DataFrame, windows: int = 20, texts: int = 2000) -> list[tuple[str, ...]]:
    """Bounds of prefix ranges from windows of about ``texts`` sampled texts; they decide where a phrase is counted, never whether."""
    n = docs.count()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            rows, sizes = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = [w for w in words_of([text]).to_pylist() if w not in ("", ".")]
                rows.append([[lang, *words[i : i + DEPTH]] for i in range(0, len(words), max(1, len(words) // windows))])
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.list_(pa.string()))), pa.array(sizes, pa.int64())], ["windows", "size"])

    picked = docs.sample(min(1.0, texts / n), seed=7) if n else docs
    got = picked.mapInArrow(work, "windows array<array<string>>, size long").collect()
    ranges = max(4, int(n * sum(r["size"] for r in got) / max(len(got), 1)) // RANGE_BYTES)
    found = sorted({tuple(w) for r in got for w in r["windows"]})
    return [(), *sorted({found[i * len(found) // ranges] for i in range(1, ranges)})] if found else [()]


def frequent_pairs(blobs: DataFrame, least: int) -> np.ndarray:
    """The table of bits of all pairs that stand there ``least`` times; 16 MB whatever the input."""

    def work(table: pa.Table) -> pa.Table:
        merged = Merged(table.column("blob").to_pylist())
        _, words, _ = merged.phrases(2, least)
        of_lang = hashes(merged.langs)
        one, two = (hashes(merged.words.take(pa.array(w)).to_pylist()) for w in words[1:])
        spot = mixed(mixed(of_lang[words[0]], one), two) >> np.uint64(64 - FILTER_BITS)
        slot, place, order, starts = grouped((spot >> np.uint64(6)).astype(np.int64))
        bit = np.uint64(1) << (spot & np.uint64(63))
        bits = np.bitwise_or.reduceat(bit[order], starts) if len(starts) else np.zeros(0, np.uint64)
        return pa.table({"slot": slot, "bits": bits.view(np.int64)})

    rows = blobs.groupBy("range").applyInArrow(work, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def phrase_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 30, depth: int = DEPTH) -> DataFrame:
    """``lang, phrase, depth, f, n, lefts``: all phrases of up to ``depth`` words that stand there ``least`` times.

    ``n`` is the number of words of the language; ``lefts`` are the counts of the phrase's first 1, 2, ... words.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    bounds = bounds_of(rows)
    pairs = frequent_pairs(tries(rows, bounds, 2, None), least)

    def work(table: pa.Table) -> pa.Table:
        merged, out = Merged(table.column("blob").to_pylist()), []
        langs = pa.array(merged.langs, pa.string())
        for d in range(1, depth + 1):
            total, words, ups = merged.phrases(d, least)
            names = [merged.words.take(pa.array(w)).cast(pa.string()) for w in words[1:]]
            lefts = np.stack(ups[:-1], 1).reshape(-1) if d > 1 else np.zeros(0, np.int64)
            offsets = pa.array(np.arange(len(total) + 1, dtype=np.int32) * (d - 1))
            out.append(pa.table([langs.take(pa.array(words[0])), pc.binary_join_element_wise(*names, " ") if d > 1 else names[0], pa.array(np.full(len(total), d, np.int32)), pa.array(total), pa.array(ups[-1]), pa.ListArray.from_arrays(offsets, pa.array(lefts))], ["lang", "phrase", "depth", "f", "n", "lefts"]))
        return pa.concat_tables(out)

    return tries(rows, bounds, depth, pairs).groupBy("range").applyInArrow(work, "lang string, phrase string, depth int, f long, n long, lefts array<long>")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000, contained: int = 80, blocks: int = 64) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases.

    A phrase goes if a longer one holds it and has ``contained`` percent of its places.
    """
    nodes = saved(phrase_counts(docs, text_col=text_col, lang_col=lang_col, least=least))
    named = lambda phrase: F.concat_ws("\t", "lang", phrase)  # noqa: E731  no phrase has a tab
    cuts = nodes.where("depth >= 2").select("lang", "phrase", "depth", F.col("f").alias("a"), "n", F.posexplode("lefts").alias("at", "l"))
    cuts = cuts.withColumn("key", named(F.expr("substring_index(phrase, ' ', at + 1 - depth)")))
    linked = salted(cuts, nodes.select(named("phrase").alias("key"), F.col("f").alias("r")), ["key"])
    score = F.expr("cast(a as decimal(28, 0)) * 2000000 div (cast(l as decimal(28, 0)) + r)")
    scored = linked.groupBy("lang", "phrase", "depth", "a", "n").agg(F.min(F.struct(score.alias("score"), "at", "l", "r")).alias("x"))
    words = F.split("phrase", " ")
    inside = F.array_distinct(F.expr("flatten(transform(sequence(2, depth - 1), k -> transform(sequence(1, depth - k + 1), i -> array_join(slice(w, i, k), ' '))))"))
    holds = nodes.where("depth >= 3").select("lang", "depth", "f", words.alias("w")).select("lang", "f", F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    kept = scored.join(holds, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (F.lit(100) * F.col("_longer") < F.lit(contained) * F.col("a")))
    rows = kept.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score").withColumn("_block", F.pmod(F.xxhash64("phrase"), F.lit(blocks)))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # each block's best first, so that the last window sees at most blocks * top rows of a language
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_block").orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
