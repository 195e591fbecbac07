"""SimHash near-duplicate detection with pigeonhole blocks.

A fingerprint bit is 1 if it is set in over half the 64-bit hashes of a text's shingles.  Fingerprints within a
Hamming radius are linked and links are followed to components.  To find them, a fingerprint is split into blocks so
that close pairs share some (of 7 blocks, 4 differing bits leave at least 3 whole); fingerprints meet in buckets of
shared blocks and are then verified by their Hamming distance.  Three blocks hold 27 bits or more, so chance meetings
stay rare even among hundreds of millions of fingerprints.

Equal fingerprints are one node, whatever their number.  The nodes of a bucket are compared with each other; nodes of
a bucket of more than ``small`` (a group of near copies) are linked through midpoints instead: two fingerprints differ
in at most 4 bits exactly if flipping at most 2 bits of either can give the same value, so each is sent to all its
values of at most 2 flips, and what meets in a value (at most as many as it has neighbours) is linked to the least
there.  So a node costs a bounded number of comparisons or rows, however large its group.

Components come from alternating large-star and small-star rounds over the links; each round's result is written to the
shared checkpoint folder.  Rows of a hot fingerprint, and links of a hub, are dealt over parts (:mod:`skew`).

Defined results: null and empty texts have fingerprint zero and link like any other; a text of fewer words than a
shingle has one shingle of all its words; repeated rows share their fingerprint; a null id takes part, and a
component's id is the smallest id that is not null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm._batches import dropped, flat, runs, saved, ship, two
from shelfspark.llm.skew import salted

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words of all texts, one blank between neighbours of a text; each word's start, end and text."""
    data, starts, ends = flat(texts)
    solid = ~_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = starts[(starts < ends)]
    begin[inner] = solid[inner]
    at = np.flatnonzero(begin)
    text = np.searchsorted(ends, at, side="right")
    keep = solid
    follows = np.zeros(len(at), bool)
    follows[1:] = text[1:] == text[:-1]
    keep[at[follows] - 1] = True  # one blank before each word but a text's first
    low = np.where(solid & ~_SPACE[data], _LOW[data], 32).astype(np.uint8)[keep]
    where = np.cumsum(keep) - 1
    first = where[at]
    last = np.append(first[1:] - follows[1:], len(low)) if len(at) else first
    return low, first, last, text


def shingle_bounds(first: np.ndarray, last: np.ndarray, text: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each shingle of ``k`` words, and its text; fewer words make one shingle."""
    count = np.bincount(text, minlength=n)
    begin = np.cumsum(count) - count
    place = np.arange(len(text)) - begin[text]
    own = place <= np.maximum(count[text] - k, 0)
    i = np.flatnonzero(own)
    return first[i], last[np.minimum(i + k, begin[text[i]] + count[text[i]]) - 1], text[i]


def majority(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each text and column of ``hashes`` the 64 bits set in over half its hashes; without hashes, zero."""
    out = np.zeros((n, hashes.shape[1]), np.uint64)
    if not len(text):
        return out
    edge = np.flatnonzero(np.diff(text, prepend=-1))
    sizes = np.diff(np.append(edge, len(text)))
    for c in range(hashes.shape[1]):
        bits = np.unpackbits(np.ascontiguousarray(hashes[:, c]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
        out[text[edge], c] = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(texts: pa.Array, k: int = 4) -> np.ndarray:
    """64-bit fingerprints over XXH64 (seed 42) of space-joined shingles of ``k`` words, repeats included."""
    low, first, last, text = words_of(texts)
    a, b, of = shingle_bounds(first, last, text, len(texts), k)
    raw, digest = low.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[x:y], 42) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a))
    return majority(hashes[:, None], of, len(texts))[:, 0]


def fingerprint(docs: DataFrame, *, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text"), k).view(np.int64))], ["doc_id", "fp"])

    return two(docs, id_col, text_col).mapInArrow(work, "doc_id long, fp long")


def block_keys(fp: Column, blocks: int = 7, shared: int = 3) -> Column:
    """An array with one key for each choice of ``shared`` among ``blocks`` near-equal blocks of a 64-bit fingerprint."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = []
    for c, chosen in enumerate(combinations(range(blocks), shared)):
        key = F.lit(c).cast("long")
        for i in chosen:
            key = F.shiftleft(key, cuts[i + 1] - cuts[i]).bitwiseOR(part[i])
        keys.append(key)
    return F.array(*keys)


def midpoints(fp: Column, flips: int) -> Column:
    """All values that differ from a 64-bit fingerprint in at most ``flips`` (up to 2) bits."""
    bit = [1 << b if b < 63 else -(1 << 63) for b in range(64)]
    masks = [0, *bit] if flips else [0]
    if flips > 1:
        masks += [p ^ q for p, q in combinations(bit, 2)]
    return F.transform(F.array(*map(F.lit, masks)).cast("array<bigint>"), lambda m: fp.bitwiseXOR(m))


def links(nodes: DataFrame, radius: int = 4, *, small: int = 4096) -> DataFrame:
    """Links ``u, v`` (u < v) of fingerprints (``nodes``: a unique long ``node``) that connect all within ``radius`` bits.

    All linked pairs differ in at most ``radius`` bits.  Pairs of a bucket of at most ``small`` nodes are all linked; other
    close pairs are connected through links.  ``radius`` is 4 or less, which the blocks allow for.
    """
    if not 0 <= radius <= 4:
        raise ValueError("radius must be 0 to 4")
    rows = nodes.select("node", F.explode(block_keys(F.col("node"))).alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = saved(rows.join(buckets.hint("merge"), "key"))
    few = met.where(F.col("n") <= small)
    a, b = few.alias("a"), few.alias("b")
    near = F.bit_count(F.col("a.node").bitwiseXOR(F.col("b.node"))) <= radius
    out = a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & near).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))

    many = saved(met.where(F.col("n") > small).select("node").distinct())
    # of an odd radius one side flips one bit more; those of fewer flips are within the radius of all that they meet
    wide, narrow = (radius + 1) // 2, radius // 2
    half = many.select("node", F.posexplode(midpoints(F.col("node"), wide)).alias("pos", "point"))
    inner = F.col("pos") < (1, 65, 1 + 64 + 64 * 63 // 2)[narrow]
    point = half.select("node", F.min(F.when(inner, F.col("node"))).over(Window.partitionBy("point")).alias("u")).where("u <> node").distinct()
    return out.unionAll(point.select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that has a link; root is the smallest node reachable.

    Alternates large-star and small-star rounds until the links no longer change; every round is written to the shared
    checkpoint folder, and the links of a hub are dealt over parts.
    """
    edges = saved(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
    before = mark(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours move to the least of all
        large = saved(salted(edges, least, ["u"]).select(F.col("m").alias("u"), "v").where("u <> v").distinct())
        # small star: a node and its smaller neighbours move to the least of those
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        new = salted(large, low, ["v"]).select(F.col("m").alias("a"), F.col("u").alias("b")).where("a <> b").unionAll(low.select(F.col("m").alias("a"), F.col("v").alias("b")))
        old, edges = edges, saved(new.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        dropped(old)
        dropped(large)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def label_components(docs: DataFrame, *, radius: int = 4, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: fingerprints link at ``radius`` (4 or fewer) differing bits."""
    prints = saved(fingerprint(docs, k=k, id_col=id_col, text_col=text_col))
    nodes = saved(prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least_id")))
    roots = saved(components(links(nodes.select("node"), radius)))
    of_node = saved(labelled(nodes, roots)).withColumnRenamed("node", "fp")
    return salted(prints, of_node, ["fp"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def labelled(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, component_id`` of all nodes (``node, least_id``): the least id of the nodes of the same root."""
    members = saved(roots.join(nodes.hint("merge"), "node"))
    ids = members.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = salted(members.select("node", "root"), ids, ["root"]).select("node", "component_id")
    return nodes.join(known.hint("merge"), "node", "left").select("node", F.coalesce("component_id", "least_id").alias("component_id"))


#: Of near copies: words of the fingerprint of shingles, and bands and rows of the least hashes that find candidates.
CHECK, BANDS, ROWS = 4, 24, 5
#: Buckets of up to so many nodes are compared pair by pair.
SMALL = 24
_P = np.uint64(0x100000001B3)
_SEEDS = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * ROWS), np.uint64)


def _mixed(h: np.ndarray, columns: int) -> np.ndarray:
    out = np.empty((len(h), columns), np.uint64)
    for c in range(columns):
        x = h + np.uint64((0x9E3779B97F4A7C15 * (c + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, c] = x ^ (x >> np.uint64(31))
    return out


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit hashes of all texts' shingles of ``k`` words, in order of text and hash, and their texts."""
    low, first, last, text = words_of(texts)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.arange(len(low)) - np.repeat(first, np.diff(np.append(first, len(low))))
    value = low.astype(np.uint64) * np.multiply.accumulate(np.full(place.max() + 1, _P))[place]
    value[low == 32] = 0
    h = _mixed(np.add.reduceat(value, first) ^ ((last - first).astype(np.uint64) << np.uint64(40)), 1)[:, 0]
    count = np.bincount(text, minlength=len(texts))
    begin = np.cumsum(count) - count
    i = np.flatnonzero(np.arange(len(text)) - begin[text] <= np.maximum(count[text] - k, 0))
    end = begin[text[i]] + count[text[i]]
    g = np.zeros(len(i), np.uint64)
    for j in range(k):
        g = g * _P + np.where(i + j < end, h[np.minimum(i + j, len(h) - 1)], np.uint64(0))
    g, of = _mixed(g, 1)[:, 0], text[i]
    order = np.lexsort((g, of))
    g, of = g[order], of[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    return g[new], of[new]


def band_keys(g: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every text that has shingles a key for each band of least hashes and a byte of each of those; and each text's number of keys."""
    edge = np.flatnonzero(np.diff(of, prepend=-1))
    keys, low = np.empty((len(edge), BANDS), np.uint64), np.empty((len(edge), BANDS * ROWS), np.uint8)
    for b in range(BANDS) if len(edge) else ():
        key = np.full(len(edge), b, np.uint64)
        for c in range(b * ROWS, (b + 1) * ROWS):
            least = _mixed(np.minimum.reduceat(g * (_SEEDS[0, c] | np.uint64(1)) + _SEEDS[1, c], edge), 1)[:, 0]
            low[:, c] = least >> np.uint64(56)
            key = _mixed(key ^ least, 1)[:, 0]
        keys[:, b] = key
    return keys, low, np.bincount(of[edge], minlength=n) * BANDS


def jaccard(a: pa.Array, b: pa.Array, k: int = 5) -> np.ndarray:
    """The similarity of each two texts: shared distinct shingles of ``k`` words over all; 1 for two texts without words."""
    n = len(a)
    (ga, fa), (gb, fb) = shingle_sets(a, k), shingle_sets(b, k)
    g, of = np.concatenate([ga, gb]), np.concatenate([fa, fb])
    order = np.lexsort((g, of))
    g, of = g[order], of[order]
    shared = np.bincount(of[1:][(g[1:] == g[:-1]) & (of[1:] == of[:-1])], minlength=n)
    whole = np.bincount(of, minlength=n) - shared
    return np.where(whole == 0, 1.0, shared / np.maximum(whole, 1))


def close(a: np.ndarray, b: np.ndarray, radius: int, least: int) -> np.ndarray:
    """Whether two sketches (last axis: 32 bytes of a SimHash fingerprint, then a byte of each least hash) may be alike."""
    differ = np.bitwise_count(a[..., :32] ^ b[..., :32]).sum(-1, dtype=np.int32)
    return (differ <= radius) & ((a[..., 32:] == b[..., 32:]).sum(-1, dtype=np.int32) >= least)


def alike(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similar: float, k: int, radius: int) -> DataFrame:
    """Those of the pairs ``u, v`` whose texts have a similarity of ``similar`` or more: by sketch, then from the texts."""
    least = fewest(similar)

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in "ab")
            yield batch.select(["u", "v"]).filter(pa.array(close(a, b, radius, least)))

    def are(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for half in runs(batches, "a") for part in runs(iter([half]), "b")):
            yield batch.select(["u", "v"]).filter(pa.array(jaccard(batch.column("a"), batch.column("b"), k) >= similar))

    def both(pairs: DataFrame, of: DataFrame) -> DataFrame:
        of = of.toDF("node", "x")
        one = salted(pairs, of.select(F.col("node").alias("u"), F.col("x").alias("a")), ["u"])
        return salted(one, of.select(F.col("node").alias("v"), F.col("x").alias("b")), ["v"], counted=pairs).select("u", "v", "a", "b")

    likely = saved(both(saved(pairs), nodes.select("node", "sketch")).mapInArrow(may, "u binary, v binary"))
    return both(likely, texts).mapInArrow(are, "u binary, v binary")


def fewest(similar: float) -> int:
    """How many of the least hashes agree at this similarity, less 4.5 deviations: 5 in a million pairs have fewer."""
    n = BANDS * ROWS
    return int(n * similar - 4.5 * (n * similar * (1 - similar)) ** 0.5)


def block_links(texts: pa.Array, similar: float, k: int, columns: int = 4096) -> np.ndarray:
    """For each text of a block the place of a text reached over similarities of ``similar`` or more; one of each is its own.

    The shared shingles are counted by products of matrices with a column for each shingle that two texts have.
    """
    n = len(texts)
    g, of = shingle_sets(texts, k)
    size = np.bincount(of, minlength=n)
    word, at, times = np.unique(g, return_inverse=True, return_counts=True)
    place = (np.cumsum(times > 1) - 1)[at]
    keep = times[at] > 1
    place, owner = place[keep], of[keep]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    shared = np.zeros((n, n), np.float32)
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        a, b = np.searchsorted(place, [first, first + columns])
        has = np.zeros((n, columns), np.float32)
        has[owner[a:b], place[a:b] - first] = 1
        shared += has @ has.T
    whole = size[:, None] + size[None, :] - shared
    near = np.where(whole == 0, 1.0, shared.astype(np.float64) / np.maximum(whole, 1)) >= similar
    label = np.full(n, -1)
    for seed in range(n):
        if label[seed] < 0:
            front, label[seed] = np.array([seed]), seed
            while len(front):
                front = np.flatnonzero(near[front].any(0) & (label < 0))
                label[front] = seed
    return label


def _dense(left: DataFrame, nodes: DataFrame, texts: DataFrame, similar: float, k: int, small: int, chunk: int = 512, chunk_bytes: int = 4 << 20) -> DataFrame:
    """Links ``u, v`` (u < v) that connect what is alike in the large buckets of ``left``.

    The texts of a bucket meet in blocks of two chunks of bounded size; a block gives at most one link for each text.
    """
    many = saved(left.where(F.col("n") > small).select("key", "node").join(nodes.select("node", "size"), "node"))
    parts = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("size") / chunk_bytes)).cast("int")
    many = salted(many.drop("size"), many.groupBy("key").agg(parts.alias("parts")), ["key"], counted=many)
    many = many.withColumn("own", F.pmod(F.xxhash64("node", F.lit(9)), F.col("parts")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = many.select("key", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(texts, "node")

    def span(group: pd.DataFrame) -> pd.DataFrame:
        node = group["node"].to_numpy()
        label = block_links(pa.array(group["text"], pa.string()), similar, k)
        pairs = [(node[i], node[j]) for i, j in enumerate(label.tolist()) if i != j]
        return pd.DataFrame({"u": [min(p) for p in pairs], "v": [max(p) for p in pairs]}, dtype=object)

    return many.groupBy("key", "i", "j").applyInPandas(span, "u binary, v binary")


def _print_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs ``u, v`` (u < v) of ``node, fp``: the least node of a fingerprint with its others, and with that of a linked one."""
    hubs = saved(nodes.groupBy("fp").agg(F.min("node").alias("hub")))
    same = salted(nodes, hubs, ["fp"]).where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    found = saved(links(hubs.select(F.col("fp").alias("node"))))
    side = lambda c: hubs.select(F.col("fp").alias(c), F.col("hub").alias(f"_{c}"))
    near = salted(salted(found, side("u"), ["u"]), side("v"), ["v"], counted=found)
    return same.unionAll(near.select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")))


def near_nodes(rows: DataFrame, k: int, similar: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with long ``_id``, unique long ``_row``, string ``_text``) written with ``_node``, and ``node, component_id`` of all nodes.

    Texts of equal shingles are one node, named by 128 bits of a hash of those; the least ``_id`` names a component.
    Candidates are what SimHash links: nodes of one 64-bit fingerprint, and of fingerprints that :func:`links` finds
    within 4 bits through shared blocks.  A similarity of 0.8 leaves about 10 of 64 bits different, so candidates also
    share a band of least hashes, whatever the edit looks like: of pairs at 0.8, all but 7 in 100,000 share
    one of 24 bands of 5.  Of their sketches, the 256-bit SimHash fingerprints may then differ in ``radius`` bits, far above
    the 39 expected at 0.8 (deviation 6; 48 for the shortest texts), and as many of the 120 least hashes must agree as
    do at that similarity, less 4.5 deviations.  What passes is decided by the similarity itself, from the texts.
    Each bucket of a band is first compared with one of its nodes.  Of buckets that this leaves in several components, small ones
    are compared pair by pair, and the texts of large ones meet in blocks, which give no more links than texts.
    """
    columns = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "_text"):
            n = batch.num_rows
            g, of = shingle_sets(batch.column("_text"), k)
            keys, low, sizes = band_keys(g, of, n)
            check = majority(_mixed(g, CHECK), of, n).view(np.uint8).reshape(n, -1)
            hashes = np.zeros((n, BANDS * ROWS), np.uint8)
            hashes[sizes > 0] = low
            sketch = np.concatenate([check, hashes], 1)
            bounds = np.searchsorted(of, np.arange(n + 1)).tolist()
            node = pa.array([xxhash.xxh3_128_digest(g[x:y].tobytes()) for x, y in zip(bounds, bounds[1:], strict=False)], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), node, pa.array(check[:, :8].copy().view(np.int64)[:, 0]), pa.array([x.tobytes() for x in sketch], pa.binary()), lists], [*columns, "_node", "_fp", "_sketch", "_keys"])

    schema = rows.schema
    for c, kind in (("_node", "binary"), ("_fp", "bigint"), ("_sketch", "binary"), ("_keys", "array<bigint>")):
        schema = T.StructType([*schema, T.StructField(c, T.DataType.fromDDL(kind))])
    prints = saved(rows.mapInArrow(work, schema))
    nodes = saved(prints.groupBy(F.col("_node").alias("node")).agg(F.min("_id").alias("least_id"), F.min("_row").alias("_row"), F.min("_fp").alias("fp"), F.min("_sketch").alias("sketch"), F.min("_keys").alias("keys"), F.max(F.octet_length("_text")).alias("size")))
    rows = nodes.select("node", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    rows = saved(salted(rows, buckets, ["key"]))
    by_print = saved(_print_pairs(nodes.select("node", "fp")))
    # the texts of nodes that met others, each from one of its rows
    others = rows.select("node").unionAll(by_print.select("u")).unionAll(by_print.select("v")).distinct()
    met = nodes.select("node", "_row").join(others.hint("merge"), "node", "left_semi").select("_row")
    texts = saved(prints.select("_row", F.col("_node").alias("node"), F.col("_text").alias("text")).join(met.hint("merge"), "_row", "left_semi").drop("_row"))

    to_hubs = rows.where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    first = saved(alike(by_print.unionAll(to_hubs).distinct(), nodes, texts, similar, k, radius))
    linked = rows.join(saved(components(first)).hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = linked.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = saved(salted(linked.where("node <> hub").drop("hub"), open_, ["key"], counted=rows))
    few = left.where(F.col("n") <= SMALL)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root"))).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    second = alike(pairs, nodes, texts, similar, k, radius).unionAll(_dense(left, nodes, texts, similar, k, SMALL))
    return prints, saved(labelled(nodes.select("node", "least_id"), saved(components(first.unionAll(second)))))


def near_copies(docs: DataFrame, *, k: int = 5, similar: float = 0.8, radius: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` of texts linked by a similarity of ``similar`` or more of their distinct shingles."""
    rows = two(docs, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    prints, of_node = near_nodes(rows, k, similar, radius)
    return salted(prints.select("_id", "_node"), of_node.withColumnRenamed("node", "_node"), ["_node"]).select(F.col("_id").alias("doc_id"), "component_id")


def keep_one(docs: DataFrame, *, k: int = 5, similar: float = 0.8, radius: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, all columns, of each component of near copies: that of the smallest id, ids that are null last.

    Rows are told apart by a number of their own, so rows that share an id, or have none, stay if their texts are unlike;
    of rows that are alike and share their id one stays.
    """
    ship(docs.sparkSession)
    names = docs.columns
    given = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], docs[text_col].cast("string").alias("_text"), docs[id_col].cast("long").alias("_doc"), F.monotonically_increasing_id().alias("_row"))
    prints, of_node = near_nodes(given.withColumn("_id", F.col("_row")), k, similar, radius)
    rows = salted(prints.select("_row", "_doc", "_node"), of_node.withColumnRenamed("node", "_node"), ["_node"])
    kept = rows.groupBy("component_id").agg(F.min(F.struct(F.col("_doc").isNull(), "_doc", "_row")).alias("x")).select(F.col("x._row").alias("_row"))
    return prints.join(kept, "_row", "left_semi").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
