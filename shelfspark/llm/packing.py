"""Sequence packing by Karmarkar-Karp multiway differencing.

Every task tokenizes its documents and packs what it has read in groups of bounded size, so nothing is shuffled and
no group grows with the input.  A document's ids are cut into full windows, which need no packing, and a rest, which
is cut into pieces of at most ``piece`` ids.  A group's pieces are split over k windows by largest differencing: the
two partial partitions with the widest spread are merged so that the largest sums of one meet the smallest of the
other, until one partition with near-equal windows is left.  k starts at the least count that could hold the group
and rises whenever a window exceeds the capacity.

Defined results: null and empty texts are documents of the closing id alone; texts of any length are cut whole;
repeated rows are packed once each; with no rows there are no pieces.  ``sequence_id`` is the task's number shifted
left by 36 bits plus a count, so it is unique and a repeated task gives it again.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfspark.llm._batches import runs, two
from shelfspark.llm.bpe import RUN_BYTES, BatchBPE

CAPACITY = 2048
END_ID = 1


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Split items over k windows by multiway differencing; the windows as lists of item numbers.

    A partial partition is kept as its non-empty windows, largest first; the rest of its k windows are empty.
    """
    heap, turn = [], 0
    for i, s in enumerate(sizes):
        heap.append((-s, turn, [(s, [i])]))
        turn += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = max(0, len(a) + len(b) - k)
        # the largest windows of one meet empty ones of the other; a's smallest meet b's smallest in opposite order
        x, y = len(a) - over, len(b) - over
        new = a[:x] + b[:y] + [(p[0] + q[0], p[1] + q[1]) for p, q in zip(a[x:], reversed(b[y:]), strict=True)]
        new.sort(key=lambda x: -x[0])
        spread = new[0][0] - (new[-1][0] if len(new) == k else 0)
        heapq.heappush(heap, (-spread, turn, new))
        turn += 1
    return [items for _, items in heap[0][2]] if heap else []


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; their count rises until all hold."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        windows = difference(sizes, k)
        most = max((sum(sizes[i] for i in w) for w in windows), default=0)
        if most <= capacity:
            return windows
        k += max(1, (most - capacity) * k // (4 * capacity))


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, piece: int = 384, group: int = 2048) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, sequence = BatchBPE(tokenizer), TaskContext.get().partitionId() << 36
        kept: list[tuple] = []
        out: list[list] = [[], [], [], [], [], [], []]

        def row(doc, start, ids, tokens, sequence_id, offset):
            for column, value in zip(out, (doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, sequence_id, offset), strict=True):
                column.append(value)

        def rows():
            kinds = [pa.int64()] * 7
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            for c in out:
                c.clear()
            return batch

        def close():
            nonlocal sequence
            for window in pack([len(x[2]) for x in kept], capacity):
                at = 0
                for i in window:
                    row(*kept[i], sequence, at)
                    at += len(kept[i][2])
                sequence += 1
            kept.clear()

        for batch in runs(batches, budget=RUN_BYTES):
            ids, bounds = bpe.encode([x or "" for x in batch.column("text").to_pylist()])
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                n, at = len(own), 0
                while n - at >= capacity:
                    row(doc, at, own[at : at + capacity], n, sequence, 0)
                    sequence, at = sequence + 1, at + capacity
                parts = -(-(n - at) // piece)
                for i in range(parts):
                    to = at + -(-(n - at) // (parts - i))
                    kept.append((doc, at, own[at:to], n))
                    at = to
                if len(kept) >= group:
                    close()
            if len(out[0]) > 10_000:
                yield rows()
        if kept:
            close()
        if out[0]:
            yield rows()

    return two(docs, id_col, text_col).mapInArrow(work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
