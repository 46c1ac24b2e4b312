"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches
from .tokens import encoder


@dataclass(frozen=True)
class Packing:
    """window: tokens of a sequence. end_id: the id after each document. group: documents that are packed together.
    piece: the longest piece of what is left of a document after its full windows. remembered: words of which a worker
    keeps the ids."""

    tokenizer: str
    window: int = 1024
    end_id: int = 0
    group: int = 192
    piece: int = 256
    remembered: int = 1_000_000


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Parts items into ``windows`` sets of near-equal sums: Karmarkar-Karp multiway differencing.

    A partial partition is a tuple of sums in descending order, less its smallest. The two partitions with the widest
    spread are merged, largest sum with smallest, so that opposing imbalances cancel.
    """
    heap = []
    for i, n in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = n
        heap.append((-n, i, sums))
    heapq.heapify(heap)
    slot, bits = np.arange(windows), max(1, (windows - 1).bit_length())
    merges = []
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heap[0]
        sums = ((left + right[::-1]) << bits) + slot
        sums.sort()
        sums = sums[::-1]
        order = sums & ((1 << bits) - 1)
        sums >>= bits
        sums -= sums[-1]
        heapq.heapreplace(heap, (-int(sums[0]), len(sizes) + len(merges), sums))
        merges.append((a, b, order))
    # From the last merge back, each partition learns which window its slots ended in.
    ended = {heap[0][1]: slot} if heap else {}
    for i in range(len(merges) - 1, -1, -1):
        a, b, order = merges[i]
        window = ended.pop(len(sizes) + i)
        ended[a] = was = np.empty_like(window)
        was[order] = window
        ended[b] = was[::-1]
    sets: list[list[int]] = [[] for _ in range(windows)]
    for i in range(len(sizes)):
        sets[ended[i][0]].append(i)
    return sets


def packed(lengths: list[int], window: int, piece: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold each token once, in sequences of ``window`` at most.

    Full windows of a document are sequences of their own. The rest is cut into pieces and parted into as few windows as
    their sum needs; the number of windows rises by one while a window exceeds its capacity.
    """
    out, items, sequence = [], [], 0
    for d, n in enumerate(lengths):
        full = n // window * window
        for start in range(0, full, window):
            out.append((d, start, window, sequence, 0))
            sequence += 1
        items += [(d, start, min(piece, n - start)) for start in range(full, n, piece)]
    sizes = [x[2] for x in items]
    windows = -(-sum(sizes) // window)
    while items:
        sets = differencing(sizes, windows)
        if max(sum(sizes[i] for i in s) for s in sets) <= window:
            break
        windows += 1
    for s in sets if items else []:
        offset = 0
        for i in sorted(s):
            out.append((*items[i], sequence, offset))
            offset += items[i][2]
        sequence += bool(s)
    return out


def pack(docs: DataFrame, c: Packing) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset.

    Each task packs its own documents in groups, so nothing is shuffled and at most one window a group is poorly filled.
    A null or empty text is the end id alone. Repeated rows are packed as often as they occur; a null doc_id stays null.
    sequence_id is the task's number times 2**33 plus a count. An empty table gives no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, base = encoder(c.tokenizer, c.remembered), TaskContext.get().partitionId() << 33
        end = np.array([c.end_id], "<u4").tobytes()
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

        def sequences(group: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
            nonlocal base
            rows = packed([len(x[1]) // 4 for x in group], c.window, c.piece)
            doc, start, length, seq, offset = zip(*rows, strict=True)
            long = lambda x: pa.array(x, pa.int64())
            ids = pa.array([group[d][1][4 * s : 4 * (s + n)] for d, s, n in zip(doc, start, length, strict=True)], pa.binary())
            out = [long([group[d][0] for d in doc]), long(start), long(length), ids, long([len(group[d][1]) // 4 for d in doc]), long([base + s for s in seq]), long(offset)]
            base += max(seq) + 1
            return pa.RecordBatch.from_arrays(out, names)

        group: list[tuple[int | None, bytes]] = []
        for b in chunks(batches, 128):
            group += zip(b.column(0).to_pylist(), [ids + end for ids in words.encode(b.column(1).to_pylist())], strict=True)
            if len(group) >= c.group:
                yield sequences(group)
                group = []
        if group:
            yield sequences(group)

    small_batches(docs.sparkSession)
    shape = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, shape)
