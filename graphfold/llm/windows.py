"""Packing by Karmarkar-Karp differencing: documents into windows of nearly equal length.

Each document starts as a partial partition of its own. The two partial partitions with the largest
spread merge, the heaviest window of the one with the lightest of the other, until one is left. If a
window then exceeds the capacity, the number of windows rises and all begins anew.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from graphfold.llm.common import map_tasks, publish, two_columns
from graphfold.llm.tokens import WordEncoder, encoder


def differencing(lengths: np.ndarray, windows: int) -> list[list[int]]:
    """The items of each window, by multiway differencing."""
    # Trees of items: node i below len(lengths) is item i, others join two nodes.
    joins: list[tuple[int, int]] = []
    n = len(lengths)
    heap = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], nodes[0] = lengths[i], i
        heap.append((-int(lengths[i]), i, sums, nodes))
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, other, others = heapq.heappop(heap)
        sums, others = sums + other[::-1], others[::-1]  # both are sorted, heaviest first
        merged = np.where(nodes < 0, others, nodes)
        both = np.flatnonzero((nodes >= 0) & (others >= 0))
        merged[both] = n + len(joins) + np.arange(len(both))
        joins += zip(nodes[both].tolist(), others[both].tolist(), strict=True)
        order = np.argsort(-sums, kind="stable")
        sums, merged = sums[order], merged[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), turn, sums, merged))
        turn += 1
    out: list[list[int]] = []
    for root in heap[0][3].tolist() if heap else []:
        items, stack = [], [root] if root >= 0 else []
        while stack:
            node = stack.pop()
            if node < n:
                items.append(node)
            else:
                stack += joins[node - n]
        out.append(sorted(items))
    return out


def equal_windows(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Near-equal windows that hold all items, none of which is longer than the capacity; their number rises until all fit."""
    total = int(lengths.sum())
    count = -(-total // capacity)
    while True:
        windows = differencing(lengths, count)
        over = max(int(lengths[w].sum()) for w in windows) - capacity
        if over <= 0:
            return windows
        # As many as bring the mean down by what the heaviest window has too much, were all else equal.
        count = max(count + 1, -(-total // max(1, total // count - over)) if total // count > over else count + 1)


def pack(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences, each of (document, start, length).

    Whole capacities of long documents are sequences of their own; what remains of each goes through
    differencing. The windows beyond those that the total needs are then cut up to fill the gaps of
    the others, and the last tokens go into sequences of a power of two, which need no padding.
    """
    sequences, rest = [], []
    for document, length in enumerate(lengths):
        full = length - length % capacity
        sequences += [[(document, start, capacity)] for start in range(0, full, capacity)]
        if length > full:
            rest.append((document, full, length - full))
    sizes = np.array([r[2] for r in rest], np.int64)
    windows = sorted(equal_windows(sizes, capacity), key=lambda w: -sizes[w].sum()) if rest else []
    needed = int(sizes.sum()) // capacity
    spare = [rest[i] for w in windows[needed:] for i in w][::-1]

    def take(wanted: int) -> Iterator[tuple[int, int, int]]:
        while wanted:
            document, start, length = spare.pop()
            cut = min(length, wanted)
            if cut < length:
                spare.append((document, start + cut, length - cut))
            wanted -= cut
            yield document, start, cut

    for w in windows[:needed]:
        sequences.append([*(rest[i] for i in w), *take(capacity - int(sizes[w].sum()))])
    left = sum(s[2] for s in spare)
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            sequences.append(list(take(1 << bit)))
    return sequences


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(df: DataFrame, vocabulary_path: str, end_id: int = 2, capacity: int = 4096, group_tokens: int = 250_000, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, table_bytes: int = 25_000_000) -> DataFrame:
    """Every document's ids and the end id, cut and laid into sequences: a row for each piece.

    Documents are packed in groups of about group_tokens as they lie in the input's partitions, so
    that nothing is shuffled and memory is bounded by a group and one document. A null or empty text is
    the end id alone; a null doc_id stays null; rows that repeat are packed as often as they come.
    with_ids adds each piece's ids, little-endian unsigned 32-bit, as the binary column ids. table_bytes
    bounds what a worker process keeps of words, see WordTable.
    """

    def make():
        numbers = iter(range(1 << 32))
        base = TaskContext.get().partitionId() << 32

        def lay(held: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in range(8 if with_ids else 7)]
            for sequence in pack([len(ids) // 4 for _, ids in held], capacity):
                number, offset = base + next(numbers), 0
                for document, start, length in sequence:
                    name, ids = held[document]
                    piece = ids[4 * start : 4 * (start + length)]
                    row = (name, start, length, zlib.crc32(piece), len(ids) // 4, number, offset, piece)
                    for column, value in zip(columns, row, strict=False):
                        column.append(value)
                    offset += length
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(c, pa.binary()) for c in columns[7:]]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(columns)])

        return encoder(WordEncoder, vocabulary_path, end_id, table_bytes), lay

    def run(batches):
        own, lay = make()
        held, size = [], 0
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1)), strict=True):
                held.append((name, ids))
                size += len(ids) // 4
                if size >= group_tokens:
                    yield lay(held)
                    held, size = [], 0
        if held:
            yield lay(held)

    publish(df.sparkSession, vocabulary_path)
    return map_tasks(two_columns(df, id_col, text_col), run, PIECES + (", ids binary" if with_ids else ""))
