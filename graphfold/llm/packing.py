"""Best-fit-decreasing packing of documents into sequences of ids, written as binary matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from graphfold.llm.common import map_tasks, publish, two_columns
from graphfold.llm.tokens import RankEncoder, encoder


class Capacities:
    """Open sequences by the room they have left: a segment tree over all amounts of room, counting sequences."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        node = self.size + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, needed: int) -> tuple[int, int] | None:
        """The sequence with the least room that suffices, and that room; it is no longer in the tree."""
        node = self.size + needed
        if not self.count[node]:
            while node & 1 or not self.count[node + 1]:  # a right child, or nothing to the right of it
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room, found = node - self.size, self.open[node - self.size].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return found, room


def best_fit(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length). Documents beyond the capacity are cut at its multiples."""
    segments = [(d, s, min(capacity, n - s)) for d, n in enumerate(lengths) for s in range(0, n, capacity)]
    segments.sort(key=lambda x: -x[2])
    rooms, sequences = Capacities(capacity), []
    for segment in segments:
        found = rooms.take(segment[2])
        if found is None:
            found = len(sequences), capacity
            sequences.append([])
        sequences[found[0]].append(segment)
        if found[1] > segment[2]:
            rooms.put(found[1] - segment[2], found[0])
    return sequences


SEQUENCES = "sequence_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, doc_starts array<long>"


def pack_sequences(df: DataFrame, ranks_path: str, pattern: str, end_id: int, capacity: int = 4096, group_tokens: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 150_000_000) -> DataFrame:
    """A row for each sequence of packed ids; end_id ends each document and pads each sequence.

    input_ids is the sequence's row of the id matrix: capacity little-endian unsigned 32-bit ids.
    position_ids, as long, begins anew at 0 with each segment and is 0 in the padding. Segment i has the
    ids cu_seqlens[i] up to cu_seqlens[i + 1], from place doc_starts[i] on of document doc_ids[i].
    Documents are packed in groups of about group_tokens as they lie in the input's partitions: nothing
    is shuffled, and memory is bounded by a group and one document. A null or empty text is end_id
    alone; a null doc_id stays null; rows that repeat are packed as often as they come. table_bytes bounds
    what a worker process keeps of words, see WordTable.
    """

    def run(batches):
        own, numbers, base = encoder(RankEncoder, ranks_path, pattern, end_id, table_bytes), iter(range(1 << 32)), TaskContext.get().partitionId() << 32
        places = np.arange(capacity, dtype="<u4")

        def lay(held: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
            rows = []
            for sequence in best_fit([len(ids) // 4 for _, ids in held], capacity):
                ids = b"".join(held[d][1][4 * s : 4 * (s + n)] for d, s, n in sequence)
                ends = np.append(0, np.cumsum([n for _, _, n in sequence])).astype(np.int32)
                position = np.zeros(capacity, "<u4")
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    position[a:b] = places[: b - a]
                rows.append((base + next(numbers), int(ends[-1]), ids + own.end * (capacity - int(ends[-1])), position.tobytes(), ends.tolist(), [held[d][0] for d, _, _ in sequence], [s for _, s, _ in sequence]))
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SEQUENCES.split(", ")])

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

    publish(df.sparkSession, ranks_path)
    return map_tasks(two_columns(df, id_col, text_col), run, SEQUENCES)


def write_packed(sequences: DataFrame, path: str) -> None:
    """The matrices as Parquet: one row of ids and positions for each sequence."""
    sequences.write.mode("error").parquet(path)


def unpack(row_ids: bytes, cu_seqlens: list[int]) -> list[list[int]]:
    """The ids of each segment of a sequence."""
    ids = np.frombuffer(row_ids, "<u4")
    return [ids[a:b].tolist() for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:], strict=True)]
