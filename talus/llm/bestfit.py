"""Best-fit-decreasing packing with a segment tree, written as binary training rows.

Texts become token ids with an end id; a document longer than a row is cut into
whole rows and a rest, so no id is lost. Each task packs its documents in
windows of about ``window`` ids: pieces go longest first into the row with the
least room that still holds them, found by a segment tree over the amounts of
room. A window, and so a task, has bounded memory, and nothing is shuffled; only
the last rows of a window can stay open.

A row of output holds ``size`` ids (padded), the cumulative lengths of its
segments, position ids that start at 0 in every segment and in the padding, and
for each segment the document and where in it the segment begins.

A null text is empty: one end id. Null ids and repeated rows are kept. Long
texts are encoded whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.tokens import encoder


class Room:
    """Segment tree over room 0..size: which amounts of room some open row has."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.any = np.zeros(2 * self.leaves, bool).tolist()
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _set(self, room: int, value: bool) -> None:
        i = room + self.leaves
        while i and self.any[i] != value:
            self.any[i] = value
            i >>= 1
            if i and not value:
                value = self.any[2 * i] or self.any[2 * i + 1]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._set(room, True)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the fullest row with room for ``need``; the row is no longer open."""
        i = need + self.leaves
        if not self.any[i]:  # up, until a subtree to the right has an open row
            while i > 1 and (i % 2 or not self.any[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self._set(room, False)
        return room, row


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Pieces of each row, in the order in which they were placed."""
    room, rows = Room(size), []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[piece]
        found = room.take(n)
        if found is None:
            rows.append([])
            found = size, len(rows) - 1
        left, row = found
        rows[row].append(piece)
        if left > n:
            room.add(left - n, row)
    return rows


def pack_rows(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 50256, pad_id: int = 50256,
    window: int = 1 << 21, json_path: str | None = None,
) -> DataFrame:
    """sequence_id, n_tokens, input_ids, cu_seqlens, position_ids, doc_ids, doc_starts."""
    names = ["sequence_id", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "doc_starts"]

    def flush(pieces: list[tuple[int | None, int, np.ndarray]], first: int) -> pa.RecordBatch:
        rows = best_fit([len(p[2]) for p in pieces], size)
        ids = np.full((len(rows), size), pad_id, np.int32)
        places = np.zeros((len(rows), size), np.int32)
        lengths, cuts, owners, starts = [], [], [], []
        for r, row in enumerate(rows):
            at = [0]
            for p in row:
                own = pieces[p][2]
                ids[r, at[-1] : at[-1] + len(own)] = own
                places[r, at[-1] : at[-1] + len(own)] = np.arange(len(own))
                at.append(at[-1] + len(own))
            places[r, at[-1] :] = np.arange(size - at[-1])
            lengths.append(at[-1])
            cuts.append(at)
            owners.append([pieces[p][0] for p in row])
            starts.append([pieces[p][1] for p in row])
        every = pa.array(np.arange(0, (len(rows) + 1) * size, size, dtype=np.int32))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(first, first + len(rows))),
                pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(every, pa.array(ids.ravel())),
                pa.array(cuts, pa.list_(pa.int32())),
                pa.ListArray.from_arrays(every, pa.array(places.ravel())),
                pa.array(owners, pa.list_(pa.int64())),
                pa.array(starts, pa.list_(pa.int64())),
            ],
            names=names,
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        encode = encoder(json_path, None, False).encode
        pieces, held = [], 0
        for batch in batches:
            for doc, own in zip(batch.column("d").to_pylist(), batch.column("t")):
                whole = np.append(encode(own.as_py()), np.uint32(end_id))
                for at in range(0, len(whole), size):
                    pieces.append((doc, at, whole[at : at + size]))
                    held += len(pieces[-1][2])
                    if held >= window:
                        yield (out := flush(pieces, first))
                        pieces, held, first = [], 0, first + out.num_rows
        if pieces:
            yield flush(pieces, first)

    return docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t")).mapInArrow(
        pack,
        "sequence_id bigint, n_tokens bigint, input_ids array<int>, cu_seqlens array<int>, position_ids array<int>, doc_ids array<bigint>, doc_starts array<bigint>",
    )
