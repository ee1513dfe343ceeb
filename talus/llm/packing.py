"""Shortest-pack-first packing over the histogram of lengths.

Documents become token ids with an end id. Whole runs of ``size`` ids are
pieces of their own, the rest is one more piece. Only the histogram of piece
lengths (``size`` entries at most) comes to the driver. There the lengths are
placed longest first, each into the pack that is shortest so far among those
with room, and packs of one pattern are counted, not listed. What the patterns
leave open is small, as pieces of every length fill gaps.

Pieces then join patterns by rank: each occurrence of a length in a pattern
takes a range of the ranks of that length. A rank is the number of pieces of
that length in earlier partitions, from a sum over stored counts, plus the
place within the partition, so no length is sorted or gathered in one task.

A null text is empty and so one end id. Repeated rows and null ids are kept; an
empty table gives no rows. A long text is encoded whole and cut losslessly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from talus.llm.common import cut
from talus.llm.tokens import encoder


def pieces(
    docs: DataFrame, *, doc_id: str, text: str, size: int, end_id: int, json_path: str | None, ids: bool
) -> DataFrame:
    """One row per piece: document, start, length, ids_crc32, doc_tokens, and its place among its partition's pieces of that length."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        encode = encoder(json_path).encode
        for batch in batches:
            rows = []
            for doc, own in zip(batch["d"], batch["t"]):
                whole = np.append(encode(own), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(whole), size):
                    piece = whole[at : at + size]
                    n = len(piece)
                    rows.append((doc, at, n, zlib.crc32(piece.tobytes()), len(whole), part, seen[n], *([piece] if ids else [])))
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=[f.name for f in schema]).astype({"doc": "Int64"} if whole_ids else {})

    kind = docs.schema[doc_id].dataType
    whole_ids = isinstance(kind, T.IntegralType)
    schema = T.StructType([T.StructField("doc", kind)])
    for name in ("start", "length", "ids_crc32", "doc_tokens", "part", "place"):
        schema.add(name, T.LongType())
    if ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInPandas(cut_up, schema)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each pattern: longest lengths first, each into the shortest pack with room."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = max((r for r, packs in room.items() if packs and r >= length), default=None)
            if free is None:  # new packs: each takes as many as it can
                for count, each in ((left // (size // length), size // length), (1, left % (size // length))):
                    if count and each:
                        room.setdefault(size - each * length, []).append((count, (length,) * each))
                break
            count, pack = room[free].pop()
            taken = min(count, left)
            if count > taken:
                room[free].append((count - taken, pack))
            room.setdefault(free - length, []).append((taken, (*pack, length)))
            left -= taken
    return [pack for r in sorted(room) for pack in room[r]]


def slots(packs: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted; an occurrence takes as many ranks as its pattern has packs."""
    rows, upto, sequence = [], {}, 0
    for count, lengths in packs:
        offset = 0
        for n in lengths:
            rows.append((n, upto.get(n, 0), sequence, offset))
            upto[n] = upto.get(n, 0) + count
            offset += n
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = 2048,
    end_id: int = 1,
    json_path: str | None = None,
    ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for)."""
    cut_up = cut(pieces(docs, doc_id=doc_id, text=text, size=size, end_id=end_id, json_path=json_path, ids=ids))
    counts = cut(cut_up.groupBy("length", "part").agg((F.max("place") + 1).alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    table = slots(patterns(histogram, size))
    first = table[:, 0] << 44 | table[:, 1]
    shared = docs.sparkSession.sparkContext.broadcast((first, table))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        first, table = shared.value
        at = np.searchsorted(first, length.to_numpy() << 44 | rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": table[at, 2] + rank.to_numpy() - table[at, 1], "offset": table[at, 3]})

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut_up.join(before, ["length", "part"]).withColumn("slot", slot("length", F.col("before") + F.col("place")))
    names = [F.col("doc").alias(doc_id), "start", "length", "ids_crc32", "doc_tokens", "slot.sequence_id", "slot.offset"]
    return ranked.select(*names, *(["ids"] if ids else []))
