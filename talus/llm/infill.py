"""Fill-in-middle transformation, cut at unit boundaries found in 64-bit words.

A unit is a run of non-blank characters with the blanks before it; blanks at
the end of a text are a unit of their own. A text is viewed as UTF-8 in
little-endian 64-bit words. Blank bytes (space, 0x09 to 0x0D) are marked in the
top bit of every byte by additions that cannot carry over; a unit ends in a
byte that is not blank while the next one is. The marks of a word are counted
with ``bitwise_count``, the running count finds the word of the k-th end by
binary search, and the byte within it is found by a multiplication that makes
prefix sums of its eight marks. Characters are counted the same way (bytes that
continue none).

Words are marked in blocks, and a block leaves its count only; the blocks that
hold a cut are marked again. A text of any length therefore takes hardly any
memory besides itself.

Two draws cut a text of n units into prefix, middle and suffix: numbers below
2^32 modulo n + 1, the smaller first. Forms: plain (the text), psm and spm with
the markers before their parts. An empty text, one that holds a marker and one
that is not drawn stay plain, so that ``restored`` gives the exact text back.

A null text is empty; a null id draws as the empty string. Repeated rows are
treated alike. An empty table gives no rows. Other columns pass through,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.common import hidden

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 1 << 15  # words marked at once
_CUTS = "struct<n:bigint,prefix_chars:bigint,middle_chars:bigint>"


def _every(byte: int) -> np.uint64:
    """A word of eight equal bytes."""
    return np.uint64(byte * 0x0101010101010101)


_TOP, _LOW, _ONE = _every(0x80), _every(0x7F), _every(1)
_FROM_TAB, _FROM_SHIFT, _SPACE = _every(0x80 - 0x09), _every(0x80 - 0x0E), _every(0x20)
_BYTE, _SEVEN, _SHIFT = np.uint64(8), np.uint64(7), np.uint64(56)


def blank_marks(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that is a blank."""
    low = words & _LOW
    control = (low + _FROM_TAB) & ~(low + _FROM_SHIFT)
    space = ~((low ^ _SPACE) + _LOW)
    return (control | space) & ~words & _TOP


def starts_of_characters(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that does not continue a UTF-8 character."""
    return ~(words & ~(words << np.uint64(1))) & _TOP


def select(marks: int, k: int) -> int:
    """Number of the byte that holds the k-th mark (from 1) of a word."""
    ones = np.array([marks], np.uint64) >> _SEVEN
    with np.errstate(over="ignore"):
        upto = (ones * _ONE).view(np.uint8)  # byte i: marks in the bytes up to i
    return int(np.searchsorted(upto, k))


class Units:
    """The unit ends of one text."""

    def __init__(self, data: memoryview | bytes) -> None:
        self.size = len(data)
        whole = self.size // 8
        self.words = np.frombuffer(data, "<u8", whole)
        # the last word is filled up with blanks, and one blank at least follows the text
        self.tail = np.frombuffer(bytes(data[whole * 8 :]).ljust(8, b" "), "<u8")
        counts = [int(np.bitwise_count(self._ends(i)).sum(dtype=np.int64)) for i in range(0, whole + 1, BLOCK)]
        self.upto = np.cumsum(counts)
        self.closing = self.size > 0 and data[self.size - 1] in b" \t\n\v\f\r"
        self.n = int(self.upto[-1]) + self.closing

    def _block(self, start: int, stop: int) -> np.ndarray:
        part = self.words[start:stop]
        return part if stop <= len(self.words) else np.concatenate([part, self.tail])

    def _ends(self, start: int) -> np.ndarray:
        """Marks of unit-ending bytes of the block that starts at a word."""
        stop = min(start + BLOCK, len(self.words) + 1)
        words = self._block(start, min(stop + 1, len(self.words) + 1))
        blank = blank_marks(words)
        after = np.full(len(words), np.uint64(0x80) << _SHIFT)  # what follows the text counts as blank
        after[:-1] = blank[1:] << _SHIFT
        return (~blank & _TOP & ((blank >> _BYTE) | after))[: stop - start]

    def end(self, k: int) -> int:
        """Bytes up to the end of the k-th unit."""
        if k == 0:
            return 0
        if k >= self.n:
            return self.size
        block = int(np.searchsorted(self.upto, k))
        ends = self._ends(block * BLOCK)
        rest = k - (int(self.upto[block - 1]) if block else 0)
        running = np.cumsum(np.bitwise_count(ends), dtype=np.int64)
        word = int(np.searchsorted(running, rest))
        inside = rest - (int(running[word - 1]) if word else 0)
        return (block * BLOCK + word) * 8 + select(int(ends[word]), inside) + 1

    def characters(self, upto: int) -> int:
        """Characters in the first ``upto`` bytes, which end with a character."""
        whole, rest = divmod(upto, 8)
        total = sum(
            int(np.bitwise_count(starts_of_characters(self._block(i, min(i + BLOCK, whole)))).sum(dtype=np.int64))
            for i in range(0, whole, BLOCK)
        )
        if rest:
            last = starts_of_characters(self._block(whole, whole + 1))[0] & np.uint64((1 << 8 * rest) - 1)
            total += int(np.bitwise_count(last))
        return total


def cut_points(data: memoryview | bytes, first: int, second: int) -> tuple[int, int, int]:
    """Units, characters of the prefix and of the middle."""
    units = Units(data)
    a, b = sorted((first % (units.n + 1), second % (units.n + 1)))
    prefix = units.characters(units.end(a))
    return units.n, prefix, units.characters(units.end(b)) - prefix


def _cut_column(text: Column, first: Column, second: Column) -> Column:
    @F.arrow_udf(_CUTS)
    def run(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        rows = [cut_points(memoryview(t.as_buffer()).cast("B"), a, b) for t, a, b in zip(texts, one.to_pylist(), two.to_pylist())]
        names = ["n", "prefix_chars", "middle_chars"]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names)

    return run(text, first, second)


def draw(doc_id: str, seed: int, part: int) -> Column:
    """One of the first four numbers below 2^32 of an id's digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * part - 7, 8), 16, 10).cast("bigint")


def fill_in_middle(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, out: str = "infill"
) -> DataFrame:
    """Adds a struct: n, form, prefix_chars, middle_chars (code points; null if plain), output.

    ``rate`` of 100 texts are transformed, ``spm`` of 100 of those with the suffix first.
    """
    own, cuts = hidden("text", "cuts")
    docs = docs.withColumn(own, F.coalesce(F.col(text), F.lit("")))
    docs = docs.withColumn(cuts, _cut_column(F.col(own), draw(doc_id, seed, 1), draw(doc_id, seed, 2)))
    t, a, m = F.col(own), F.col(f"{cuts}.prefix_chars"), F.col(f"{cuts}.middle_chars")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(t, F.lit(mark))
    plain = (t == "") | marked | (draw(doc_id, seed, 3) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(doc_id, seed, 4) % 100 < spm, "spm").otherwise("psm")
    prefix = F.substring(t, F.lit(1), a.cast("int"))
    middle = F.substring(t, (a + 1).cast("int"), m.cast("int"))
    suffix = F.substring(t, (a + m + 1).cast("int"), F.length(t))
    parts = {"psm": [(PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)], "spm": [(SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle)]}
    output = t
    for name, order in parts.items():
        output = F.when(form == name, F.concat(*[c for mark, part in order for c in (F.lit(mark), part)])).otherwise(output)
    result = F.struct(
        F.col(f"{cuts}.n").alias("n"),
        form.alias("form"),
        F.when(form != "plain", a).alias("prefix_chars"),
        F.when(form != "plain", m).alias("middle_chars"),
        output.alias("output"),
    )
    return docs.withColumn(out, result).drop(own, cuts)


def restored(output: Column, form: Column) -> Column:
    """The text, from the output and its form only."""

    def between(left: str, right: str | None) -> Column:
        tail = F.substring(output, F.locate(left, output) + len(left), F.length(output))
        return tail if right is None else F.substring(tail, F.lit(1), F.locate(right, tail) - 1)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
