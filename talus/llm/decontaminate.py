"""Benchmark decontamination with one Aho-Corasick automaton.

Texts become sequences of words (A-Z in lower case; words are runs of digits,
letters and characters beyond ASCII). Every run of ``window`` words of an item
is a pattern; an item with fewer words, but not none, is one pattern. The
automaton works on whole words, reads each text once and reports all
patterns that end at a word, so overlapping and nested ones are found too.
Hits are kept as word positions and as code-point offsets into the original
text.

The items are broadcast in blocks of at most ``block_bytes`` of text. Usually
that is one block; further blocks are scanned one after the other, each over
all texts, so a larger benchmark costs passes, not memory.

Null and empty texts have no words and no hits. Items without words or without
an id have no patterns. Repeated items and items that share a window are all
reported. Texts are read whole, whatever their length. Other columns of the
documents pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.common import cut, hidden

#: Bytes to words: A-Z to lower case, other ASCII that is no digit or letter to a space.
_WORDS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
_PLACES = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_FOUND = "n_words bigint, runs array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>, items array<string>"


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Automaton:
    """All windows of a block of items. Words are single characters if there are enough of those, else numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        import ahocorasick

        split = [(item, words(text)) for item, text in items]
        distinct = sorted({w for _, own in split for w in own})
        self.chars = len(distinct) < 1_000_000
        self.unknown = "\0" if self.chars else 0
        self.known = {w: chr(i + 0x800 * (i >= 0xD800)) if self.chars else i for i, w in enumerate(distinct, 1)}
        patterns: dict[str | tuple[int, ...], set[str]] = {}
        for item, own in split:
            text = self._coded(own)
            for i in range(max(1, len(own) - window + 1) if own else 0):
                patterns.setdefault(text[i : i + window], set()).add(item)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, *([] if self.chars else [ahocorasick.KEY_SEQUENCE]))
        for pattern, owners in patterns.items():
            self.trie.add_word(pattern, (len(pattern), sorted(owners)))
        if patterns:
            self.trie.make_automaton()
        self.empty = not patterns
        self.shortest = min(map(len, patterns), default=0)

    def _coded(self, own: list[bytes]) -> str | tuple[int, ...]:
        known, unknown = self.known.get, self.unknown
        coded = [known(w, unknown) for w in own]
        return "".join(coded) if self.chars else tuple(coded)

    def _runs(self, coded: str | tuple[int, ...]) -> Iterator[tuple[int, int]]:
        """Runs of words that occur in items: a pattern lies within one, and the automaton reads no others."""
        codes = np.frombuffer(coded.encode("utf-32-le"), "<u4") if self.chars else np.array(coded)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], codes != 0, [False]])))
        starts, stops = edges[::2], edges[1::2]
        long = stops - starts >= self.shortest
        return zip(starts[long].tolist(), stops[long].tolist())

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
        """Number of words, disjoint runs of hit words (word numbers and offsets), items found."""
        own = words(text) if isinstance(text, str) else []
        if self.empty or not own:
            return len(own), [], []
        change = None
        items: set[str] = set()
        coded = self._coded(own)
        for start, stop in self._runs(coded):
            for end, (length, owners) in self.trie.iter(coded[start:stop]):
                if change is None:
                    change = np.zeros(len(own) + 1, np.int64)
                change[start + end - length + 1] += 1
                change[start + end + 1] -= 1
                items.update(owners)
        if change is None:
            return len(own), [], []
        hit = np.diff(np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]]))
        first, last = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1) - 1
        places = [m.span() for m in _PLACES.finditer(text)]
        return len(own), [(int(a), int(b), places[a][0], places[b][1]) for a, b in zip(first, last)], sorted(items)


def _scanner(items, window: int):
    ready: dict[int, Automaton] = {}  # one for each worker process

    @F.pandas_udf(_FOUND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        if 0 not in ready:
            ready[0] = Automaton(items.value, window)
        found = [ready[0].scan(t) for t in texts]
        return pd.DataFrame(
            {
                "n_words": [x[0] for x in found],
                "runs": [[{"first": a, "last": b, "start": c, "end": d} for a, b, c, d in x[1]] for x in found],
                "items": [x[2] for x in found],
            }
        )

    return scan.asNondeterministic()  # so that no filter repeats the scan


def _blocks(items: DataFrame, id_column: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items by blocks; only one block's rows come to the driver at a time."""
    own = items.select(F.col(id_column).cast("string").alias("i"), F.col(text).alias("t")).dropna()
    size = own.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    count = int(size) // block_bytes + 1
    numbered = own.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(count)))
    for b in range(count):
        yield [(r.i, r.t) for r in numbered.where(F.col("b") == b).orderBy("i", "t").collect()]


def hit_words(runs: Column) -> Column:
    """Words in the union of the runs of all blocks."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("upto"))

    def add(acc, run):
        return F.struct(
            (acc.n + F.greatest(run["last"] - F.greatest(run["first"], acc.upto + 1) + 1, F.lit(0))).alias("n"),
            F.greatest(acc.upto, run["last"]).alias("upto"),
        )

    return F.aggregate(F.array_sort(runs), zero, add, lambda acc: acc.n)


def find_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    out: str = "found",
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """Adds a struct: n_words, n_hit, runs (word numbers and offsets), items (ids as sorted strings)."""
    spark = docs.sparkSession
    scans: list[str] = []
    for block in _blocks(items, item_id, item_text, block_bytes):
        docs = cut(docs) if scans else docs  # one automaton in memory at a time
        (name,) = hidden("scan")
        docs = docs.withColumn(name, _scanner(spark.sparkContext.broadcast(block), window)(F.col(text)))
        scans.append(name)
    every = [F.col(s) for s in scans]
    runs = F.flatten(F.array(*[c["runs"] for c in every]))
    found = F.struct(
        every[0]["n_words"].alias("n_words"),
        hit_words(runs).alias("n_hit"),
        F.array_sort(runs).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[c["items"] for c in every])))).alias("items"),
    )
    return docs.withColumn(out, found).drop(*scans)


def contaminated(found: Column, share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (found["n_hit"] > 0) & (found["n_hit"] * share >= found["n_words"])


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    (found,) = hidden("found")
    return find_items(docs, items, out=found, **options).where(~contaminated(F.col(found))).drop(found)
