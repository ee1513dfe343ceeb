"""SimHash near-duplicates: fingerprints, BK-trees within shards, connected components.

Fingerprint: words of the text (A-Z in lower case, separated by ASCII white
space), shingles of ``shingle`` words with repeats, XXH64 with seed 42 of each;
a bit is 1 if more than half of the hashes have it. A text with fewer words is
one shingle; without words the fingerprint is 0, linked like any other.

Links: all pairs of distinct fingerprints within ``radius`` bits. The 64 bits
are cut into radius + 2 blocks; two fingerprints that differ in at most radius
bits agree in at least two blocks, so each fingerprint goes to one shard for
every pair of blocks and its values there. Each shard is a BK-tree: children
are keyed by the integer Hamming distance to the parent, and a search with
radius r follows only edges from d - r to d + r. Trees are not broadcast, as
the number of fingerprints grows with the corpus: a shard's fingerprints are
brought to the tree instead. Small shards are searched together, level by
level; a large shard is searched node by node. A shard reports a star for each
group of linked fingerprints, so copies never become pairs.

Components: large-star and small-star rounds on the reported links, stored
between rounds, until nothing changes. Rows with equal fingerprints are joined
to their component by fingerprint.

Null texts count as empty. Rows with a null id get a component, but are not its
smallest id; a component without ids has a null one. Repeated ids and rows are
kept. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import cut, hidden

_SMALL = 256  # shards up to this size are searched together
_BATCH = 1 << 22  # squares of shard sizes in one such search


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash, as an unsigned number."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not words:
        return 0
    if len(words) < shingle:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, text: str = "text", shingle: int = 4, out: str = "simhash") -> DataFrame:
    """Adds the fingerprint as a signed 64-bit number."""

    @F.pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).astype(np.int64))

    return docs.withColumn(out, simhash.asNondeterministic()(F.col(text)))


def block_masks(radius: int) -> list[int]:
    """One mask for each pair of the radius + 2 blocks of the 64 bits."""
    edges = np.linspace(0, 64, radius + 3).round().astype(int)
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place reachable through the links a - b."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def search_forest(values: np.ndarray, shard: np.ndarray, radius: int) -> np.ndarray:
    """BK-trees of many shards at once. values: sorted by shard, distinct within one. Returns a root place for each."""
    n = len(values)
    member = np.arange(n)
    tree = np.unique(shard, return_inverse=True)[1]  # the subtree that holds each member not yet placed
    query, at = np.arange(n), tree.copy()  # searches, and the subtree each has come to
    a, b = [], []
    while len(member) and len(query):
        top = np.concatenate([[True], tree[1:] != tree[:-1]])
        roots = member[top]
        d = _distance(values[query], values[roots[at]])
        near = d <= radius
        a.append(query[near])
        b.append(roots[at[near]])
        rest = member[~top]
        parent = tree[~top]
        edge = _distance(values[rest], values[roots[parent]])
        order = np.lexsort((rest, edge, parent))
        rest, key = rest[order], (parent.astype(np.int64) * 128 + edge)[order]
        keys, tree = np.unique(key, return_inverse=True)
        member = rest
        low = np.searchsorted(keys, at.astype(np.int64) * 128 + np.maximum(d - radius, 0))
        high = np.searchsorted(keys, at.astype(np.int64) * 128 + np.minimum(d + radius, 127), "right")
        count = high - low
        query = np.repeat(query, count)
        at = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    return _settle(np.arange(n), np.concatenate([*a, [0]]).astype(np.int64), np.concatenate([*b, [0]]).astype(np.int64)) if n else member


def search_tree(values: np.ndarray, radius: int) -> np.ndarray:
    """One BK-tree, node by node, with all of its members as searches; nothing of the size of the pairs is kept."""
    label = np.arange(len(values))
    every = np.arange(len(values))
    open_nodes = [(every, every)]
    while open_nodes:
        members, queries = open_nodes.pop()
        root = values[members[0]]
        d = _distance(values[queries], root)
        linked = label[np.append(queries[d <= radius], members[0])]
        low = linked.min()
        if (linked != low).any():
            label[np.isin(label, np.unique(linked))] = low
        rest = members[1:]
        edge = _distance(values[rest], root)
        order = np.argsort(edge, kind="stable")
        keys, starts = np.unique(edge[order], return_index=True)
        for k, child in zip(keys, np.split(rest[order], starts[1:])):
            inside = queries[np.abs(d - k) <= radius]
            if len(inside):
                open_nodes.append((child, inside))
    return label


def _stars(values: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    at = np.flatnonzero(label != np.arange(len(label)))
    return pd.DataFrame({"a": values[at].astype(np.int64), "b": values[label[at]].astype(np.int64)})


def _search(radius: int):
    def flush(groups: list[np.ndarray]) -> pd.DataFrame:
        values = np.concatenate(groups)
        return _stars(values, search_forest(values, np.repeat(np.arange(len(groups)), [len(g) for g in groups]), radius))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; the last shard of a batch may go on in the next one."""
        small: list[np.ndarray] = []
        size = 0
        open_key, open_parts = None, []

        def done(values: np.ndarray):
            nonlocal size
            if 2 <= len(values) <= _SMALL:
                small.append(values)
                size += len(values) ** 2
            elif len(values) > _SMALL:
                yield _stars(values, search_tree(values, radius))
            if size >= _BATCH:
                yield flush(small)
                small.clear()
                size = 0

        def every():
            nonlocal open_key, open_parts
            for batch in batches:
                if not batch.num_rows:
                    continue
                part, key, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                value = value.astype(np.uint64)
                starts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (key[1:] != key[:-1])]))
                ends = np.append(starts[1:], len(part))
                for s, e in zip(starts, ends):
                    if (now := (part[s], key[s])) != open_key:
                        if open_parts:
                            yield from done(np.concatenate(open_parts))
                        open_key, open_parts = now, []
                    open_parts.append(value[s:e])
            if open_parts:
                yield from done(np.concatenate(open_parts))
            if small:
                yield flush(small)

        for found in every():
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    return search


def links(values: DataFrame, radius: int = 4) -> DataFrame:
    """Stars (a to b) that connect all fingerprints of column v within ``radius`` bits. v: distinct."""
    masks = [F.lit(_signed(m)) for m in block_masks(radius)]
    shards = values.select(
        "v", F.posexplode(F.array(*[F.col("v").bitwiseAND(m) for m in masks])).alias("part", "key")
    ).select("part", "key", "v")
    placed = shards.repartition("part", "key").sortWithinPartitions("part", "key", "v")
    return placed.mapInArrow(_search(radius), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """Columns a and b become (a, root) for each a that is not a root; root is the smallest signed number."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    state = cut(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    digest = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = state.agg(digest.alias("s")).first().s
    while before[0]:
        both = state.union(state.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = cut(large.where("a <> b").distinct())
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        state = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        after = state.agg(digest.alias("s")).first().s
        if after == before:
            break
        before = after
    return state.select("a", F.col("b").alias("root"))


def classes(prints: DataFrame, *, doc_id: str = "doc_id", simhash: str = "simhash", radius: int = 4) -> DataFrame:
    """(v, component_id) for each distinct fingerprint of a stored table of ids and fingerprints."""
    values = cut(prints.groupBy(F.col(simhash).alias("v")).agg(F.min(doc_id).alias("low")))
    roots = components(links(values.select("v"), radius))
    rooted = values.join(roots, F.col("v") == F.col("a"), "left").select("v", "low", F.coalesce("root", "v").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(least, "root").select("v", "component_id")


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """One row per document: its id, fingerprint (16 hexadecimal digits) and component_id."""
    own = fingerprints(docs.select(doc_id, text), text=text, shingle=shingle)
    prints = cut(own.select(doc_id, "simhash"))
    found = classes(prints, doc_id=doc_id, radius=radius)
    return prints.join(found, F.col("simhash") == F.col("v")).select(
        doc_id, F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """One document of each component, the one with the smallest id, with its own columns.

    Rows that share that id are told apart by a digest of their text, and of
    rows equal in both any one stays. A component without ids keeps one row.
    """
    component, n, mark, row = hidden("component", "n", "mark", "row")
    digest = F.coalesce(F.sha2(F.col(text), 256), F.lit("")).alias(mark)
    own = fingerprints(docs.select(doc_id, text, digest), text=text, shingle=shingle)
    prints = cut(own.select(doc_id, mark, "simhash"))
    found = classes(prints, doc_id=doc_id, radius=radius)
    same = (F.col("simhash") == F.col("v")) & F.col(doc_id).eqNullSafe(F.col("component_id"))
    per_text = prints.join(found, same).groupBy("component_id", mark).agg(F.count(F.lit(1)).alias(n))
    first = per_text.groupBy("component_id").agg(F.min(F.struct(mark, n)).alias(row))
    first = cut(first.select(F.col("component_id").alias(component), f"{row}.*"))
    kept = docs.withColumn(f"{mark}x", digest).join(
        first.withColumnRenamed(mark, f"{mark}y"),
        F.col(doc_id).eqNullSafe(F.col(component)) & (F.col(f"{mark}x") == F.col(f"{mark}y")),
    )
    keys = [component, n, f"{mark}x", f"{mark}y"]
    equal = kept.where(F.col(n) > 1)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = equal.groupBy(component, f"{mark}x").agg(F.first(whole).alias(row)).select(f"{row}.*")
    return kept.where(F.col(n) == 1).drop(*keys).unionByName(one)
