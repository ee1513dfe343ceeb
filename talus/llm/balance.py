"""Mixing sources to target weights by balanced sampling (the cube method).

The size of a document is its number of words, and a source's target is its
share of all words by weight: weights go round by the order of the sources (by
code point, null last). No target exceeds ``most`` times its source's size; the
excess is shared out again by weight among the others until none is above.

A source then needs every document ``target / size`` times: the whole part of
that for certain, and the fraction as the probability of one copy more. Which
documents get that copy is a balanced sample: the vector of probabilities moves
along directions that change neither the expected number of documents nor the
expected number of words (the null-space of the balancing constraints) until it
meets a face of the unit cube, where one document is settled; a random choice of
the way keeps every document's probability. This flight takes three open
documents at a time (two constraints and one more), so at most two stay open.

Documents fly in buckets of a bounded number of rows, dealt by a hash, after the
few that are too long for a bucket to balance; what stays open, two a bucket at most, flies again in fewer buckets until every
source has had one bucket alone. Within a bucket the longest fly first, by
classes of size: a document far longer than the others would stay open to the
end. The two open ones of a class land by the cheapest joint distribution that
keeps their probabilities, and the shorter documents' probabilities make up for
the words and documents so gained or lost. What a source's words differ from
its target by is then about the size of its shortest documents, if those suffice.
A sample more than half a per cent off, as of a source with few documents, is
drawn again, up to 64 times, and the nearest is kept (rejective sampling).

Rows that agree in id, source and size are interchangeable: n of them with
probability p are floor(n p) copies for certain and one open document. They are
counted before anything is shuffled and laid out again at the end, in blocks. No
document is taken more than ``most`` times.

All choices come from digests of the source, the bucket and the seed, and rows
are ordered before they fly, so reruns agree whatever the partitioning. A null
or empty text has size 0, takes 0 words, and only counts as a document. Null
ids and null sources are values like others. An empty table gives no rows.
"""

from __future__ import annotations

import random
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
ROWS = 1 << 12  # documents of a bucket, on average
SALT_ROWS = 1 << 20  # documents of a source that meet one copy of its row
COPIES = 1 << 16  # copies of a row laid out at once
TRIES, TOLERANCE = 64, 0.005  # samples of a source drawn at most, and the share of its target that one may be off
NEAR = 1e-9


def _ordered(sources: DataFrame) -> DataFrame:
    """Number of every source in code-point order, null last, without sorting all of them in one task."""
    by = ["missing", "source"]
    spread = cut(
        sources.withColumn("missing", F.col("source").isNull())
        .repartitionByRange(*by)
        .withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition
    counts = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*by)) - 1
    return spread.withColumn("inside", inside).join(offsets, "part").withColumn("number", F.col("offset") + F.col("inside"))


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """source, source_size, documents, weight, target of a table (source, size, copies)."""
    sources = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).cast("bigint").alias("source_size"), F.sum("copies").cast("bigint").alias("documents")
    )
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    known = cut(_ordered(sources).select("source", "source_size", "documents", pick.alias("weight")))
    limit = F.col("source_size") * F.lit(float(most))
    total = known.agg(F.sum("source_size")).first()[0] or 0
    rate = 0.0
    # the words for a unit of weight only grow, so a source once at its limit stays there
    while total:
        full = limit <= F.lit(rate) * F.col("weight")
        spent, open_weight = known.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        new = (total - spent) / open_weight if open_weight else rate
        if new <= rate:
            break
        rate = new
    return known.withColumn("target", F.least(limit, F.lit(rate) * F.col("weight")))


def flight(sizes: list[float], chances: list[float], draw) -> list[float]:
    """Chances moved along the null-space of (number, size) until at most two are neither 0 nor 1."""
    p = [0.0 if c < NEAR else 1.0 if c > 1 - NEAR else c for c in chances]
    open_ = [i for i, c in enumerate(p) if 0 < c < 1]
    held: list[int] = []
    for new in open_:
        held.append(new)
        if len(held) < 3:
            continue
        i, j, k = held
        a, b, c = sizes[i], sizes[j], sizes[k]
        way = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
        _move(p, held, way, draw)
        held = [x for x in held if 0 < p[x] < 1]
    return p


def _move(p: list[float], held: list[int], way: tuple[float, ...], draw) -> None:
    """One step to a face of the cube, forth or back, so that no chance changes on average."""
    forth = back = float("inf")
    for x, u in zip(held, way):
        if u > 0:
            forth, back = min(forth, (1 - p[x]) / u), min(back, p[x] / u)
        elif u < 0:
            forth, back = min(forth, p[x] / -u), min(back, (1 - p[x]) / -u)
    step = forth if draw() * (forth + back) < back else -back
    for x, u in zip(held, way):
        v = p[x] + step * u
        p[x] = 0.0 if v < NEAR else 1.0 if v > 1 - NEAR else v


def landing(sizes: list[float], chances: list[float], draw, over: float = 0.0) -> list[float]:
    """The at most two open ones settled: of the joint distributions with their chances, the one nearest in size.

    ``over`` is what has been taken beyond the chances before.
    """
    p = list(chances)
    last = [i for i, c in enumerate(p) if 0 < c < 1]
    if len(last) == 1:
        p[last[0]] = float(draw() < p[last[0]])
    elif last:
        i, j = last
        due = p[i] * sizes[i] + p[j] * sizes[j] - over
        options = []
        for both in (max(0.0, p[i] + p[j] - 1), min(p[i], p[j])):
            law = [((1, 1), both), ((1, 0), p[i] - both), ((0, 1), p[j] - both), ((0, 0), 1 - p[i] - p[j] + both)]
            options.append((sum(q * (s * sizes[i] + t * sizes[j] - due) ** 2 for (s, t), q in law), law))
        at = draw()
        for (s, t), q in min(options, key=lambda o: o[0])[1]:
            p[i], p[j] = float(s), float(t)
            at -= q
            if at < 0:
                break
    return p


def _paid_back(sizes: list[float], chances: list[float], words: float, documents: float) -> tuple[list[float], float, float]:
    """Open chances shifted by a + b * size so that they take ``words`` and ``documents`` less, and what is still owed."""
    open_ = [i for i, c in enumerate(chances) if 0 < c < 1]
    n, s1, s2 = len(open_), sum(sizes[i] for i in open_), sum(sizes[i] ** 2 for i in open_)
    det = n * s2 - s1 * s1
    if det > 1e-6 * n * s2:
        a, b = (s1 * words - s2 * documents) / det, (s1 * documents - n * words) / det
    else:
        a, b = -words / s1 if s1 else 0.0, 0.0
    p = list(chances)
    for i in open_:
        p[i] = min(1.0, max(0.0, p[i] + a + b * sizes[i]))
        words += (p[i] - chances[i]) * sizes[i]
        documents += p[i] - chances[i]
    return p, words, documents


def settled(sizes: list[float], chances: list[float], draw, last: bool, owed: float = 0.0) -> tuple[list[float], float]:
    """Flight and landing by classes of size, in falling order of size; with the words taken too many, of which ``owed`` before.

    A class spans a factor of two. The two that stay open of it are landed, and
    the words and documents that this takes too many are taken back from the
    chances of the shorter documents, which are moved by nothing on average.
    Those of the last class stay open unless this is the ``last`` bucket.
    """
    p, words, documents, start = list(chances), owed, 0.0, 0
    while start < len(p):
        stop = start + 1
        while stop < len(p) and 2 * sizes[stop] >= sizes[start]:
            stop += 1
        p[start:], words, documents = _paid_back(sizes[start:], p[start:], words, documents)
        own = flight(sizes[start:stop], p[start:stop], draw)
        if last or stop < len(p):
            landed = landing(sizes[start:stop], own, draw, words)
            words += sum((x - c) * s for x, c, s in zip(landed, own, sizes[start:stop]))
            documents += sum(landed) - sum(own)
            own = landed
        p[start:stop] = own
        start = stop
    return p, words


def nearest(sizes: list[float], chances: list[float], draw, owed: float, tolerance: float) -> list[float]:
    """The first sample that takes the expected words within the tolerance, or else the nearest of some."""
    best: tuple[float, list[float]] = (float("inf"), [])
    for _ in range(TRIES):
        p, off = settled(sizes, chances, draw, True, owed)
        best = min(best, (abs(off), p), key=lambda b: b[0])
        if best[0] <= tolerance:
            break
    return best[1]


def _fly(units: DataFrame, seed: int, level: int) -> DataFrame:
    """Every bucket flown, and landed where it is its source's only one; else a row that stays open keeps what the bucket owes."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("order", "ascending"), ("doc_key", "ascending")])
        sizes, chances, owed = rows["size"].to_pylist(), rows["chance"].to_pylist(), rows["owed"].to_pylist()
        draw = random.Random(f"{seed}:{level}:{key[0]}:{key[1]}").random
        if rows["buckets"][0].as_py() == 1:
            chances = nearest(sizes, chances, draw, sum(owed), TOLERANCE * rows["target"][0].as_py())
        else:
            chances, off = settled(sizes, chances, draw, False, sum(owed))
            keeper = next((i for i, c in enumerate(chances) if 0 < c < 1), -1)
            owed = [off if i == keeper else 0.0 for i in range(len(owed))]
        for name, values in (("chance", chances), ("owed", owed)):
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values, pa.float64()))
        return rows

    bucket = F.pmod(F.xxhash64("order", F.lit(level)), F.col("buckets"))
    dealt = units.withColumn("bucket", bucket)
    return dealt.groupBy("source_key", "bucket").applyInArrow(run, dealt.schema).drop("bucket")


def _long_first(open_: DataFrame, seed: int, rows: int, salted) -> tuple[DataFrame, DataFrame]:
    """The longest documents of the sources of several buckets, settled, and the others with chances that make up for it.

    A document longer than a share of 1 / (2 * rows) of its source is one of at
    most 2 * rows, so they fit one bucket; one bucket of the others may be too
    small to balance such a document.
    """
    open_ = cut(open_)
    longest = (F.col("buckets") > 1) & (F.col("size") * (2 * rows) >= F.col("source_size"))
    due = open_.where(longest).withColumns({"buckets": F.lit(1).cast("bigint"), "before": F.col("chance")})
    flown = cut(_fly(due, seed, -1))
    more = F.col("chance") - F.col("before")
    debts = flown.groupBy("source_key").agg(F.sum(more * F.col("size")).alias("words"), F.sum(more).alias("documents"))
    free = open_.where(~longest & (F.col("buckets") > 1) & F.col("chance").between(NEAR, 1 - NEAR)).groupBy("source_key")
    size = F.col("size").cast("double")
    sums = free.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(size).alias("s1"), F.sum(size * size).alias("s2"))
    det = F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")
    tilted = det > 1e-6 * F.col("n") * F.col("s2")
    level = F.when(tilted, (F.col("s1") * F.col("words") - F.col("s2") * F.col("documents")) / det)
    slope = F.when(tilted, (F.col("s1") * F.col("documents") - F.col("n") * F.col("words")) / det)
    shifts = cut(
        debts.join(sums, "source_key").select(
            "source_key",
            F.coalesce(level, F.when(F.col("s1") > 0, -F.col("words") / F.col("s1")), F.lit(0.0)).alias("level"),
            F.coalesce(slope, F.lit(0.0)).alias("slope"),
        )
    )
    rest = open_.where(~longest).join(salted(shifts), ["source_key", "salt"], "left")
    moved = F.col("chance") + F.coalesce(F.col("level") + F.col("slope") * F.col("size"), F.lit(0.0))
    inside = F.col("chance").between(NEAR, 1 - NEAR)
    shifted = F.when(inside, F.least(F.lit(1.0), F.greatest(F.lit(0.0), moved))).otherwise(F.col("chance"))
    return flown.drop("before"), rest.withColumn("chance", shifted).drop("level", "slope")


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    most: int = 3,
    seed: int = 42,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies (times it is in the mix), taken (its words there)."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint")
    own = docs.select(F.col(doc_id).alias("doc"), F.col(source).alias("source"), size.alias("size"))
    units = cut(own.groupBy("doc", "source", "size").agg(F.count(F.lit(1)).alias("copies")))
    known = cut(targets(units, weights=weights, most=most))

    def as_key(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))

    # a source may hold a third of all documents: each source meets its documents under several salts, though never
    # under more than leave the table of sources smaller than that of documents
    held = known.agg(F.count(F.lit(1)).alias("n"), F.max("documents").alias("most"), F.sum("documents").alias("all")).first()
    salts = max(1, min((held.most or 0) // SALT_ROWS, (held.all or 0) // max(1, held.n)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))

    def salted(table: DataFrame) -> DataFrame:
        every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
        return table.withColumn("salt", F.explode(every))

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    spread = salted(
        known.select(
            as_key("source").alias("source_key"),
            "source_size",
            "target",
            rate.alias("rate"),
            F.ceil(F.col("documents") / rows).cast("bigint").alias("buckets"),
        )
    )
    order = F.xxhash64(as_key("doc"), F.lit(seed))
    keyed = units.withColumns({"source_key": as_key("source"), "doc_key": as_key("doc"), "order": order})
    keyed = keyed.withColumn("salt", F.pmod("order", F.lit(salts).cast("bigint"))).join(spread, ["source_key", "salt"])
    due = F.col("copies") * (F.col("rate") - F.floor("rate"))
    sure = F.floor(due + NEAR)
    open_ = keyed.withColumns({"sure": sure, "chance": F.greatest(due - sure, F.lit(0.0)), "owed": F.lit(0.0)})

    done, level, buckets = [], 0, -(-(held.most or 0) // rows)
    if buckets > 1:
        first, open_ = _long_first(open_, seed, rows, salted)
        done.append(first)
    while True:
        flown = cut(_fly(open_, seed, level))
        if buckets <= 1:
            done.append(flown)
            break
        still = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(flown.where(~still))
        open_ = flown.where(still).withColumn("buckets", F.ceil(2 * F.col("buckets") / rows).cast("bigint"))
        level, buckets = level + 1, -(-2 * buckets // rows)
    return _laid_out(reduce(DataFrame.unionByName, done), doc_id)


def _laid_out(done: DataFrame, doc_id: str) -> DataFrame:
    """The counted rows one by one; very many copies of one row are laid out by several tasks."""
    last_block = F.floor((F.col("copies") - 1) / COPIES).cast("bigint")
    blocks = done.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)))
    if (done.agg(F.max("copies")).first()[0] or 0) > COPIES:
        blocks = blocks.repartition("source_key", "doc_key", "size", "block")
    first = F.col("block") * COPIES
    each = blocks.withColumn("copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("copies")) - 1)))
    extra = F.col("copy") < F.col("sure") + F.col("chance").cast("bigint")
    copies = (F.floor("rate") + extra.cast("bigint")).cast("bigint")
    return each.select(
        F.col("doc").alias(doc_id), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
