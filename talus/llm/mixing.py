"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A text is a sequence of tokens: words (A-Z in lower case, separated by ASCII
white space), then one end. The ``words`` most frequent ones of the training
part, the end and an escape have a Huffman code; any other word is the escape
and then its bytes, which have a Huffman code of their own. So a text is a
sequence of binary decisions, each at a node of a code.

Three predictors see a decision in different contexts (words: none, the last
word, the last two; bytes: the last two, three or four bytes of the word).
Context and node are hashed to a slot that counts decisions and ones. The
stretched predictions are weighted with weights chosen by a gate (the level in
the code), squashed, and refined by an adaptive probability map over gate and
prediction.

Training goes once over all training texts. Each task predicts every batch of
its own texts from the counts it has so far, moves weights (online Newton steps)
and map, and then adds the batch to its counts; tables are summed over tasks, weights averaged by
the decisions behind them. Tables travel in blocks of slots, summed in a sorted
stream, and have a fixed size. Word counts are summed by a hash aggregation and
stay distributed; only the ``words`` most frequent come to the driver.

Any other word of the corpus is remembered by its count, so the model grows with
the corpus. After an escape, the word is either new, and spelled, or one of the
``rest`` words seen before, in proportion to their counts n:

    p = new * p(spelling) + (1 - new) * n / rest

where new is the share of words seen once among ``rest`` (Good-Turing). Counts
meet the words of the texts in a join.

Scoring starts each text from the trained state and refines the mixture within
the text, segment by segment, with a scale learned from the decisions before. The result is the sum
of log10 probabilities, so total bits per byte are -score * log2(10) / bytes.

A null text is empty: the end alone. Repeated rows count each time. Nothing to
train on leaves uniform predictors, and a base score of 0.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import cut

SLOTS = 1 << 18  # for each predictor
PREDICTORS = 3
GATES = 32  # 20 levels of the word code, 12 of the byte code
_BLOCK = 1 << 12
_BATCH = 200_000  # tokens to learn from at once
_SCORED = 400_000  # tokens to score at once
_STEP = 1 << 15  # decisions for each move of the weights
_BINS = 24
_LONGEST = 1023  # decisions of a code; a Huffman code is as long as its total weight is a Fibonacci number at most
_END = b""


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []


def huffman(weights: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each symbol: first places, then inner nodes and bits from the root on, one after the other."""
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    upper = len(weights)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (upper, 0), (upper, 1)
        heapq.heappush(heap, (a + b, upper))
        upper += 1
    first, nodes, bits = [0], [], []
    for i in range(len(weights)):
        path = []
        while i in parent:
            i, bit = parent[i]
            path.append((i, bit))
        nodes += [n for n, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
        first.append(len(nodes))
    return np.array(first), np.array(nodes, np.uint32), np.array(bits, np.uint8)


def _hashed(code, salt: int):
    first, nodes, bits = code
    return first, nodes * np.uint32(0x85EBCA77) + np.uint32(salt), bits


class Vocabulary:
    """Counts of the most frequent words, and the codes of words and bytes."""

    def __init__(self, counts: list[tuple[bytes, int]], total: int, distinct: int, once: int = 0) -> None:
        """once: words seen once that are not among ``counts``."""
        self.total, self.distinct = total, distinct
        listed = sorted(((w, c) for w, c in counts if w != _END), key=lambda x: (-x[1], x[0]))
        self.number = {w: i for i, (w, _) in enumerate(listed)}
        self.end, self.escape = len(listed), len(listed) + 1
        self.ends = ends = dict(counts).get(_END, 0)
        self.rest = rest = max(total - ends - sum(c for _, c in listed), 0)
        self.new = (once + 1) / (rest + 1)
        self.word_code = _hashed(huffman([c for _, c in listed] + [ends + 1, rest + 1]), 0)
        letters = np.ones(256)
        for w, c in listed[: 1 << 13]:
            np.add.at(letters, np.frombuffer(w + b" ", np.uint8), c)
        self.byte_code = _hashed(huffman([int(x) for x in letters]), 0x5BD1E995)
        #: log10 of the base probability of each symbol; nothing for the escape
        self.base_of = np.append(self.base(np.array([c for _, c in listed] + [ends], float)), 0.0)

    def base(self, count: float | np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return x ^ (x >> np.uint32(13))


def _before(values: np.ndarray, owner: np.ndarray, by: int) -> np.ndarray:
    """The value some places earlier in the same text or word, or 0."""
    out = np.zeros_like(values)
    if len(values) > by:
        same = owner[by:] == owner[:-by]
        out[by:][same] = values[:-by][same]
    return out


class Run:
    """A run of coded symbols with their contexts. Decisions come level by level of the code; a level is a gate."""

    def __init__(self, code, symbols: np.ndarray, contexts: list[np.ndarray], owner: np.ndarray, gates: range) -> None:
        self.code, self.symbols, self.contexts, self.owner, self.gates = code, symbols, contexts, owner, gates

    def lengths(self) -> np.ndarray:
        return np.diff(self.code[0])[self.symbols]

    def levels(self) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
        """Gate, number of symbols that go on, slots by predictor, bits. Needs symbols in the order of ``falling``."""
        first, nodes, bits = self.code
        shift = np.uint32(32 - SLOTS.bit_length() + 1)
        start = first[self.symbols]
        going = len(start) - np.cumsum(np.bincount(self.lengths(), minlength=1))
        for depth, n in enumerate(going):
            if not n:
                return
            place = start[:n] + depth
            node = nodes.take(place, mode="clip")
            slots = []
            for c in self.contexts:
                slot = c[:n] ^ node
                slot *= np.uint32(0x9E3779B1)
                slot >>= shift
                slots.append(slot)
            yield self.gates[min(depth, len(self.gates) - 1)], n, slots, bits.take(place, mode="clip")

    def falling(self) -> Run:
        """Longest codes first: those that go on are then always the first ones, and need no copies."""
        return self.part(np.argsort((_LONGEST - self.lengths()).astype(np.uint16), kind="stable"))

    def part(self, at: np.ndarray) -> Run:
        """Some of the symbols."""
        return Run(self.code, self.symbols[at], [c[at] for c in self.contexts], self.owner[at], self.gates)


def runs(texts: list[list[bytes]], vocabulary: Vocabulary) -> tuple[list[Run], np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """The words and the bytes of spelled words; then symbols, owners, spelled words, their owners, the word of each byte."""
    number, escape, end = vocabulary.number.get, vocabulary.escape, vocabulary.end
    flat = list(chain.from_iterable(texts))
    size = np.array([len(own) for own in texts])
    owner = np.repeat(np.arange(len(texts)), size + 1)
    symbols = np.full(len(owner), end)
    symbols[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), size)] = np.fromiter(map(number, flat, repeat(escape)), np.int64, len(flat))
    spelled = np.flatnonzero(symbols == escape)
    rare = [flat[i] for i in spelled - owner[spelled]]  # ends of earlier texts stand between the words
    hashes = symbols.astype(np.uint32) * np.uint32(0xC2B2AE35) + np.uint32(1)
    hashes[spelled] = np.array([zlib.crc32(w) for w in rare], np.uint32)
    last, older = _before(hashes, owner, 1), _before(hashes, owner, 2)
    contexts = [np.full(len(symbols), 0x1234567, np.uint32), _mix(last), _mix(last * np.uint32(3) + _mix(older))]
    words = Run(vocabulary.word_code, symbols, contexts, owner, range(20))
    if not rare:
        return [words], symbols, owner, rare, owner[spelled], spelled
    data = np.frombuffer(b"".join([w + b" " for w in rare]), np.uint8)
    word = np.repeat(np.arange(len(rare)), [len(w) + 1 for w in rare])
    chars = data.astype(np.uint32) + np.uint32(1)
    one, two, three, four = (_before(chars, word, n) for n in (1, 2, 3, 4))
    pair = one + (two << np.uint32(9))
    triple = pair + (three << np.uint32(18))
    contexts = [_mix(pair + np.uint32(1 << 20)), _mix(triple + np.uint32(1 << 29)), _mix(_mix(triple + np.uint32(1 << 30)) + four)]
    spelling = Run(vocabulary.byte_code, data.astype(np.int64), contexts, owner[spelled][word], range(20, GATES))
    return [words, spelling], symbols, owner, rare, owner[spelled], word


def _squash(clipped: np.ndarray) -> np.ndarray:
    one = np.float32(1)
    out = np.negative(clipped)
    np.exp(out, out=out)
    out += one
    return np.divide(one, out, out=out)


class Mixer:
    """Counts of each slot, weights of each gate, and the map that refines."""

    def __init__(self) -> None:
        self.counts = np.zeros((2, PREDICTORS, SLOTS), np.int64)  # decisions, ones
        self.weights = np.full((GATES, PREDICTORS), 0.4)
        self.map = np.zeros((2, GATES, _BINS))
        self.curve = np.tile(np.eye(PREDICTORS) * 20, (GATES, 1, 1))

    def stretched(self) -> np.ndarray:
        """log odds that each slot predicts"""
        n, ones = self.counts
        out = ones.astype(np.float32) + np.float32(0.4)
        out /= (n - ones).astype(np.float32) + np.float32(0.4)
        return np.log(out, out=out)

    @staticmethod
    def _bin(clipped: np.ndarray) -> np.ndarray:
        """Bin of a mixed prediction; the upper end of the range is one more."""
        return ((clipped + np.float32(12)) * np.float32(_BINS / 24)).astype(np.int32)

    def learn(self, run: Run) -> int:
        """Predicts, then moves the weights by an online Newton step every ``_STEP`` decisions, then counts."""
        table = self.stretched()
        slots: list[list[np.ndarray]] = []
        ones: list[np.ndarray] = []
        room = np.empty((PREDICTORS, _STEP), np.float32)
        for gate, n, level, bits in run.falling().levels():
            for a in range(0, n, _STEP):
                y = bits[a : a + _STEP]
                part = room[:, : len(y)]
                for p in range(PREDICTORS):
                    table[p].take(level[p][a : a + _STEP], out=part[p], mode="clip")  # slots are within the table; the mode is the fast one
                mixed = self.weights[gate].astype(np.float32) @ part
                np.clip(mixed, -12, 12, out=mixed)
                chance = _squash(mixed)
                self.curve[gate] = 0.999 * self.curve[gate] + part * (chance * (1 - chance)) @ part.T
                self.weights[gate] += np.linalg.solve(self.curve[gate] + np.eye(PREDICTORS), part @ (y - chance))
                at = np.minimum(self._bin(mixed), _BINS - 1) * 2 + y
                zeros, hits = np.bincount(at, minlength=2 * _BINS).reshape(-1, 2).T
                self.map[:, gate] += zeros + hits, hits
            slots.append(level)
            ones.append(bits)
        one = np.concatenate(ones) if ones else np.zeros(0, np.uint8)
        for p in range(PREDICTORS if ones else 0):
            own = np.concatenate([level[p] for level in slots], dtype=np.int64)  # the type that bincount works with
            own <<= 1
            own += one
            seen = np.bincount(own, minlength=2 * SLOTS).reshape(-1, 2)
            self.counts[0, p] += seen.sum(axis=1)
            self.counts[1, p] += seen[:, 1]
        return len(one)

    def log10(self, run: Run, table: np.ndarray, texts: int, unit: np.ndarray | None = None) -> np.ndarray:
        """Sum over the decisions of each text, or of each unit of symbols. table: stretched predictions of all slots."""
        unit = run.owner if unit is None else unit
        total = np.zeros(texts if unit is run.owner else int(unit.max(initial=-1)) + 1)
        if not len(run.owner):
            return total
        # segments of a text by its symbols: the first 64, the next 128, ...
        start = np.concatenate([[True], run.owner[1:] != run.owner[:-1]])
        first = np.maximum.accumulate(np.where(start, np.arange(len(start)), 0))
        segments = np.log2((np.arange(len(start)) - first) // 64 + 1).astype(np.int8)
        key = segments.astype(np.uint16) << np.uint16(10) | (_LONGEST - run.lengths()).astype(np.uint16)
        order = np.argsort(key, kind="stable")  # by segment; within, as in falling()
        edges = np.append(0, np.cumsum(np.bincount(segments)))
        scale, curve = np.ones(texts, np.float32), np.full(texts, 400.0)
        weights, half, prior, one = self.weights.astype(np.float32), np.float32(0.5), np.float32(16), np.float32(1)
        # the refined prediction is half the plain one, half the map's: lift + keep * plain, by bin (the upper end is one more)
        n, ones = np.pad(self.map, ((0, 0), (0, 0), (0, 1)), "edge").astype(np.float32)
        keep, lift = half + half * prior / (n + prior), half * ones / (n + prior)
        for a, b in zip(edges, edges[1:]):
            own = run.part(order[a:b])
            size = scale[own.owner]
            slope, bend = np.zeros((2, b - a), np.float32)
            logs, chance = np.zeros(b - a), np.ones(b - a)
            for depth, (gate, n, level, y) in enumerate(own.levels()):
                x = table[0].take(level[0], mode="clip")
                x *= weights[gate, 0]
                for p in range(1, PREDICTORS):
                    more = table[p].take(level[p], mode="clip")
                    more *= weights[gate, p]
                    x += more
                mixed = x * size[:n]
                np.clip(mixed, -12, 12, out=mixed)
                plain = _squash(mixed)
                at = self._bin(mixed)
                p = keep[gate].take(at, mode="clip")
                p *= plain
                p += lift[gate].take(at, mode="clip")
                p -= one - y
                chance[:n] *= np.abs(p, out=p)  # p of a one, 1 - p of a zero
                if depth % 32 == 31:  # before a product of so many can vanish
                    logs += np.log10(chance)
                    chance[:] = 1
                if b < len(order):
                    slope[:n] += (y - plain) * x
                    plain *= one - plain
                    x *= x
                    x *= plain
                    bend[:n] += x
            total += np.bincount(unit[order[a:b]], logs + np.log10(chance), len(total))
            if b < len(order):  # a Newton step of the scale of each text
                curve += np.bincount(own.owner, bend, texts)
                scale += (np.bincount(own.owner, slope, texts) / curve).astype(np.float32)
        return total

    def blocks(self, decisions: int) -> Iterator[tuple[int, bytes]]:
        flat = self.counts.reshape(2, -1)
        for b in range(flat.shape[1] // _BLOCK):
            part = flat[:, b * _BLOCK : (b + 1) * _BLOCK]
            if part[0].any():
                yield b, part.tobytes()
        yield -1, np.concatenate([[decisions], (self.weights * decisions).ravel(), self.map.ravel()]).astype("<f8").tobytes()

    @staticmethod
    def of(rows: list[tuple[int, bytes]]) -> Mixer:
        got = Mixer()
        flat = got.counts.reshape(2, -1)
        for b, data in rows:
            if b >= 0:
                part = np.frombuffer(data, "<i8").reshape(2, -1)
                flat[:, b * _BLOCK : (b + 1) * _BLOCK] = part
            else:
                part = np.frombuffer(data, "<f8")
                size = GATES * PREDICTORS
                if part[0]:
                    got.weights = (part[1 : size + 1] / part[0]).reshape(GATES, PREDICTORS)
                got.map = part[size + 1 :].reshape(2, GATES, _BINS)
        return got


def _sum_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the parts of each block; rows come sorted by block."""
    now, total = None, None
    for batch in batches:
        for block, data in zip(batch["block"], batch["data"]):
            part = np.frombuffer(data, "<f8" if block < 0 else "<i8")
            if block != now:
                if now is not None:
                    yield pd.DataFrame({"block": [now], "data": [total.tobytes()]})
                now, total = block, part.copy()
            else:
                total += part
    if now is not None:
        yield pd.DataFrame({"block": [now], "data": [total.tobytes()]})


def _batches(texts: Iterator[list[bytes]], most: int) -> Iterator[list[list[bytes]]]:
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t) + 1
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def count_tokens(texts: DataFrame) -> DataFrame:
    """Stored (token, n) of all texts of column t."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["t"]:
                seen.update(tokens(text))
            seen[_END] += len(batch)
            if len(seen) > 500_000:
                yield pd.DataFrame(seen.items(), columns=["token", "n"])
                seen.clear()
        yield pd.DataFrame(seen.items(), columns=["token", "n"]).astype({"n": "int64"})

    return cut(texts.mapInPandas(count, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n")))


def vocabulary(counts: DataFrame, words: int) -> Vocabulary:
    """Takes the words above the count that at most ``words`` words reach, and the end."""
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 1024).alias("level")
    levels = counts.groupBy(level).agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("n"), F.min("n").alias("least")).toPandas()
    levels = levels.sort_values("level", ascending=False)
    inside = levels[levels["tokens"].cumsum() <= words]
    least = int(inside["least"].min()) if len(inside) else 1 << 62
    top = counts.where((F.col("n") >= least) | (F.col("token") == F.lit(_END))).toPandas()
    frequent = [(bytes(t), int(n)) for t, n in zip(top["token"], top["n"])]
    once = int(levels["tokens"][levels["n"] == levels["tokens"]].sum()) if least > 1 else 0
    once -= dict(frequent).get(_END, 0) == 1 < least
    return Vocabulary(frequent, int(levels["n"].sum()), int(levels["tokens"].sum()), once)


def train(texts: DataFrame, words) -> Mixer:
    """texts: column t. words: the broadcast vocabulary."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixer, decisions = Mixer(), 0
        for own in _batches((tokens(t) for batch in batches for t in batch["t"]), _BATCH):
            for run in runs(own, words.value)[0]:
                decisions += mixer.learn(run)
        if decisions:
            for block, data in mixer.blocks(decisions):
                yield pd.DataFrame({"block": [block], "data": [data]})

    parts = texts.mapInPandas(learn, "block bigint, data binary").repartition("block").sortWithinPartitions("block")
    return Mixer.of([(r.block, bytes(r.data)) for r in parts.mapInPandas(_sum_blocks, "block bigint, data binary").toLocalIterator()])


def score(
    docs: DataFrame, held_out, *, doc_id: str = "doc_id", text: str = "text", words: int = 1 << 17
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes. Learns where ``held_out`` is false."""
    context = docs.sparkSession.sparkContext
    own = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), held_out.alias("h"))
    learned = own.where("NOT h").select("t")
    counts = count_tokens(learned)
    vocab = context.broadcast(vocabulary(counts, words))
    mixer = context.broadcast(train(learned, vocab))
    total, distinct, new, others = vocab.value.total, vocab.value.distinct, vocab.value.new, vocab.value.rest

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, m = vocab.value, mixer.value
        table = m.stretched()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            at = 0
            for split in _batches((tokens(t) for t in batch["t"]), _SCORED):
                coded, symbols, owner, rare, owners, word = runs(split, v)
                rest: list[dict[bytes, list[float]]] = [{} for _ in split]
                if rare:
                    for w, d, s in zip(rare, owners, m.log10(coded[1], table, len(split), word).tolist()):
                        rest[d].setdefault(w, []).append(s)
                size = np.array([len(t) + 1 for t in split])
                part = batch.iloc[at : at + len(split)]
                yield pd.DataFrame(
                    {
                        "d": part["d"].to_numpy(),
                        "h": part["h"].to_numpy(),
                        "n_tokens": size,
                        "sure": size - np.bincount(owners, minlength=len(split)) - (v.ends == 0),
                        "low": np.bincount(owner, v.base_of[symbols] * (symbols != v.escape), len(split)),
                        "rest": [[{"token": w, "s": s} for w, s in r.items()] for r in rest],
                        "score": m.log10(coded[0], table, len(split)),
                        "n_bytes": [len(t.encode("utf-8", "surrogatepass")) if isinstance(t, str) else 0 for t in part["t"]],
                        "row": row + np.arange(len(split)),
                    }
                )
                at += len(split)
                row += len(split)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"d {kind}, h boolean, n_tokens bigint, sure bigint, low double, rest array<struct<token:binary,s:array<double>>>, score double, n_bytes bigint, row bigint"
    rated = cut(own.mapInPandas(rate, schema))
    rare = rated.select("row", F.explode("rest").alias("r")).select("row", "r.*")
    chance = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
    seen = F.log10((1 - F.lit(new)) * F.col("n") / F.lit(max(others, 1)))  # null for a word without a count, or if all are new

    def known_or_new(spelled):
        """log10 of the sum of both ways, whatever their size."""
        s = spelled + F.log10(F.lit(new))
        return F.when(seen.isNull(), s).otherwise(F.greatest(s, seen) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(s - seen))))

    more = rare.join(counts, "token", "left").groupBy("row").agg(
        F.sum(F.size("s") * chance).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.size("s"))).alias("found"),
        F.sum(F.aggregate("s", F.lit(0.0), lambda a, s: a + known_or_new(s))).alias("spelled"),
    )
    return rated.drop("rest").join(more, "row", "left").select(
        F.col("d").alias(doc_id),
        F.col("h").alias("held_out"),
        "n_tokens",
        (F.col("sure") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("low") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("spelled", F.lit(0.0))).alias("score"),
        "n_bytes",
    )
