"""Text quality by attention-based multiple-instance learning.

A text is a bag of passages of ``passage`` characters. Each passage is encoded
as hashed character bigrams (square roots of counts, scaled to length 1) and
mapped to a hidden vector h. A gated attention weight

    a = softmax over passages of  w . (tanh(V h) * sigmoid(U h))

is learned from labels of whole texts; the weighted sum of the hidden vectors
is the representation that a logistic output scores.

The model is fitted in one task on a bounded sample of whole texts: of the
``sample`` labelled texts whose ids hash lowest, those that come first and have
``passages`` passages at most between them. A text that has more on its own is
no part of the sample. Scoring encodes all passages of all texts.

A null text is empty: one passage without bigrams. Labels that are null teach
nothing, of several labels of one id the largest counts. Without labels, every
score is 0.5. Repeated rows are scored alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.common import cut

FEATURES = 512
_CHARS = 1 << 20
_NAMES = ("w1", "b1", "v", "u", "w", "c", "d")


def encode(texts: list[str], passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed bigrams (passages by features), and the text of each passage."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    passages = np.maximum(1, -(-size // passage))
    owner = np.repeat(np.arange(len(texts)), size)
    first = np.cumsum(passages) - passages
    place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    at = first[owner] + place // passage
    hashed = (codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - FEATURES.bit_length() + 1)
    inside = at[:-1] == at[1:]
    n = int(passages.sum())
    counts = np.bincount(at[:-1][inside] * FEATURES + hashed[inside], minlength=n * FEATURES)
    return counts.reshape(n, FEATURES), np.repeat(np.arange(len(texts)), passages)


def scaled(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(m: dict[str, np.ndarray], x: np.ndarray, owner: np.ndarray, texts: int):
    """Score of each text, and what the gradient needs. owner: sorted, every text has passages."""
    h = np.tanh(x @ m["w1"] + m["b1"])
    t, g = np.tanh(h @ m["v"]), _sigmoid(h @ m["u"])
    e = (t * g) @ m["w"]
    first = np.searchsorted(owner, np.arange(texts))
    e = np.exp(e - np.maximum.reduceat(e, first)[owner])
    a = e / np.add.reduceat(e, first)[owner]
    z = np.add.reduceat(a[:, None] * h, first)
    return _sigmoid(z @ m["c"] + m["d"]), (h, t, g, a, z)


def gradient(m, x, owner, y) -> dict[str, np.ndarray]:
    p, (h, t, g, a, z) = forward(m, x, owner, len(y))
    out = (p - y) / len(y)
    dz = out[:, None] * m["c"]
    da = (dz[owner] * h).sum(axis=1)
    first = np.searchsorted(owner, np.arange(len(y)))
    de = a * (da - np.add.reduceat(a * da, first)[owner])
    dt, dg = de[:, None] * m["w"] * g * (1 - t * t), de[:, None] * m["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz[owner] + dt @ m["v"].T + dg @ m["u"].T) * (1 - h * h)
    return {
        "w1": x.T @ dh, "b1": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ out, "d": out.sum(keepdims=True),
    }


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 16, epochs: int = 30, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Adam on batches of 64 texts, in a fixed order of random numbers."""
    rng = np.random.default_rng(0)
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    m = {"w1": draw(FEATURES, hidden) * 4, "b1": np.zeros(hidden, np.float32), "v": draw(hidden, hidden), "u": draw(hidden, hidden), "w": draw(hidden), "c": draw(hidden), "d": np.zeros(1, np.float32)}
    one = {k: np.zeros_like(v) for k, v in m.items()}
    two = {k: np.zeros_like(v) for k, v in m.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            own = order[at : at + 64]
            x = scaled(np.concatenate([bags[i] for i in own]))
            owner = np.repeat(np.arange(len(own)), [len(bags[i]) for i in own])
            step += 1
            for k, d in gradient(m, x, owner, labels[own]).items():
                d = d + 1e-5 * m[k]
                one[k] = 0.9 * one[k] + 0.1 * d
                two[k] = 0.999 * two[k] + 0.001 * d * d
                lower = rate * (1 - epoch / epochs) / (1 - 0.9**step)
                m[k] = (m[k] - lower * one[k] / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def _text(t) -> str:
    return t if isinstance(t, str) else ""


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    sample: int = 4000, passages: int = 1 << 16, passage: int = 400,
) -> dict[str, np.ndarray] | None:
    """``learn`` marks the label rows to learn from. None without labels."""
    known = labels.where(learn & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y"))
    low = F.xxhash64("id")
    chosen = F.broadcast(known.orderBy(low, "id").limit(sample))
    size = F.greatest(F.ceil(F.length("t") / passage), F.lit(1)).alias("n")  # greatest skips the null of a null text
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(chosen, "id").select("*", size)

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, t, y, n in zip(batch["id"], batch["t"], batch["y"], batch["n"]):
                x = encode([_text(t)], passage)[0]
                yield pd.DataFrame({"id": [i], "y": [float(y)], "n": [n], "x": [np.minimum(x, 255).astype(np.uint8).tobytes()]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(r.x, r.y) for batch in batches for r in batch.itertuples()]
        if rows:
            shaped = [np.frombuffer(x, np.uint8).reshape(-1, FEATURES) for x, _ in rows]
            m = fit(shaped, np.array([y for _, y in rows], np.float32))
            yield pd.DataFrame({"name": list(_NAMES), "data": [m[k].astype("<f4").tobytes() for k in _NAMES]})

    encoded = cut(own.where(F.col("n") <= passages).mapInPandas(bags, "id bigint, y double, n bigint, x binary"))
    order = [F.xxhash64("id"), F.col("id"), F.xxhash64("x"), F.col("x")]  # an id may have several texts
    first = encoded.orderBy(*order).limit(sample)
    least = first.withColumn("n", F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    least = least.where(F.col("n") <= passages).select("y", "x")
    got = {r.name: np.frombuffer(bytes(r.data), "<f4") for r in least.coalesce(1).mapInPandas(fitted, "name string, data binary").collect()}
    if not got:
        return None
    hidden = len(got["b1"])
    return {k: v.reshape({"w1": (FEATURES, hidden), "v": (hidden, hidden), "u": (hidden, hidden)}.get(k, (-1,))) for k, v in got.items()}


def score(docs: DataFrame, model: dict[str, np.ndarray] | None, *, text: str = "text", passage: int = 400, out: str = "score") -> DataFrame:
    """Adds the score of each whole text, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        m, found = shared.value, np.full(len(texts), 0.5)
        if m is None:
            return pd.Series(found)
        own, at, size = [], 0, 0
        whole = [_text(t) for t in texts]
        for i, t in enumerate(whole):
            own.append(t)
            size += len(t)
            if size >= _CHARS or i == len(whole) - 1:
                if len(own) == 1:
                    found[at] = _long(m, own[0], passage)
                else:
                    counts, owner = encode(own, passage)
                    found[at : at + len(own)] = forward(m, scaled(counts), owner, len(own))[0]
                own, at, size = [], i + 1, 0
        return pd.Series(found)

    return docs.withColumn(out, rate.asNondeterministic()(F.col(text)))


def _long(m: dict[str, np.ndarray], text: str, passage: int) -> float:
    """One text in slices of whole passages: attention needs only running sums."""
    top, total, z = -np.inf, 0.0, np.zeros(len(m["c"]))
    step = _CHARS // passage * passage
    for at in range(0, max(len(text), 1), step):
        x = scaled(encode([text[at : at + step]], passage)[0])
        h = np.tanh(x @ m["w1"] + m["b1"])
        e = (np.tanh(h @ m["v"]) * _sigmoid(h @ m["u"])) @ m["w"]
        high = max(top, float(e.max()))
        fade = np.exp(top - high) if np.isfinite(top) else 0.0
        a = np.exp(e - high)
        top, total, z = high, total * fade + a.sum(), z * fade + a @ h
    return float(_sigmoid(z / total @ m["c"] + m["d"])[0])
