"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else becomes one space, and all n-grams of
1 to 3 characters (an end mark included) are hashed into ``buckets``. Training
counts n-grams by language in one pass, sums them with a hash aggregation, and
brings at most ``max_cells`` counts (languages times buckets) to the driver;
more languages raise an error, as the matrix must fit a broadcast. Scoring is
a sparse product in numpy: rows of the log-probability matrix are gathered for
the n-grams of a batch and added up by document.

A text that is null or has no letter is ``und`` with score 0, and so is every
text when nothing was learned. Rows without text or language teach nothing; an
empty string is a language like any other. Equal posteriors go to the language
that sorts first. Repeated rows count each time. Long texts are read whole, in
slices of bounded size. The score is the posterior of the chosen language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import hidden

ORDERS = 3
_SLICE = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_LETTERS = np.array([chr(c).isalpha() for c in range(0x110000)])


def letters(text: str) -> np.ndarray:
    """Code points with each run of other characters as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_LETTERS[codes], codes, np.uint32(32))
    spaces = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(spaces[1:] & spaces[:-1])
    return codes[keep]


def grams(codes: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: start positions' hashes. Windows may run over the end; the caller masks those."""
    h = np.zeros(len(codes), np.uint32)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    for n in range(ORDERS):
        h = h[: len(codes) - n] + codes[n:] * _MULTIPLIERS[n]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
        yield n, (mixed >> shift).astype(np.int64)


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with an end mark each in one array, and the number of the text of each place."""
    mark = np.zeros(1, np.uint32)
    codes = np.concatenate([x for p in parts for x in (p, mark)])
    return codes, np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])


def _slices(texts: list[str]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Batches of about _SLICE characters. A longer text comes in pieces, each of which ends as a text does."""
    ids: list[int] = []
    parts: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text), 1), _SLICE):
            ids.append(i)
            parts.append(letters(text[at : at + _SLICE]))
            size += len(parts[-1])
            if size >= _SLICE:
                yield ids, parts
                ids, parts, size = [], [], 0
    if ids:
        yield ids, parts


def count_grams(texts: list[str], buckets: int) -> np.ndarray:
    total = np.zeros(buckets, np.int64)
    for _, parts in _slices(texts):
        codes, owner = _joined(parts)
        for n, h in grams(codes, buckets):
            total += np.bincount(h[owner[: len(h)] == owner[n:]], minlength=buckets)
    return total


def log_likelihood(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Sum of the matrix rows of all n-grams of each text."""
    out = np.zeros((len(texts), matrix.shape[1]))
    for ids, parts in _slices(texts):
        codes, owner = _joined(parts)
        sums = np.zeros((len(parts), matrix.shape[1]))
        for n, h in grams(codes, len(matrix)):
            mine = owner[: len(h)]
            inside = mine == owner[n:]
            h, mine = h[inside], mine[inside]
            for k in range(matrix.shape[1]):
                sums[:, k] += np.bincount(mine, matrix[:, k][h], len(parts))
        np.add.at(out, ids, sums)
    return out


class Model:
    """Languages in order, and the log-probability matrix (buckets by languages) with the priors."""

    def __init__(self, languages: list[str], matrix: np.ndarray, prior: np.ndarray) -> None:
        self.languages, self.matrix, self.prior = languages, matrix, prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        said = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages or not said.any():
            return names, score
        at = np.flatnonzero(said)
        logs = log_likelihood([texts[i] for i in at], self.matrix) + self.prior
        best = logs.argmax(axis=1)
        score[at] = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b in zip(at, best):
            names[i] = self.languages[b]
        return names, score


def train(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    buckets: int = 1 << 16,
    smoothing: float = 0.1,
    max_cells: int = 1 << 23,
) -> Model:
    """Learns from all rows with text and language; ``buckets`` is a power of two."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for name, own in batch.groupby("l", sort=False)["t"]:
                rows[name] = rows.get(name, 0) + len(own)
                got = count_grams(list(own), buckets)
                counts[name] = counts[name] + got if name in counts else got
        for name, got in counts.items():
            at = np.flatnonzero(got)
            yield pd.DataFrame({"lang": name, "bucket": np.append(at, -1), "n": np.append(got[at], rows[name])})

    known = docs.select(F.col(lang).alias("l"), F.col(text).alias("t")).dropna()
    counted = known.mapInPandas(partial, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.limit(max_cells + 1).toPandas()
    if len(got) > max_cells:
        raise ValueError(f"more than {max_cells} counts of languages by buckets: use fewer buckets")
    languages = sorted(got["lang"].unique()) if len(got) else []
    matrix = np.zeros((buckets, len(languages)))
    prior = np.zeros(len(languages))
    for k, name in enumerate(languages):
        own = got[got["lang"] == name]
        inside = own["bucket"] >= 0
        matrix[own["bucket"][inside], k] = own["n"][inside]
        prior[k] = own["n"][~inside].sum()
    matrix = np.log((matrix + smoothing) / (matrix.sum(axis=0) + smoothing * buckets))
    return Model(languages, matrix.astype(np.float32), np.log(prior / max(prior.sum(), 1)))


def predict(docs: DataFrame, model: Model, *, text: str = "text", out: str = "language") -> DataFrame:
    """Adds a struct: lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        names, values = shared.value.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": names, "score": values})

    return docs.withColumn(out, score.asNondeterministic()(F.col(text)))


def drop_unknown(docs: DataFrame, model: Model, **options) -> DataFrame:
    """The documents for which a language is predicted, however short or mixed: all with a letter, if any is learned."""
    (found,) = hidden("language")
    return predict(docs, model, out=found, **options).where(F.col(f"{found}.lang_pred") != "und").drop(found)
