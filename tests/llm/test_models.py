"""Chat expansion, nearest neighbours, quality and language-model scores: against plain versions and held-out labels."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import brute
from talus.llm import chat, mixing, quality, vptree

SF = "/root/testdata/sf0.001"


def test_chat_round_trip(spark):
    rnd = random.Random(1)
    parts = ["<|im_end|>", "<|im_start|>", "\n", "\\", "|", "<", "n", "assistant ", "é😀", "<|im_end|>\n"]
    text = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
    turns = [(c, t, rnd.choice(["user", "assistant", "assistant", "a\n\\n" + text(), None]), rnd.choice([text(), None])) for c in range(40) for t in range(rnd.randint(1, 9))]
    turns += [(100, 0, "user", "same"), (100, 0, "user", "same"), (100, 0, "assistant", "tie"), (None, 1, "assistant", "x"), (None, None, "user", "first")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    want = defaultdict(list)
    for c, t, r, x in turns:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    examples = chat.expand(df)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    assert set(got) == set(want)
    for c, own in want.items():
        own = [(r, x) for _, _, r, x in sorted(own)]
        assert [tuple(t) for t in got[c].turns] == own
        assert got[c].losses == [x for r, x in own if r == "assistant"]
    trained = examples.where("loss_end IS NOT NULL").collect()
    assert len(trained) == sum(r == "assistant" for own in want.values() for _, _, r, _ in own)
    for e in trained:  # only the last reply is trainable, and nothing follows it
        assert e.formatted[e.loss_end :] == chat.END and "<|im_start|>" not in e.formatted[e.loss_start :]
    assert chat.read_back(chat.expand(df.where("false"))).count() == 0


def plain_nearest(rows, k=20):
    seen = {}
    for i, v in rows:
        ok = i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)
        if ok and (i not in seen or v < seen[i]):
            seen[i] = v
    out = set()
    for q in seen:
        if q % 20 == 0:
            others = [(-float(np.dot(np.array(seen[q], float), np.array(v, float))), i) for i, v in seen.items() if i != q and len(v) == len(seen[q])]
            out |= {(q, n + 1, i, round(-s, 9)) for n, (s, i) in enumerate(sorted((round(s, 12), i) for s, i in others)[:k])}
    return out


def found(df):
    return {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect()}


def test_nearest_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert found(entry.queries()["op10_vantage_point"](spark, SF)) == plain_nearest(rows)


def test_nearest_odd(spark):
    rnd = random.Random(2)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(rnd.randint(-2, 2)) for _ in range(3)]) for i in range(500)]  # ties and copies
    rows += [(i, [1.0, 1.0, 1.0]) for i in range(1000, 1300)]
    rows += [(2000, None), (2020, [0.0, 0.0, 0.0]), (2040, [nan, 1.0, 1.0]), (2060, [inf, 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (20, [9.0, 9.0, 9.0]), (40, [1.0, 2.0]), (60, [])]
    rows += [(3000, [None, 1.0, 2.0]), (4000, [0.5, 0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = found(vptree.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=100))
    assert got == plain_nearest(rows)
    assert vptree.nearest(df.where("false"), F.lit(True)).count() == 0


def test_factor_trades_recall_for_visits():
    rng = np.random.default_rng(3)
    points = np.unique(rng.normal(size=(3000, 6)).round(3), axis=0)
    top = float((points**2).sum(axis=1).max())
    exact = np.argsort(-(points[:200] @ points.T), axis=1, kind="stable")[:, :21]
    recall, visits = [], []
    for factor in (1.0, 1.5, 3.0):
        tree = vptree.Tree(points, np.arange(len(points)), top)
        _, got = tree.search(points[:200], 21, factor)
        recall.append(np.mean([len(set(a) & set(b)) / 21 for a, b in zip(got, exact)]))
        visits.append(tree.visited)
    assert recall[0] == 1.0 and visits[0] > visits[1] > visits[2] and recall[1] >= 0.9


def test_quality_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in entry.queries()["op3_quality_attention"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == (brute.crc(i) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(got[i].score, y) for i, y in labels.items() if y is not None and got[i].held_out]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x == 1 and y == 0]
    assert sum(pairs) / len(pairs) > 0.9


def test_quality_gradient():
    rng = np.random.default_rng(4)
    x = quality.scaled(rng.poisson(0.05, (7, quality.FEATURES))).astype(np.float64)
    owner, y = np.array([0, 0, 0, 1, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    m = {k: rng.normal(0, 0.5, s) for k, s in {"w1": (quality.FEATURES, 4), "b1": (4,), "v": (4, 4), "u": (4, 4), "w": (4,), "c": (4,), "d": (1,)}.items()}
    loss = lambda: -np.mean(np.log(np.where(y == 1, p := quality.forward(m, x, owner, 3)[0], 1 - p)))
    for k, g in quality.gradient(m, x, owner, y).items():
        at = (int(np.abs(g).argmax()),) if g.ndim == 1 else np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = m[k][at]
        m[k][at] = kept + 1e-5
        high = loss()
        m[k][at] = kept - 1e-5
        low = loss()
        m[k][at] = kept
        assert abs((high - low) / 2e-5 - g[at]) < 1e-6


def test_quality_odd(spark):
    docs = spark.createDataFrame([(0, None, 1.0), (1, "", 1.0), (2, "ab " * 600_000, 1.0), (None, "x", None), (2, "z", 0.0)], "doc_id bigint, text string, score double")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.train(docs, none, F.lit(True)) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    labels = spark.createDataFrame([(0, 1), (2, 0), (2, None), (1, 1), (1, 0)], none.schema)
    model = quality.train(docs, labels, F.lit(True))
    rows = quality.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    long = next(r for r in rows if r.doc_id == 2 and len(r.text) > 9)
    counts, owner = quality.encode([long.text], 400)
    assert abs(long.score - quality.forward(model, quality.scaled(counts), owner, 1)[0][0]) < 1e-5


def test_quality_whole_bags(spark):
    """A single passage out of 150 decides, wherever it stands; a text above the bound is no part of the sample."""
    rnd = random.Random(8)
    plain = lambda: "".join(rnd.choice("abcd ") for _ in range(20))
    data = []
    for i in range(300):
        parts = [plain() for _ in range(150)]
        if i % 2:
            parts[rnd.randrange(150)] = "xyzzyxyzzyxyzzyxyzzy"
        data.append((i, "".join(parts)))
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    model = quality.train(docs, labels, F.col("doc_id") < 200, passage=20)
    got = quality.score(docs.where("doc_id >= 200"), model, passage=20).collect()
    assert sum((r.score >= 0.5) == r.doc_id % 2 for r in got) > 95
    assert quality.train(docs, labels, F.lit(True), passage=20, passages=149) is None
    assert quality.train(docs, labels, F.lit(True), passage=20, passages=300) is not None


def plain_base(docs):
    """(n_tokens, n_known, N, base score) of each text."""
    import re

    words = lambda t: [*[w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate(brute.LOWER)) if w], None]
    seen = Counter(w for i, t in docs if brute.crc(i) % 5 != 1 for w in words(t))
    n, v = sum(seen.values()), len(seen)
    chance = lambda w: math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1)))
    return [(i, len(w := words(t)), sum(seen[x] > 0 for x in w), n, sum(map(chance, w))) for i, t in docs]


@pytest.mark.parametrize("words", [1 << 17, 50])
def test_mixing_base(spark, words):
    """The base score does not depend on which words the driver knows."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(5000, None), (5001, ""), (5001, "a A a")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = mixing.score(df, F.expr("crc32(cast(doc_id AS string)) % 5 = 1"), words=words).collect()
    key = lambda r: tuple(round(x, 6) for x in r)
    assert sorted(key((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score)) for r in got) == sorted(map(key, plain_base(docs)))
    assert all(r.score < 0 for r in got)


def test_mixing_is_a_distribution():
    """In any one context, the probabilities of all symbols add up to one."""
    vocabulary = mixing.Vocabulary([(b"aa", 9), (b"b", 5), (b"", 4)], 20, 5)
    for first, _, _ in (vocabulary.word_code, vocabulary.byte_code):
        assert abs(sum(2.0 ** -int(n) for n in np.diff(first)) - 1) < 1e-12
    mixer = mixing.Mixer()
    for run in mixing.runs([[b"aa", b"b", b"aa", b"q"], [b"aa", b"aa"]] * 30, vocabulary)[0]:
        mixer.learn(run)
    for code, gates in ((vocabulary.word_code, range(20)), (vocabulary.byte_code, range(20, 32))):
        n = len(code[0]) - 1
        every = mixing.Run(code, np.arange(n), [np.full(n, 7 * p, np.uint32) for p in range(mixing.PREDICTORS)], np.arange(n), gates)
        assert abs((10 ** mixer.log10(every, mixer.stretched(), n)).sum() - 1) < 1e-4


def test_mixing_tables_add_up():
    """Parts of tables, summed in sorted blocks, are the table of all texts."""
    import pandas as pd

    vocabulary = mixing.Vocabulary([(b"aa", 9), (b"b", 5), (b"", 4)], 20, 5)
    both, parts, texts = mixing.Mixer(), [], [[[b"aa", b"xyz"]] * 3, [[b"b"], [b"aa", b"b"]]]
    for own in texts:
        one = mixing.Mixer()
        done = sum(one.learn(r) for r in mixing.runs(own, vocabulary)[0])
        parts += list(one.blocks(done))
        for r in mixing.runs(own, vocabulary)[0]:
            both.learn(r)
    batch = pd.DataFrame(sorted(parts, key=lambda x: x[0]), columns=["block", "data"])
    summed = mixing.Mixer.of([(r.block, r.data) for out in mixing._sum_blocks(iter([batch[:1], batch[1:]])) for r in out.itertuples()])
    assert (summed.counts == both.counts).all() and np.isfinite(summed.weights).all()


def test_mixing_learns(spark):
    """Repeated phrases cost far less than the words on their own; the result is that of another split."""
    rnd = random.Random(5)
    phrases = [" ".join(f"w{rnd.randint(0, 300)}" for _ in range(12)) for _ in range(30)]
    docs = [(i, ". ".join(rnd.choice(phrases) for _ in range(6))) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = mixing.score(df, F.expr("crc32(cast(doc_id AS string)) % 5 = 1")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.6 * got[1]


def test_mixing_remembers(spark):
    """Words beyond the driver's table are known by their counts: p = new * p(spelling) + (1 - new) * n / rest."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    pool = [word() for _ in range(400)]
    train = [(i, " ".join(rnd.choice(pool) for _ in range(20))) for i in range(400)]
    docs = train + [(1000, " ".join(pool[:50])), (1001, " ".join(word() for _ in range(50)))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    few, all_ = ({r.doc_id: r for r in mixing.score(df, F.col("doc_id") >= 1000, words=w).collect()} for w in (1, 1000))
    assert few[1000].score > few[1001].score + 50 * 5  # a word costs 17 digits to spell, 3 to remember
    assert few[1000].score > 1.5 * all_[1000].score
    counts = Counter(w for _, t in train for w in t.split())
    vocabulary = mixing.vocabulary(mixing.count_tokens(df.where("doc_id < 1000").select(F.col("text").alias("t"))), 1)
    assert vocabulary.rest == sum(counts.values()) and vocabulary.new == (sum(n == 1 for n in counts.values()) + 1) / (vocabulary.rest + 1)
    ways = vocabulary.new + sum((1 - vocabulary.new) * n / vocabulary.rest for n in counts.values())
    assert abs(ways - 1) < 1e-12


def test_mixing_huge_counts():
    """Counts of more than 32 bits keep small neighbours in the block."""
    part = np.zeros((2, mixing._BLOCK), np.int64)
    part[:, 0], part[0, 1] = 1 << 40, 3
    got = mixing.Mixer.of([(0, part.astype("<i8").tobytes())])
    assert got.counts[0, 0, 0] == 1 << 40 and got.counts[0, 0, 1] == 3 and np.isfinite(got.stretched()).all()


def test_mixing_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert mixing.score(none, F.lit(False)).count() == 0
    only = spark.createDataFrame([(1, "a b"), (2, None)], none.schema)
    rows = {r.doc_id: r for r in mixing.score(only, F.lit(True)).collect()}
    assert rows[1].base_score == 0 and rows[1].train_tokens == 0 and rows[1].n_known == 0 and rows[1].score < rows[2].score < 0
