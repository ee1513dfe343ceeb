"""Conversation repair, source mixing and fill-in-middle against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from talus.llm import balance, infill, repair

SF = "/root/testdata/sf0.001"
UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
ODD = [None, "", " ", "a  b", "x\n y ", "<P>", "a <S>b", "日本語 テスト\t", "😀 ok", "a\x1cb c \x1d d", "\x00 \x08", "word " * 100_000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill-in-middle


def infilled(doc_id, text):
    text = text or ""
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNITS.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_cut_points(monkeypatch):
    monkeypatch.setattr(infill, "BLOCK", 3)
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choice(" \n\tab日😀é\x1c\x0e\x08\x0b\x00") for _ in range(rnd.randint(0, rnd.choice([3, 10, 60, 200]))))
        units = UNITS.findall(text)
        one, two = rnd.randrange(2**32), rnd.randrange(2**32)
        a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
        want = len(units), len("".join(units[:a])), len("".join(units[a:b]))
        assert infill.cut_points(text.encode(), one, two) == want, text


def test_infill_odd(spark):
    rows = [(i, t, i) for i, t in enumerate(ODD * 8)] + [(None, "a b c d", 7), (None, "a b c d", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint").repartition(5)
    made = infill.fill_in_middle(df)
    made = made.select("*", infill.restored(made["infill.output"], made["infill.form"]).alias("back"))
    got = made.collect()
    assert len(got) == len(rows) and made.columns[:3] == df.columns
    for r in got:
        assert tuple(r.infill) == infilled(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.infill.form for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(df.where("false")).count() == 0
    every = infill.fill_in_middle(df, rate=100, spm=0).collect()
    assert {r.infill.form for r in every if r.text and not re.search("<[PSM]>", r.text)} == {"psm"}


# ---- mixing


def targets(size_of, weights=(5, 2, 1), most=3):
    """Water filling, one source after the other."""
    names = sorted(size_of, key=lambda s: (s is None, "" if s is None else s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = sum(size_of.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * size_of[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = most * size_of[s]
            left -= out[s]
        open_ -= full
    return out


def check_mix(rows, docs):
    sizes = Counter((d, s, len((t or "").split())) for d, s, t in docs)
    assert Counter((r.doc_id, r.source, r["size"]) for r in rows) == sizes
    size_of = defaultdict(int)
    for (_, s, n), k in sizes.items():
        size_of[s] += n * k
    want, taken = targets(size_of), defaultdict(int)
    for r in rows:
        assert r.source_size == size_of[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.taken <= 3 * r["size"]
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(rate + 1e-9), int(rate + 1e-9) + 1)
        taken[r.source] += r.taken
    return {s: taken[s] - want[s] for s in size_of}


def test_mix_query(spark):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = entry.queries()["op12_cube_mixture"](spark, SF).collect()
    off = check_mix(rows, docs)
    longest = max(r["size"] for r in rows)
    assert max(map(abs, off.values())) < longest / 10


def test_mix_levels_and_reruns(spark):
    rnd = random.Random(5)
    docs = [(i, rnd.choice(["a", "a", "a", "b", None]), "w " * int(rnd.paretovariate(1) * 5)) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    first = balance.mix(df.repartition(7), rows=64).collect()
    off = check_mix(first, docs)
    target = {r.source: r.target for r in first}
    assert all(abs(off[s]) < 0.03 * target[s] for s in target)
    assert Counter(first) == Counter(balance.mix(df.repartition(2, "text"), rows=64).collect())
    number = Counter(r.source for r in first)
    for s, n in number.items():
        r = next(x for x in first if x.source == s)
        assert sum(x.copies for x in first if x.source == s) == pytest.approx(n * r.target / r.source_size, abs=3 + n / 30)


def test_mix_odd(spark, monkeypatch):
    monkeypatch.setattr(balance, "COPIES", 10)
    docs = [(i, None if i % 3 else "é", t) for i, t in enumerate(ODD)]
    docs += [(7, "hot", "one two three")] * 137 + [(None, "", "x")] * 3 + [(8, "empty", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").repartition(4)
    docs = [(d, s, " ".join(re.findall("[^\x20\x09-\x0d]+", t or "")).replace("\x1c", "_").replace("\x1d", "_")) for d, s, t in docs]
    check_mix(balance.mix(df.withColumnRenamed("doc_id", "id"), doc_id="id").withColumnRenamed("id", "doc_id").collect(), docs)
    assert balance.mix(df.where("false")).count() == 0
    assert [r.taken for r in balance.mix(df.where("source = 'empty'")).collect()] == [0]


def test_chances_are_kept():
    """Over many draws every document is taken as often as its chance says, and totals hold in each draw."""
    sizes, chance, n = [s for s in (40, 30, 24, 15, 12, 9, 7, 5, 4, 3, 2, 1, 0) for _ in range(3)], 0.4, 2000
    times = [0] * len(sizes)
    for seed in range(n):
        p, _ = balance.settled(sizes, [chance] * len(sizes), random.Random(seed).random, True)
        assert set(p) <= {0.0, 1.0}
        times = [a + b for a, b in zip(times, p)]
    assert all(abs(t / n - chance) < 0.05 for t in times)
    even = balance.flight([5.0] * 40, [0.25] * 40, random.Random(1).random)
    assert sum(even) == pytest.approx(10) and sum(0 < c < 1 for c in even) <= 2


# ---- conversation repair


def cheapest(turns):
    """All edits, turn by turn, with up to three insertions at a place."""
    best = [(10**9, "")]

    def go(i, state, cost, audit, added):
        if cost > best[0][0]:
            return
        if i == len(turns) and state in "0a":
            best[0] = min(best[0], (cost, audit))
        for letter in "sua":
            if not ((letter == "s" and state == "0") or (letter == "u" and state in "0sa") or (letter == "a" and state == "u")):
                continue
            if letter != "s" and added < 3:
                go(i, letter, cost + 5, audit + "I", added + 1)
            if i < len(turns) and turns[i] != "-" and (turns[i].lower() == letter or letter != "s"):
                own = turns[i].lower() == letter
                go(i + 1, letter, cost + 5 * turns[i].isupper() + (not own), audit + ("K" if own else "R"), 0)
        if i < len(turns):
            go(i + 1, state, cost + 2, audit + "D", 0)

    go(0, "0", 0, "", 0)
    return best[0]


def test_alignment():
    rnd = random.Random(3)
    for _ in range(1500):
        turns = "".join(rnd.choice("suaxSUAX--uaua") for _ in range(rnd.randint(0, 6)))
        assert repair.Alignment(turns).solve() == cheapest(turns), turns


def test_alignment_bands_and_segments(monkeypatch):
    rnd = random.Random(4)
    turns = "".join(rnd.choices(["ua", "u", "a", "U", "-", "x", "s"], [20, 2, 2, 1, 1, 1, 1], k=900))
    whole = repair.Alignment(turns)
    cost, audit = whole.solve()
    assert whole.width > 8
    monkeypatch.setattr(repair, "CELLS", 3000)
    assert repair.Alignment(turns).solve() == (cost, audit)
    monkeypatch.setattr(repair.Alignment, "_fill", lambda self, width, fill=repair.Alignment._fill: fill(self, len(turns)))
    assert repair.Alignment(turns).solve() == (cost, audit)


def repaired(rows):
    """rows: (turn, role, text) of one conversation, without nulls in role and text."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, signs, faults, illegal = set(), "", Counter(), 0
    for i, (_, role, text) in enumerate(rows):
        body = text.strip(" \t\n\x0b\x0c\r")
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        signs += letter.upper() if fault == "truncated" else "-" if fault else letter
        illegal += i > 0 and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    known = {t for t, _, _ in rows if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    cost, audit = cheapest(signs)
    left, i, said = len(audit.replace("D", "")), 0, []
    for e in audit:
        if e != "D":
            said.append((rows[i][1] if e == "K" else "user" if left % 2 == 0 else "assistant", "" if e == "I" else rows[i][2]))
            left -= 1
        i += e != "I"
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, said


def test_repair_table(spark):
    rnd = random.Random(6)
    texts = ["Yes.", "No!", "cut", " ", "", None, "?\n", "日本。", "end. "]
    rows = [
        (conv, rnd.choice([None, *range(6)]), rnd.choice(["user", "assistant", "system", "User", "u", "", None]), rnd.choice(texts), 1)
        for conv in (None, *range(150))
        for _ in range(rnd.randint(1, 5))
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, gaps int").repartition(6)
    by = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    got = repair.repair(df).collect()
    assert len(got) == len(by)
    for r in got:
        assert (*r[1:8], [tuple(x) for x in r.repaired]) == repaired(by[r.conv_id]), by[r.conv_id]
    assert repair.repair(df.where("false")).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "A. B!") for c, t in itertools.product(range(40), range(5))] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    import zlib

    want = Counter()
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        want[(c, t, "user" if h == 4 else role, text, h != 0)] += 2 if h == 3 else 1
    made = repair.damage(df)
    assert Counter(map(tuple, made.collect())) == want
    whole = repair.repair(made, present=made.present & ~made.conv_id.eqNullSafe(3))
    lost = whole.where("conv_id = 3").first()
    assert tuple(lost[1:]) == (0, 0, 0, 0, 0, 0, "", [])
    assert whole.count() == 41
