"""Packing: tokens against the library, histogram and best-fit packing against their rules, round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from talus.llm import bestfit, packing
from talus.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a  b", "x\n y", "<|endoftext|>", "a <|endoftext|> b", "日本語 テスト", "1² ½ Ⅷ", "😀 ok", "a\x1cb c \x1d d", "don't 'S"]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(reference, text, end=1):
    return [*reference.encode(text or "", add_special_tokens=False).ids, end]


def test_tokens(reference):
    rnd = random.Random(1)
    alphabet = list(" \n\tab1'²./$<| é日ć\x1c")
    texts = [*ODD, "<|endoftext|>" * 3, *("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(2000))]
    for t in texts:
        assert [*encoder().encode(t), 1] == ids_of(reference, t), t
    reference.encode_special_tokens = True
    assert list(encoder(specials=False).encode("a <|endoftext|>")) == reference.encode("a <|endoftext|>", add_special_tokens=False).ids
    reference.encode_special_tokens = False


def check_pieces(rows, texts, reference, size=2048):
    """Each id in one piece, sequences without gaps, little padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids, at = ids_of(reference, texts[doc]), 0
        for r in sorted(own, key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        upto = 0
        for offset, length in sorted(own):
            assert offset == upto
            upto += length
        assert upto <= size
    return sum(n for own in by_sequence.values() for _, n in own) / size / len(by_sequence)


def test_histogram_query(spark, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_pieces(entry.queries()["op9_pack_histogram"](spark, SF).collect(), texts, reference) > 0.95


def test_histogram_odd(spark, reference):
    texts = {i: t for i, t in enumerate([*ODD, "word " * 20_000])}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    check_pieces(packing.pack(df).collect(), texts, reference)
    twice = packing.pack(df.union(df), ids=True).collect()
    assert len(twice) == 2 * packing.pack(df).count() and len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    assert all(len(r["ids"]) == r.length for r in twice)
    assert packing.pack(df.where("false")).count() == 0
    assert packing.pack(spark.createDataFrame([(None, None)], df.schema)).collect()[0][:2] == (None, 0)


def test_shortest_pack_first():
    """The counted patterns equal those of a list of packs filled one by one."""
    rnd = random.Random(2)
    for _ in range(60):
        size = rnd.choice([4, 16, 50])
        lengths = [rnd.randint(1, size) for _ in range(rnd.randint(0, 120))]
        rooms = []
        for n in sorted(lengths, reverse=True):
            best = max((r for r in rooms if r >= n), default=None)
            if best is not None:
                rooms.remove(best)
            rooms.append((size if best is None else best) - n)
        histogram = {n: lengths.count(n) for n in set(lengths)}
        packs = packing.patterns(histogram, size)
        assert sorted(size - sum(p) for c, p in packs for _ in range(c)) == sorted(rooms)
        table, held = packing.slots(packs), defaultdict(int)
        for count, pattern in packs:
            for n in pattern:
                held[n] += count
        assert dict(held) == histogram and len(table) == sum(len(p) for _, p in packs)


def test_best_fit_rule():
    """The segment tree finds what a search of all open rows finds."""
    rnd = random.Random(3)
    for _ in range(200):
        size = rnd.choice([1, 2, 7, 16, 31, 64])
        lengths = [rnd.randint(1, size) for _ in range(rnd.randint(0, 60))]
        rooms = []
        for n in sorted(lengths, reverse=True):
            best = min((r for r in rooms if r >= n), default=None)
            if best is not None:
                rooms.remove(best)
            rooms.append((size if best is None else best) - n)
        rows = bestfit.best_fit(lengths, size)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert sorted(size - sum(lengths[i] for i in r) for r in rows) == sorted(rooms)


def check_rows(rows, texts, reference, size=2048, pad=50256):
    found = defaultdict(dict)
    for r in rows:
        assert len(r.input_ids) == len(r.position_ids) == size and r.cu_seqlens[-1] == r.n_tokens
        cuts = [*r.cu_seqlens, size] if r.n_tokens < size else r.cu_seqlens
        assert r.position_ids == [i for a, b in zip(cuts, cuts[1:]) for i in range(b - a)]
        assert all(i == pad for i in r.input_ids[r.n_tokens :])
        for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert start not in found[doc]
            found[doc][start] = r.input_ids[a:b]
    reference.encode_special_tokens = True
    want = {doc: ids_of(reference, t, 50256) for doc, t in texts.items()}
    reference.encode_special_tokens = False
    assert {doc: [i for s in sorted(own) for i in own[s]] for doc, own in found.items()} == want


def test_best_fit_query(spark, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entry.queries()["op1_pack_best_fit"](spark, SF).collect()
    check_rows(rows, texts, reference)
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_best_fit_odd(spark, reference):
    texts = {i: t for i, t in enumerate([*ODD, "word " * 20_000])}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(2)
    check_rows(bestfit.pack_rows(df, window=5000).collect(), texts, reference)
    assert bestfit.pack_rows(df.where("false")).count() == 0
    assert bestfit.pack_rows(spark.createDataFrame([(None, None), (None, None)], df.schema)).selectExpr("sum(size(doc_ids)) n").first().n == 2
