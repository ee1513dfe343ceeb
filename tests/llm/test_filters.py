"""Language, near copies, benchmark passages, personal data: against plain versions, on given and on odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
import brute
from talus.llm import decontaminate, language, sanitize, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string, score double"
LONG = "lorem ipsum dolor sit amet consectetur " * 20_000


def rows(df, key):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, columns that clash with the operators' own."""
    texts = [None, "", " \n", LONG, "one two", "one two", "123 !!", "écoute le vent d'été", "the wind in the trees and the sea"]
    data = [(i, t, "en", None, None, "x", 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*data, data[3], data[4], (None, "one two", None, None, 1, None, None), (None,) * 7], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_decontaminate_query(spark, docs):
    got = rows(entry.queries()["op6_decontaminate"](spark, SF), "doc_id")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for doc, n, hit, found in brute.contamination(docs, items):
        assert tuple(got[doc])[1:] == (n, hit, len(found), brute.sha(",".join(found)), hit > 0 and 20 * hit >= n)
    assert any(r.contaminated for r in got.values())


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontaminate_windows(spark, odd, block):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice(["a ", "b ", "C-", "d\n", "é "]) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 5, 13, 14, 30]))) for i in range(12)] + [(3, "a b"), (None, "b"), (99, None), (98, "?")]
    own = [(i, text(rnd.randint(0, 120))) for i in range(60)] + [(r.doc_id, r.text) for r in odd.collect()]
    found = decontaminate.find_items(
        spark.createDataFrame(own, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string"),
        block_bytes=block,
    ).collect()
    want = list(brute.contamination(own, items))
    assert sorted((r.doc_id or -1, r.found.n_words, r.found.n_hit, tuple(r.found["items"])) for r in found) == sorted(
        (d or -1, n, h, tuple(i)) for d, n, h, i in want
    )
    for r in found:
        for run in r.found.runs:
            assert brute.words6(r.text[run.start : run.end]) == brute.words6(r.text)[run.first : run.last + 1]


def test_decontaminate_empty(spark, odd, none):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.drop_contaminated(odd, items).count() == odd.count()
    assert decontaminate.drop_contaminated(none, spark.createDataFrame([(1, "a b")], items.schema)).count() == 0
    assert decontaminate.drop_contaminated(odd, items).columns == odd.columns


def test_automaton_by_numbers():
    a = decontaminate.Automaton([("x", "a b c"), ("y", "b c")], 13)
    assert a.scan("z a b c.")[1:] == ([(1, 3, 2, 7)], ["x", "y"])


def check_simhash(got, docs):
    prints = {i: brute.fingerprint(t) for i, t in docs}
    label = brute.reachable(prints.values())
    least = {}
    for i, p in prints.items():
        least[label[p]] = min(least.get(label[p], i), i)
    assert got == {i: (f"{p:016x}", least[label[p]]) for i, p in prints.items()}


def test_simhash_query(spark, docs):
    got = entry.queries()["op7_simhash"](spark, SF).collect()
    check_simhash({r.doc_id: (r.fingerprint, r.component_id) for r in got}, docs)


def test_simhash_chain(spark):
    """Copies in a chain of small steps are one group although its ends are far apart; rare words differ."""
    base = [f"word{i % 57}" for i in range(120)]
    own = []
    for i in range(60):
        own.append((200 - i, " ".join(base)))
        base[(i * 7) % 120] = f"new{i}"
    got = simhash.near_duplicates(spark.createDataFrame(own, "doc_id bigint, text string")).collect()
    check_simhash({r.doc_id: (r.fingerprint, r.component_id) for r in got}, own)


def test_simhash_odd(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r.fingerprint for r in got if r.doc_id in (0, 1, 2)} == {"0" * 16}
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {0}
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(odd).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r.component_id for r in got})
    assert simhash.drop_near_duplicates(odd).columns == odd.columns
    assert simhash.drop_near_duplicates(none).count() == 0


def test_simhash_repeated_id(spark):
    """An id with several texts stays only where it is the smallest; null ids leave one row of their group."""
    own = [(5, "far one text of its own here"), (5, "common words of a copy"), (1, "common words of a copy"), (None, "x y z a b"), (None, "x y z a b")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(own, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, own[3][1]), (1, own[1][1]), (5, own[0][1])]


def test_bk_trees_agree():
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 30, dtype=np.uint64)
    noise = lambda: np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)
    values = np.unique(np.concatenate([centres, *[centres ^ noise() ^ noise() ^ noise() for _ in range(8)]]))
    want = brute.reachable(values.tolist())
    for found in (simhash.search_tree(values, 4), simhash.search_forest(values, np.zeros(len(values), int), 4)):
        groups = {}
        for v, x in zip(values.tolist(), found.tolist()):
            groups.setdefault(x, set()).add(want[v])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [(-7, 399), (5, 5)]
    got = rows(simhash.components(spark.createDataFrame(path, "a bigint, b bigint")), "a")
    assert {a: r.root for a, r in got.items()} == {**{i: 0 for i in range(1, 41)}, **{100 + i: -7 for i in range(300)}}


def test_language_query(spark, docs):
    got = rows(entry.queries()["op8_language"](spark, SF), "doc_id")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [i for i, _ in docs if brute.crc(i) % 3 == 1]
    assert all(got[i].held_out == (brute.crc(i) % 3 == 1) and 0 <= got[i].score <= 1 for i, _ in docs)
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.95


def test_language_is_naive_bayes(spark):
    """Posteriors equal those of counts taken one by one."""
    import math
    from collections import Counter

    import numpy as np

    own = [("aa ab ba", "x"), ("ab abab", "x"), ("cc dd c!!d", "y"), ("", "z"), (None, "y"), ("zz", None)]
    model = language.train(spark.createDataFrame(own, "text string, lang string"), buckets=1 << 12)
    assert model.languages == ["x", "y", "z"]
    gram = lambda t: np.concatenate([h for _, h in language.grams(np.append(language.letters(t), np.uint32(0)), 1 << 12)])
    counts = {k: Counter(int(h) for t, l in own if l == k and t is not None for h in gram(t)) for k in "xyz"}
    logs = [
        math.log(n / 4) + sum(math.log((counts[k][h] + 0.1) / (sum(counts[k].values()) + 0.1 * 4096)) for h in gram("abc"))
        for k, n in zip("xyz", (2, 1, 1))
    ]
    names, score = model.predict(["abc", None, "12 !"])
    assert names[1:] == ["und", "und"] and list(score[1:]) == [0, 0]
    assert abs(score[0] - math.exp(max(logs)) / sum(map(math.exp, logs))) < 1e-4


def test_language_odd(spark, odd, none):
    model = language.train(odd)
    got = language.predict(odd, model).select("doc_id", "language.*").collect()
    assert [r.lang_pred for r in got if r.doc_id in (0, 1, 2, 6)] == ["und"] * 4
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 7)} == {"en"}
    kept = language.drop_unknown(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 5
    torn = language.Model(["a", "b", "c"], model.matrix[:, [0, 0, 0]], np.zeros(3))  # no language can win by half
    assert language.drop_unknown(odd, torn).count() == odd.count() - 5
    empty = language.train(none)
    assert {r.language.lang_pred for r in language.predict(odd, empty).collect()} == {"und"}
    with pytest.raises(ValueError):
        language.train(odd, max_cells=10)


def check_base(got, docs):
    for doc, text in docs:
        spans = brute.base_spans(text)
        r = got[doc]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(spans[k]) for k in sanitize.PATTERNS]
        base = brute.joined_spans(spans.items())
        assert r.base_sha256 == brute.sha(base)
        assert r.spans.startswith(base)


def digest(found):
    return found.select(
        "doc_id",
        *[F.size(k).alias(f"n_{k}") for k in sanitize.PATTERNS],
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
    )


def test_sanitise_query(spark, docs):
    check_base(rows(entry.queries()["op5_sanitise"](spark, SF), "doc_id"), docs)


def test_sanitise_patterns(spark):
    rnd = random.Random(4)
    alphabet = list("a1.@-+ ()_é😀") + ["12", "255.", "1.2.3.4", "4111 1111 1111 1111", "+49 (0) 12345678", "b@c.d"]
    own = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    own += [(1000, "1" * 50_000), (1001, "a1 " * 300 + "9@x.y " * 3000), (1002, None), (1003, ""), (1004, "a@b.c@d.e_f@g.h 1.2.3.4.5.6.7.8 300.1.1.1")]
    found = sanitize.find_personal_data(spark.createDataFrame(own, "doc_id bigint, text string"))
    check_base(rows(digest(found), "doc_id"), own)


def brute_terms(own, reach=100, support=2):
    """(entity, term) disclosures from plain counts."""
    import math
    import re
    from collections import Counter

    word = re.compile(r"[^\W\d_]{3,}")
    pairs, ent, term = Counter(), Counter(), Counter()
    for _, text in own:
        text = text or ""
        spans = brute.base_spans(text)
        entities = {f"{k}:{text[a:b].lower()}" for k in spans for a, b in spans[k]}
        ent.update(entities)
        term.update({w.lower() for w in word.findall(text)})
        near = set()
        for k in spans:
            for a, b in spans[k]:
                for m in word.finditer(text):
                    if (a - reach <= m.start() and m.end() < a) or (b < m.start() and m.end() <= b + reach):
                        near.add((f"{k}:{text[a:b].lower()}", m.group().lower()))
        pairs.update(near)
    n = len(own)
    return {
        (e, t): math.log2(n * c / (ent[e] * term[t])) / math.log2(n / ent[e]) for (e, t), c in pairs.items() if c >= support and ent[e] < n
    }


def test_sanitise_terms(spark):
    names = ["amber", "bravo", "cobalt"]
    own = [(i, f"please ask {names[i % 3]} at {names[i % 3]}x@host.org about the offer") for i in range(30)]
    own += [(100 + i, f"nothing here but the offer number {i}") for i in range(60)] + [(200, None), (201, "amber alone")]
    disclosed = brute_terms(own)
    assert disclosed["email:bravox@host.org", "bravo"] >= 0.8 > disclosed["email:bravox@host.org", "offer"]
    df = spark.createDataFrame(own, "doc_id bigint, text string")
    for r in sanitize.find_personal_data(df).collect():
        text = dict(own)[r.doc_id] or ""
        entity = "email:" + r.email[0].value.lower() if r.email else None
        want = {t for (e, t), d in disclosed.items() if e == entity and d >= 0.8}
        assert {text[s.start : s.end] for s in r.terms} == want
    clean = {r.doc_id: r.text for r in sanitize.sanitise(df).collect()}
    assert "amber" not in clean[0] and "[EMAIL]" in clean[0] and "offer" in clean[0]
    assert clean[100] == dict(own)[100] and clean[200] is None and clean[201] == "amber alone"


def whole_document_terms(own, support=2, generalise=0.8):
    """Spans of disclosing terms by document: plain counts over whole documents."""
    import math
    import re
    from collections import Counter

    word = re.compile(r"[^\W\d_]{3,}")
    pairs, ent, term, held = Counter(), Counter(), Counter(), {}
    for i, text in own:
        spans = brute.base_spans(text)
        entities = {f"{k}:{text[a:b].lower()}" for k in spans for a, b in spans[k]}
        terms = {w.lower() for w in word.findall(text)}
        held[i] = entities, [s for k in spans for s in spans[k]]
        ent.update(entities)
        term.update(terms)
        pairs.update((e, t) for e in entities for t in terms)
    n = len(own)
    score = lambda e, t: math.log2(n * pairs[e, t] / (ent[e] * term[t])) / math.log2(n / ent[e])
    for i, text in own:
        entities, base = held[i]
        bad = {t for e, t in pairs if e in entities and pairs[e, t] >= support and ent[e] < n and score(e, t) >= generalise}
        free = lambda m: all(b < m.start() or m.end() < a for a, b in base)  # noqa: E731, B023
        yield i, [m.span() for m in word.finditer(text) if m.group().lower() in bad and free(m)]


def test_sanitise_whole_documents(spark):
    """A term far from its entity is found, and every occurrence of it is masked."""
    far = "plain filler words of no interest " * 20
    own = [(i, f"Zebulon wrote. {far} mail zeb@host.org now. {far} regards Zebulon") for i in range(4)]
    rnd = random.Random(6)
    own += [(10 + i, " ".join(rnd.choice(["sun", "moon", "Tidal", "reef", "a@b.org", "c@d.org", "1.2.3.4", far]) for _ in range(9))) for i in range(30)]
    own += [(100 + i, f"nothing here {far}") for i in range(60)]
    df = spark.createDataFrame(own, "doc_id bigint, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.terms] for r in sanitize.find_personal_data(df).collect()}
    assert got == dict(whole_document_terms(own)) and len(got[0]) == 6
    clean = {r.doc_id: r.text for r in sanitize.sanitise(df).collect()}
    assert "Zebulon" not in clean[0] and "filler" in clean[0]


def test_sanitise_several_entities(spark):
    """Neither short numbers nor other entities between an entity and a term hide the term."""
    own = [(i, "Aurelia order 42 card 4111 1111 1111 1111 or a@b.org, c@d.org 17") for i in range(3)]
    own += [(10 + i, "order 42 card or 17") for i in range(60)]
    df = spark.createDataFrame(own, "doc_id bigint, text string")
    got = {r.doc_id: [own[0][1][s.start : s.end] for s in r.terms] for r in sanitize.find_personal_data(df).collect() if r.doc_id < 3}
    assert got == {i: ["Aurelia"] for i in range(3)}
    spans = sanitize.pattern_spans(df.where("doc_id = 0"), "text", {k: k for k in sanitize.PATTERNS}, 30).first()
    text = own[0][1]
    for s in [*spans.card, *spans.email]:
        assert (s.left, s.right) == (text[max(0, s.start - 30) : s.start], text[s.end : s.end + 30])
    assert [len(spans.card), len(spans.email)] == [1, 2]


def test_sanitise_masks_every_pattern_span(spark):
    own = [(1, "a b@c.de f 1.2.3.4 g 4111-1111-1111-1111 h +49 123 45678."), (2, "+4111111111111111 x"), (3, "no data"), (3, "b@c.de")]
    clean = sorted((r.doc_id, r.text) for r in sanitize.sanitise(spark.createDataFrame(own, "doc_id bigint, text string")).collect())
    assert clean[0] == (1, "a [EMAIL] f [IP] g [CARD] h [PHONE].")
    assert clean[2:] == [(3, "[EMAIL]"), (3, "no data")]


def test_sanitise_odd(spark, odd, none):
    clean = sanitize.sanitise(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    assert [r.text for r in sorted(clean.collect(), key=key)] == [r.text for r in sorted(odd.collect(), key=key)]
    assert sanitize.find_personal_data(none).count() == 0 and sanitize.sanitise(none).count() == 0


def test_pattern_spans_have_no_python(spark, odd):
    found = sanitize.pattern_spans(odd.na.fill("", ["text"]), "text", {k: f"x_{k}" for k in sanitize.PATTERNS}, 10)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert isinstance(found.schema["x_email"].dataType, T.ArrayType)
