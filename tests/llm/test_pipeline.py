"""Each stage of the pipeline against a plain version, on what the stage before has left."""

import brute
import corpus_pipeline
from test_packing import check_pieces, reference  # noqa: F401
from talus.llm.common import cut

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, reference):  # noqa: F811
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    given = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10_000, None, "en", "s", 0), (10_001, "12 + 3 !!", "en", "s", 9), (10_002, "", None, "s", 0)]
    docs = given.union(spark.createDataFrame(extra, given.schema))

    known = cut(stage["language_id"](spark, docs, SF))
    before, after = texts(docs), texts(known)
    assert known.columns == docs.columns and set(before) - set(after) == {10_000, 10_001, 10_002}

    single = cut(stage["near_dedup"](spark, known, SF))
    before, after = after, texts(single)
    prints = {i: brute.fingerprint(t) for i, t in before.items()}
    label, least = brute.reachable(prints.values()), {}
    for i, p in prints.items():
        least[label[p]] = min(least.get(label[p], i), i)
    assert single.columns == docs.columns and set(after) == set(least.values()) and single.count() == len(after)

    clean = cut(stage["decontamination"](spark, single, SF))
    before, after = after, texts(clean)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, n, hit, _ in brute.contamination(before.items(), items) if hit and 20 * hit >= n}
    assert bad and clean.columns == docs.columns and set(after) == set(before) - bad

    masked = cut(stage["pii"](spark, clean, SF))
    before, after = after, texts(masked)
    assert masked.columns == docs.columns and set(after) == set(before)
    for i, t in before.items():
        spans = [s for own in brute.base_spans(t).values() for s in own]
        if not spans:
            assert after[i] == t
        assert not any(t[a:b] in after[i] for a, b in spans)
    assert all(r.n_chars == len(r.text) for r in masked.collect())

    rows = stage["packing"](spark, masked, SF).collect()
    check_pieces(rows, after, reference)
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(rows)
