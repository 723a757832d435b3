"""The pipeline's stages against brute force over their own inputs."""

import hashlib

import collections

import corpus_pipeline
import numpy as np
from tests.llm.test_operators import brute_components, brute_groups, brute_spans, multiset, rows_of
from tidewater.llm import quality_fm
from tidewater.llm.common import materialise


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, sf), "test-stage")
        if name != "packing":
            assert out.columns == columns
        seen[name] = ({r.doc_id: r for r in docs.collect()}, out.collect())
        docs = out
    before, after = seen["quality"]
    model = quality_fm.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    buckets = quality_fm._Buckets()
    assert {r.doc_id for r in after} == {i for i, r in before.items() if model.score(*quality_fm.features(r.text or "", buckets)) >= 0.5}
    before, after = seen["exact duplicates"]
    last = {}
    for i, r in before.items():
        d = hashlib.sha256((r.text or "").encode()).digest()
        last[d] = max(last.get(d, i), i)
    assert {r.doc_id for r in after} == set(last.values())
    before, after = seen["near duplicates"]
    want = brute_components([(i, r.text) for i, r in before.items()], 5, 80)
    assert {r.doc_id for r in after} == {c for _, c in want.values()}
    before, after = seen["personal data"]
    assert len(after) == len(before)
    for r in after:
        assert not brute_spans(r.text or "") or not brute_spans(before[r.doc_id].text or "")
        assert r.n_chars == len(r.text) and (brute_spans(before[r.doc_id].text) or r.text == before[r.doc_id].text)
    before, after = seen["packing"]
    assert {r.doc_id for r in after} == set(before)
    # and run() is the stages one after another
    whole = corpus_pipeline.run(spark, sf).collect()
    told = lambda rows: collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert told(whole) == told(after)
    assert len({r.sequence_id for r in whole}) == len({r.sequence_id for r in after})


def test_stages_on_odd_rows(spark, odd, none, sf):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, none, sf)
        assert empty.columns == none.columns and empty.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, none, sf).count() == 0
    stages = dict(corpus_pipeline.STAGES)
    rows = rows_of(odd)
    good = stages["quality"](spark, odd, sf)
    assert good.columns == odd.columns and not multiset(rows_of(good)) - multiset(rows)
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[t].append(i)
    kept = materialise(stages["exact duplicates"](spark, odd, sf), "test-stage")
    assert multiset(rows_of(kept)) == multiset((i, t) for t, ids in texts.items() for i in ids if i == max((x for x in ids if x is not None), default=None))
    kept = materialise(stages["near duplicates"](spark, kept, sf), "test-stage")
    left = rows_of(kept)
    assert not any(c != i for i, n, c in brute_groups(left, 5, 80) if n) and {t for _, t in left} == set(texts)
    clean = materialise(stages["personal data"](spark, kept, sf), "test-stage")
    assert clean.columns == odd.columns and multiset(rows_of(clean)) == multiset((i, "[EMAIL] [CARD] é [IP] [PHONE]" if i == 7 else t) for i, t in left)
    packed = stages["packing"](spark, clean, sf).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in left} and np.sum([r.offset == 0 for r in packed]) == len({r.sequence_id for r in packed})
