"""The corpus pipeline, stage after stage on a whole small table, each against what it must do to its input."""

import collections

import corpus_pipeline
from kiln.llm import mixing, ngram_join, quality_rules
from conftest import SF_SMALL


def _words(t):
    return (t or "").encode().lower().split()


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], SF_SMALL).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    assert all(k.columns == docs.columns for k in kept[1:-1])
    rows = [{r.doc_id: r for r in k.collect()} for k in kept[:4]]
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    scored = quality_rules.score_quality(docs, labels).collect()
    assert set(rows[1]) == {r.doc_id for r in scored if r.predicted == 1}
    comp = ngram_join.near_duplicate_components(kept[1]).collect()
    assert set(rows[2]) == {r.component_id for r in comp}
    seen = set()
    for d in sorted(rows[3]):                              # no passage of 50 words is left twice over documents
        own, w = set(), _words(rows[3][d].text)
        for i in range(len(w) - 49):
            own.add(tuple(w[i:i + 50]))
        whole = {x for x in own if " ".join(map(bytes.decode, x)) in " ".join(map(bytes.decode, _words(rows[2][d].text)))}
        assert not whole & seen
        seen |= whole
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(kept[3]).collect() if r.taken}
    mixed = collections.Counter()
    for r in kept[4].collect():
        mixed[r.doc_id] += len(_words(r.text))
    assert mixed == taken
    packed = kept[5].collect()
    load = collections.Counter()
    for r in packed:
        load[r.sequence_id] += r.length
    assert max(load.values()) <= 1024 and {r.doc_id for r in packed} == set(mixed)
