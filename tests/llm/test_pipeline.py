import hashlib

import corpus_pipeline
from boreflow.llm import decontam, langid, simhash, stages
from boreflow.llm.text import documents
from tests.llm.helpers import awkward, frame, prose

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = documents(spark, SF)
    judged = {r.doc_id: r for r in langid.language_id(docs).collect()}
    kept = stages.language(spark, docs, SF)
    assert kept.columns == stages.COLUMNS
    assert {r.doc_id for r in kept.collect()} == {i for i, r in judged.items() if r.lang_pred != "und" and r.score >= stages.LEAST_SCORE}
    single = stages.near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in simhash.simhash_dedup(docs).collect()})
    leaks = {r.doc_id for r in decontam.contamination(docs, decontam.benchmark(spark, SF)).collect()}
    assert leaks and {r.doc_id for r in stages.decontaminate(spark, docs, SF).collect()} == {r.doc_id for r in docs.collect()} - leaks


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(out.columns) and rows
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_awkward_rows(spark):
    docs = frame(spark, awkward())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == stages.COLUMNS
    corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    empty = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_near_duplicates_keep_one_row_of_each_component(spark):
    a, b, c, d, e = (prose(700 + k, 400, [f"{k}x{j}" for j in range(300)]) for k in range(5))
    rows = [(None, a), (None, a + " end"), (None, b), (None, c), (1, c + " end"), (7, d), (7, e), (7, d), (9, d + " end"), (9, e + " end"), (3, e)]
    component = {r.fingerprint: r for r in simhash.simhash_dedup(frame(spark, rows)).collect()}
    print_of = {t: f"{simhash.fingerprint(t.encode()):016x}" for _, t in rows}
    root: dict[str, str] = {}
    for t, p in print_of.items():
        near = [u for u, q in print_of.items() if (int(p, 16) ^ int(q, 16)).bit_count() <= simhash.RADIUS]
        root[t] = min(near)
        assert {component[print_of[u]].component_id for u in near} == {component[p].component_id}
    best: dict[str, tuple] = {}
    for i, t in rows:
        rank = (i is None, i or 0, hashlib.sha256(t.encode()).digest(), i, t)
        best[root[t]] = min(best.get(root[t], rank), rank)
    want = sorted((r[3:] for r in best.values()), key=str)
    docs = frame(spark, rows)
    got = sorted(((r.doc_id, r.text) for r in stages.near_duplicates(spark, docs, SF).collect()), key=str)
    assert got == want and len(want) == 5
    # Of one source, the mix reads every document it is given once.
    mixed = stages.mix(spark, frame(spark, want), SF).collect()
    assert sorted(((r.doc_id, r.text) for r in mixed), key=str) == want


def test_decontaminate_judges_rows_by_text(spark):
    item = max((r.text for r in decontam.benchmark(spark, SF).collect() if r.text), key=len)
    clean = [(None, prose(800, 60)), (7, prose(801, 60)), (None, None), (8, "")]
    leaks = [(None, f"{prose(802, 20)} {item}"), (7, f"{item} {prose(803, 20)}")]
    got = stages.decontaminate(spark, frame(spark, clean + leaks), SF).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(clean, key=str)
