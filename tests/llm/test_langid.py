import zlib

import numpy as np

from boreflow.llm import langid as G
from boreflow.llm.text import documents
from tests.llm.helpers import awkward, frame

EN, FR = "the quick brown fox and the lazy dog ", "le renard brun et la forêt où est le chien "


def test_gradients_match_differences():
    m = G.fit([b"abc", b"xyz"], ["a", "b"], hidden=3, epochs=1)
    for f in ("table", "recur", "out", "bias"):
        setattr(m, f, getattr(m, f).astype(np.float32))
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 123, (7, 4)).astype(np.uint8), np.array([0, 1, 1, 0])
    _, grads = G.gradients(m, x, y)
    for p, g in zip(m.params(), grads, strict=True):
        for k in np.argsort(-np.abs(g).reshape(-1))[:6]:
            at = np.unravel_index(k, p.shape)
            old, eps = p[at], 3e-3
            p[at] = old + eps
            up = G.gradients(m, x, y)[0]
            p[at] = old - eps
            down = G.gradients(m, x, y)[0]
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-2 * max(0.1, abs(g[at]))


def test_learns_two_languages_and_reads_whole_texts():
    spans = [(EN * 9)[k : k + 128].encode() for k in range(40)] + [(FR * 9)[k : k + 128].encode() for k in range(40)]
    m = G.fit(spans, ["en"] * 40 + ["fr"] * 40, epochs=30)
    p, share = G.pooled(m, [(EN * 100).encode(), FR.encode(), (EN * 30 + FR * 90).encode(), b""])
    assert p[0].argmax() == 0 and p[1].argmax() == 1 and p[2].argmax() == 1 and share[2][1] > 0.5
    assert np.allclose(p[:3].sum(axis=1), 1, atol=1e-4)


def test_awkward_rows(spark):
    rows = awkward()
    got = G.language_id(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert r.held_out == want and 0 <= r.score <= 1
        if r.doc_id in (1, 3, 6, 13):
            assert r.lang_pred == "und" and r.score == 0
    assert G.language_id(frame(spark, [])).count() == 0
    unlabelled = G.language_id(frame(spark, [(1, "some text"), (2, "other")])).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    got = G.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.9


def test_repeated_ids_are_one_document(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(G, "fit", lambda spans, labels: seen.update(spans=spans, labels=labels))
    ids = [k for k in range(1, 200) if zlib.crc32(str(k).encode()) % 4 != 2][:90]
    for hot in ids[:12]:
        rows = [(k, f"{k} " + EN * 60, "en") for k in ids] + [(hot, f"copy {k} " + EN * 60, "en") for k in range(150)]
        G.train(frame(spark, rows))
        assert len(seen["spans"]) == G.TRAIN_DOCS * G.TRAIN_SPANS
        assert sum(s.startswith(b"copy") for s in seen["spans"]) == 0 and len({s for s in seen["spans"] if s[:1].isdigit()}) == G.TRAIN_DOCS


def test_numerals_and_marks_are_no_letters(spark):
    texts = ["\u00bd \u00b2 100", "\u2167", "\u0301\u0302", "\u2460 \u3289", "\u00bd a", "\u00aa", "\u4e2d", "_ 12"]
    rows = [(k, EN * 4, "en") for k in range(100, 110)] + [(k, t, "en") for k, t in enumerate(texts)]
    got = {r.doc_id: r.lang_pred for r in G.language_id(frame(spark, rows)).collect()}
    assert [got[k] for k in range(len(texts))] == ["und"] * 4 + ["en"] * 3 + ["und"]


def test_very_long_text(spark):
    rows = [(k, EN * 4, "en") for k in range(100, 110)] + [(k, FR * 4, "fr") for k in range(200, 210)] + [(1, EN * 400 + FR * 1200, "fr")]
    got = {r.doc_id: r for r in G.language_id(frame(spark, rows)).collect()}
    assert got[1].lang_pred == "fr" and got[1].position_share > 0.5
