import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from boreflow.llm import toxicity as X
from tests.llm.helpers import awkward, frame, prose


def brute_segments(s):
    """Recursive definition: the best segment, then the same left and right of it."""
    total = np.concatenate([[0], np.cumsum(s)])
    best = max(((total[j] - total[i], i - j, -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=None)
    if best is None or best[0] <= 1e-12:
        return []
    _, _, _, i, j = best
    return [*brute_segments(s[:i]), (i, j, best[0]), *[(a + j, b + j, v) for a, b, v in brute_segments(s[j:])]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-5, 5).map(lambda k: k + 0.123 * (k > 0)), max_size=14))
def test_segments_by_definition(values):
    s = np.array([v + 0.0001 * k * k for k, v in enumerate(values)])
    got = sorted(X.segments(s))
    want = sorted(brute_segments(s))
    assert np.allclose([g[2] for g in got], [w[2] for w in want]) and [g[:2] for g in got] == [w[:2] for w in want]


def test_scale_is_the_root():
    h = {-0.05: 100_000, 3.0: 10, 2.0: 5}
    lam = X.extreme_value_scale(h)
    n = sum(h.values()) + 1
    assert abs(sum(c * np.exp(lam * s) for s, c in h.items()) / n + np.exp(lam * 3.0) / n - 1) < 1e-6


def tables(spark):
    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        words = prose(k, 60).split()
        if toxic:
            words[10:10] = ["idiot", "vilex", "scum"]
        rows.append((k, " ".join(words)))
        labels.append((k, None, int(toxic)))
    return rows, spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (5, 0, 7)], "doc_id long, quality int, toxic int")


def test_learns_and_holds_out(spark):
    rows, labels = tables(spark)
    got = X.toxicity(frame(spark, rows + awkward()), labels).collect()
    assert len(got) == len(rows) + len(awkward())
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id > 20]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.97
    hit = next(r for r in got if r.doc_id == 24)
    assert (hit.first_word, hit.last_word) == (10, 12)


def test_one_class_and_empty_tables(spark):
    rows, labels = tables(spark)
    one = X.toxicity(frame(spark, rows[:20]), labels.filter("toxic = 0")).collect()
    assert len({r.score for r in one}) == 1 and one[0].score < 0.5
    assert X.toxicity(frame(spark, []), labels).count() == 0
    none = X.toxicity(frame(spark, rows[:5]), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
