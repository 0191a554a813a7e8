import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from boreflow.llm import mixing as M
from tests.llm.helpers import awkward, frame, prose


def rows_of(sizes):
    return [(1000 * s + k, prose(s * 77 + k, 5 + (k * 7) % 40), "en", f"s{s}") for s, n in enumerate(sizes) for k in range(n)]


def check(spark, rows, **kw):
    out = M.mix(frame(spark, rows), **kw).collect()
    words = lambda t: len((t or "").encode().split())
    total, largest, by_doc = Counter(), Counter(), Counter((r[0], r[3]) for r in rows)
    for _, t, _, s in rows:
        total[s] += words(t)
        largest[s] = max(largest[s], words(t))
    got, passes = Counter(), defaultdict(Counter)
    for r in out:
        got[r.source] += r.n_tokens
        passes[r["pass"]][r.doc_id, r.source] += 1
    assert all(c[k] <= by_doc[k] for c in passes.values() for k in c)
    budget = kw.get("budget") or sum(total.values())
    a = out[0].exponent
    raw = {s: (t / sum(total.values())) ** a for s, t in total.items() if t}
    z = sum(raw.values())
    for s, w in raw.items():
        assert budget * w / z - largest[s] - 1 <= got[s] <= budget * w / z + 1
    return a, {s: w / z for s, w in raw.items()}, {s: budget * w / z / total[s] for s, w in raw.items()}


def test_entropy_target_binds(spark):
    a, w, _ = check(spark, rows_of((200, 60, 30, 20)), entropy_share=0.95, max_passes=50)
    h = -sum(x * math.log(x) for x in w.values())
    assert 0 < a < 1 and h == pytest.approx(0.95 * math.log(4), abs=1e-4)


def test_repetition_limit_binds(spark):
    a, _, reps = check(spark, rows_of((200, 5, 3)), entropy_share=1.0, max_passes=3)
    assert 0 < a < 1 and max(reps.values()) == pytest.approx(3, abs=1e-3)


def test_budget_and_awkward_rows(spark):
    check(spark, rows_of((40, 10)), budget=150)
    check(spark, rows_of((40, 10)) + [(5000, prose(1, 30_000), "en", "s1")])
    check(spark, awkward())
    assert M.mix(frame(spark, [])).count() == 0
    assert M.mix(frame(spark, [(1, None, None, "a")])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = M.mix(frame(spark, awkward()).withColumn("x", F.lit(1)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_budget_beyond_the_passes_is_refused(spark):
    rows = rows_of((40, 10))
    total = sum(len(t.split()) for _, t, *_ in rows)
    with pytest.raises(ValueError, match="3 passes"):
        M.mix(frame(spark, rows), budget=5 * total, max_passes=3)
    full = M.mix(frame(spark, rows), budget=3 * total, max_passes=3).collect()
    assert Counter(r.doc_id for r in full) == {r[0]: 3 for r in rows}


@pytest.mark.parametrize("ids", ["none", "one", "rows alike"])
def test_repeated_and_null_ids_do_not_depend_on_the_partitioning(spark, ids):
    rows = [({"none": None, "one": 7}.get(ids, k % 40), prose(k % 40 if ids == "rows alike" else k, 3 + k % 30), "en", f"s{k % 7 // 4}") for k in range(700)]
    runs = []
    for parts in (1, 13):
        out = M.mix(frame(spark, rows).repartition(parts), budget=4000).collect()
        runs.append(sorted((str(r.doc_id), r.source, r["pass"], r.n_tokens, r.order_key) for r in out))
        assert len({(r.source, r.order_key) for r in out}) == len(out)
    assert runs[0] == runs[1]
