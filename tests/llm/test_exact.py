import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from boreflow.llm.exact import digests, exact_dedup, merge_runs
from boreflow.llm.text import FOLD
from tests.llm.helpers import awkward, frame, prose


def brute(rows):
    groups = defaultdict(list)
    digest = lambda t: hashlib.sha256((t or "").encode().translate(FOLD)).hexdigest()
    for i, t, *_ in rows:
        groups[digest(t)].append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[digest(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, digest(t)))
    return sorted(out, key=str)


def test_awkward_rows(spark):
    rows = awkward()
    got = [tuple(r) for r in exact_dedup(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_many_copies_and_empty_table(spark):
    rows = [(i, "Same TEXT" if i % 3 else f"own {i}") for i in range(300)]
    got = [tuple(r) for r in exact_dedup(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert exact_dedup(frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = exact_dedup(frame(spark, awkward()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_merge_of_sorted_runs(spark):
    """Every round has one exchange, sorts what it received, and the optimizer keeps the sort."""
    docs = frame(spark, [(i, f"text {i % 37}" if i % 4 else "Hot TEXT") for i in range(400)])
    for n_runs, fan_bits, rounds in ((8, 3, 1), (16, 2, 2), (32, 1, 5)):
        runs = digests(docs).withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(n_runs)).cast("int"))
        merged = merge_runs(runs, n_runs, fan_bits)
        got = {r.text_sha256: (r.keep_id, r.group_size) for r in merged.collect()}
        want = {d: (k, n) for _, k, n, _, d in brute([(r.doc_id, r.text) for r in docs.collect()])}
        assert got == want and merged.count() == len(want)
        planned = merged._jdf.queryExecution()
        exchanges = planned.executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")
        assert exchanges == 1 + rounds and planned.optimizedPlan().toString().count("sort_array") == 1 + rounds


def test_long_texts_and_ids_of_any_type(spark):
    long = prose(4, 40_000)
    rows = [(3, long), (9, long.upper()), (5, long + "x"), (None, long), (7, "")]
    assert sorted((tuple(r) for r in exact_dedup(frame(spark, rows)).collect()), key=str) == brute(rows)
    named = frame(spark, rows).selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup(named).collect()} == {("d3", "d9"), ("d9", "d9"), ("d5", "d5"), (None, "d9"), ("d7", "d7")}
