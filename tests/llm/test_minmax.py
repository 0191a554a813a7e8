import numpy as np
from pyspark.sql import functions as F

from boreflow.llm import minmax as M
from boreflow.llm.text import FOLD
from tests.llm.helpers import awkward, frame, prose


def brute_set(text):
    words = (text or "").encode().translate(FOLD).split()
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[k : k + 3]) for k in range(len(words) - 2)) or frozenset([b" ".join(words)])


def brute(rows):
    sets = [brute_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = []
    for k, r in enumerate(rows):
        ids = [x[0] for j, x in enumerate(rows) if find(j) == find(k) and x[0] is not None] if sets[k] else [r[0]]
        least = min([i for i in ids if i is not None], default=None)
        out.append((r[0], len(sets[k]), least, r[0] == least))
    return sorted(out, key=str)


def check(spark, rows, **kw):
    got = sorted((tuple(r) for r in M.minhash_dedup(frame(spark, rows), **kw).collect()), key=str)
    assert got == brute(rows)
    return got


def edited(seed, n, base, edits, first_id):
    rng = np.random.default_rng(seed)
    words = [f"w{x}" for x in rng.integers(0, 3000, base)]
    out = []
    for k in range(n):
        own = list(words)
        for at in rng.choice(base, edits(k), replace=False):
            own[at] = f"e{first_id}x{k}y{at}"
        out.append((first_id + k, " ".join(own)))
    return out


def test_awkward_rows(spark):
    check(spark, awkward())


def test_copies_near_and_far(spark):
    rows = edited(1, 40, 300, lambda k: k % 9, 1000) + edited(2, 25, 40, lambda k: k % 3, 2000) + [(9000 + k, prose(k, 60)) for k in range(20)]
    rows += [(r[0] + 50_000, r[1].upper()) for r in rows[:10]]
    got = check(spark, rows)
    assert len({r[2] for r in got}) < len(got)


def test_large_clusters_go_part_by_part(spark):
    """Pairs in different parts, in and outside the pivot's class, are compared too."""
    rows = edited(3, 60, 200, lambda k: (3, 9, 14)[k % 3], 100)
    check(spark, rows, part_sets=7)


def test_very_long_text_and_empty_table(spark):
    long = prose(8, 40_000, [f"v{k}" for k in range(5000)])
    check(spark, [(1, long), (2, long + " end"), (3, prose(9, 50))])
    assert M.minhash_dedup(frame(spark, [])).count() == 0


def test_links_equal_all_pairs():
    rng = np.random.default_rng(5)
    pool = np.arange(4000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[lo : lo + 60], 50, replace=False)) for lo in rng.choice([0, 5, 10, 900, 905], 120)]
    sets += [np.unique(rng.choice(pool, 30)) for _ in range(30)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = M.shared_counts(sets, None)
    off = ~np.eye(len(sets), dtype=bool)
    assert (got[off] == want[off]).all()
    assert (M.shared_counts(sets[:60], sets[60:]) == want[:60, 60:]).all()


def test_minima_and_maxima_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(6)
    agree = []
    for _ in range(60):
        union = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = np.sort(union[:360]), np.sort(union[40:])  # similarity 0.8
        v = [(s[None, :] ^ M._SALT[:, None]) * M._MULT[:, None] for s in (a, b)]
        agree += [np.mean(v[0].min(1) == v[1].min(1)), np.mean(v[0].max(1) == v[1].max(1))]
    assert abs(np.mean(agree) - 0.8) < 0.02


def test_plan_has_no_cross_join(spark):
    d = frame(spark, edited(1, 10, 50, lambda k: 1, 1))
    plan = M.minhash_dedup(d)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert M.sketches(d.select("doc_id", "text")).filter(F.size("keys") != M.BANDS).count() == 0
