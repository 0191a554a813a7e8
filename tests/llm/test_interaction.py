from collections import Counter, defaultdict
from itertools import permutations

import numpy as np

from boreflow.llm import interaction as I
from tests.llm.helpers import awkward, frame, prose


def brute(rows, labels):
    docs = []
    for i, text, *rest in rows:
        t = text or ""
        w = t.encode().split()
        fails = set()
        if len(w) < 50:
            fails.add("A")
        if 100 * len(set(w)) < 65 * len(w):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            fails.add("C")
        if set(t) & set("#$%&*|"):
            fails.add("D")
        if i is not None and any(o[0] is not None and o[0] < i and (o[1] or "") == t for o in rows):
            fails.add("E")
        mine = [x for x in labels if i is not None and x[0] == i]
        docs.append(((rest[1] if len(rest) > 1 else None) or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    parts = defaultdict(list)
    for d in docs:
        parts[d[0]].append(d)
    out = []
    for part, ds in parts.items():
        worth, lines = Counter(), []
        for order in permutations("ABCDE"):
            left = ds
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                stay = [d for d in left if f not in d[1]]
                late = sum(f in d[1] for d in ds) - len(gone)
                worth[f] += len(gone)
                lines.append((part, "".join(order), k + 1, len(stay), len(gone), late, sum(d[1] == {f} for d in ds), sum(d[2] for d in gone), sum(d[3] for d in gone), f))
                left = stay
        out += [(*x[:-1], worth[x[-1]]) for x in lines]
    return sorted(out)


def varied():
    rows = []
    for k in range(160):
        text = prose(k, 20 + k % 70, [f"word{j}" for j in range(30 if k % 3 else 400)])
        text += " #tag" if k % 5 == 0 else ""
        rows.append((k, text.upper() if k % 7 == 0 else text, "en", f"s{k % 4}"))
    return rows + [(1000 + k, rows[k][1], "en", f"s{k % 3}") for k in range(0, 60, 2)] + [(4000, prose(1, 50_000), "en", "s1")]


def test_equal_to_applying_every_order(spark):
    rows = awkward() + varied()
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 200, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (7, None, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in I.interaction_audit(frame(spark, rows), known).collect())
    assert got == brute(rows, labels)


def test_without_labels_and_empty_table(spark):
    assert all(r.good_lost == 0 and r.toxic_lost == 0 for r in I.interaction_audit(frame(spark, awkward())).collect())
    assert I.interaction_audit(frame(spark, [])).count() == 0


def test_positional_popcount():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 1023, 1024, 1025, 5000, 20_000):
        words = rng.integers(0, 2**32, n, dtype=np.uint32)
        want = [(int(((words >> b) & 1).sum())) for b in range(32)]
        assert I.positional_popcount(words).tolist() == want


def test_survival_words():
    for failed in range(32):
        word = I.survival_word(failed)
        assert all((word >> s & 1) == (s & failed == 0) for s in range(32))
