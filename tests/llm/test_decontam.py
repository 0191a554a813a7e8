import re

from boreflow.llm import decontam as D
from tests.llm.helpers import awkward, frame, prose


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(docs, items):
    out = set()
    for i, t, *_ in docs:
        have = shingles(t)
        for j, u in items:
            want = shingles(u)
            if i is not None and j is not None and want and len(want & have) / len(want) >= 0.8:
                out.add((i, j, len(want), len(want & have)))
    return out


VOCAB = [f"w{k}" for k in range(300)]


def test_by_brute_force(spark):
    items = [(k, prose(900 + k, n, VOCAB)) for k, n in enumerate((5, 7, 9, 17, 30, 33, 64, 120, 400, 3))] + [(50, None), (51, ""), (None, "one two three four five six")]
    docs = awkward()
    for k, (_, t) in enumerate(items[:10]):
        docs.append((100 + k, f"{prose(k, 700, VOCAB)} {t.upper()}, {prose(k + 50, 900, VOCAB)}"))
        words = t.split()
        words[len(words) // 2] = "changed"
        docs.append((200 + k, f"{prose(k + 7, 333, VOCAB)} {' '.join(words)} {prose(k + 70, 40, VOCAB)}"))
    docs += [(300, items[9][1]), (301, items[4][1]), (301, items[4][1])]
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in D.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert got == want and {(100 + k, k) for k in range(9)} <= {w[:2] for w in want}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contamination(frame(spark, awkward()), none).count() == 0
    assert D.contamination(frame(spark, []), one).count() == 0
