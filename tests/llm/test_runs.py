import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from boreflow.llm import runs as R
from tests.llm.helpers import awkward, frame, prose


def brute_lyndon(s):
    best = [1] * len(s)
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            w = s[i:j]
            if all(w < w[k:] for k in range(1, len(w))):
                best[i] = j - i
    return best


def brute_runs(w, least=6, times=4):
    out = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, times * q) and not any(all(w[x] == w[x + d] for x in range(i, i + n - d)) for d in range(1, q)):
                out.add((i, n, q))
            i = j
    return sorted(out)


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode())
    kept = sha(b" ".join(w for i, w in enumerate(words) if i not in gone))
    if not runs:
        return (doc_id, 0, None, None, None, None, lines, kept)
    s, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return (doc_id, len(runs), s, n, q, 1000 * n // q, lines, kept)


def brute_tail(doc_id, text):
    if doc_id is None:
        return text
    h = zlib.crc32(str(doc_id).encode())
    w = (text or "").encode().split()
    if h % 10 or not w:
        return text
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(w[:a] + [w[a + (i - a) % p] for i in range(a, n)]).decode()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def repeated(seed):
    rng = random.Random(seed)
    words = prose(seed, rng.randint(0, 80), ["a", "b", "c", "d"][: rng.randint(1, 4)]).split()
    unit = prose(seed + 1, rng.randint(1, 9)).split() if rng.random() < 0.7 else words[:3]
    at = rng.randint(0, len(words))
    return " ".join(words[:at] + unit * rng.randint(2, 8) + unit[: rng.randint(0, len(unit))] + words[at:])


def test_lyndon_lengths_equal_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        s = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(1, 30))]
        assert R.lyndon_lengths(np.array(s)).tolist() == brute_lyndon(s)


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (5, 3)])
def test_runs_of_texts_equal_brute_force(least, times):
    texts = [repeated(k).encode().split() for k in range(120)] + [[], [b"x"] * 50, [b"x", b"y"] * 40 + [b"x"]]
    got = [[tuple(x) for x in r.tolist()] for r in R.runs_of_texts(texts, least, times)]
    assert got == [brute_runs(t, least, times) for t in texts]


def test_operator_and_digest(spark):
    rows = [*awkward(), *((100 + k, repeated(k)) for k in range(150)), (900, "z " * 5000), (901, prose(3, 6000) + " u v w" * 9)]
    assert rows_of(R.run_digest(R.periodic_runs(frame(spark, rows)))) == sorted((brute_row(*r[:2]) for r in rows), key=str)


def test_repeated_tails(spark):
    rows = [*awkward(), *((k, prose(k, k % 90)) for k in range(20, 400))]
    made = R.repeat_tails(frame(spark, rows))
    got = rows_of(R.run_digest(R.periodic_runs(made)))
    assert got == sorted((brute_row(r[0], brute_tail(*r[:2])) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_are_real_output(spark):
    r = R.periodic_runs(frame(spark, [(1, "a b x y x y x y x y c")])).first()
    assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (11, [(2, 8, 2)], "a b x y c")


def test_empty_table_and_bad_parameter(spark):
    assert R.run_digest(R.periodic_runs(frame(spark, []))).count() == 0
    with pytest.raises(ValueError):
        R.periodic_runs(frame(spark, []), min_exponent=1)
