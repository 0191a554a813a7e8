import numpy as np
import xxhash

from boreflow.llm import simhash as S
from tests.llm.helpers import awkward, frame, prose


def brute_fp(text):
    words = (text or "").encode().translate(S.FOLD).split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def check(spark, rows, **kw):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_dedup(frame(spark, rows), **kw).collect()}
    fps = [brute_fp(r[1]) for r in rows]
    comp = brute_components(fps)
    want = set()
    for (i, *_), fp, c in zip(rows, fps, comp, strict=True):
        ids = [r[0] for r, k in zip(rows, comp, strict=True) if k == c and r[0] is not None]
        want.add((i, f"{fp:016x}", min(ids, default=None)))
    assert got == want


def near(n, base=400, seed=3):
    out = []
    for k in range(n):
        words = prose(seed + k % 5, base).split()
        words[(k * 37) % base] = f"edit{k}"
        out.append((1000 - k, " ".join(words)))
    return out


def test_awkward_rows(spark):
    check(spark, awkward())


def test_near_copies_and_chains(spark):
    check(spark, near(60) + near(3) + [(5000 + k, prose(k, 30)) for k in range(40)])


def test_large_routes_are_cut_into_pairs_of_parts(spark):
    check(spark, near(60), cell_rows=8)


def test_empty_table(spark):
    assert S.simhash_dedup(frame(spark, [])).count() == 0


def test_tiles_equal_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    x = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(8)])
    labels = S.tile_links(x, None, 4, tile=16)
    want = brute_components([int(v) for v in x])
    assert labels.tolist() == want
    split = S.tile_links(x[:100], x[100:], 4, tile=16)
    for i in range(100):
        for j in range(100, len(x)):
            if bin(int(x[i]) ^ int(x[j])).count("1") <= 4:
                assert split[i] == split[j]


def test_every_close_pair_shares_a_route(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(-(2**63), 2**63 - 1, 50)
    pairs = []
    for v in a.tolist():
        w = v
        for b in rng.choice(64, 4, replace=False).tolist():
            w ^= 1 << b if b < 63 else -(2**63)
        pairs.append((v, w))
    f = spark.createDataFrame([(v,) for p in pairs for v in p], "fp long")
    routes = {}
    for r in S.routes(f).collect():
        routes.setdefault(r.fp, set()).add(r.route)
    assert all(routes[v] & routes[w] for v, w in pairs)
