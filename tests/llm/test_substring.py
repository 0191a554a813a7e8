import hashlib

import numpy as np

from boreflow.llm import substring as B
from tests.llm.helpers import awkward, frame, prose


def brute(rows, window=13):
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in texts:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_with_passages():
    passage, short = prose(1, 60), prose(2, 12)
    rows = awkward()
    for k in range(40):
        rows.append((100 + (k * 17) % 40, f"{prose(k + 10, 30)} {passage}\n{prose(k + 60, 25)}  {short} {prose(k + 99, 5)}"))
    rows += [(200 + k, prose(10, 30) + " " + passage[: 40 + 9 * k]) for k in range(20)]
    rows += [(300, "go " * 200), (301, "go " * 150), (301, "go " * 150), (302, prose(1, 200, ["a", "b"]))]
    return rows


def test_by_brute_force(spark):
    rows = rows_with_passages()
    for kw in ({}, {"batch_bytes": 2_000, "shard_bytes": 3_000}):
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in B.substring_dedup(frame(spark, rows), **kw).collect()]
        assert sorted(got, key=str) == brute(rows)
    assert B.substring_dedup(frame(spark, [])).count() == 0


def test_frequent_phrase_is_spread_over_shards(spark, monkeypatch, tmp_path):
    # A phrase whose 6-gram is the smallest hash of nearly all windows around it, in ever new contexts.
    phrase = min((prose(s, 6, [f"w{k}" for k in range(50)]) for s in range(3_000)), key=lambda p: int(B.Segments([p.encode()], 6).route[0]))
    names = [f"n{k}" for k in range(400)]
    rows = [(k, f"{prose(k, 12, names)} {phrase} {prose(k + 5_000, 12, names)}") for k in range(300)]
    rows += [(1_000 + k, rows[k][1]) for k in range(20)]
    kind = type(frame(spark, []))
    whole = kind.mapInArrow

    def spied(self, fn, schema):
        if self.columns != ["shard", "batch", "blob"]:
            return whole(self, fn, schema)

        def counted(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    size = sum(map(len, B.unpack(r["blob"])[1]))
                    (tmp_path / f"{r['shard']}-{r['batch']}-{size}").touch()
                yield batch

        return whole(whole(self, counted, self.schema), fn, schema)

    monkeypatch.setattr(kind, "mapInArrow", spied)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in B.substring_dedup(frame(spark, rows), batch_bytes=10_000, shard_bytes=4_000).collect()]
    assert sorted(got, key=str) == brute(rows)
    held = {}
    for shard, _, size in (f.name.split("-") for f in tmp_path.iterdir()):
        held[shard] = held.get(shard, 0) + int(size)
    assert sum(held.values()) > 50_000 and max(held.values()) < sum(held.values()) / 4


def test_index_against_scan():
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(0, 6, 900), 0)
    ids = rng.integers(0, 50, len(text))
    index = B.FMIndex(text, ids, 6, 7)
    matrix = B.WaveletMatrix(text, 6)
    at = rng.integers(0, len(text) + 1, 200)
    sym = rng.integers(0, 6, 200)
    assert matrix.rank(sym, at).tolist() == [int((text[:p] == s).sum()) for p, s in zip(at, sym, strict=True)]
    starts = np.array([k for k in range(len(text) - 7) if (text[k : k + 7] > 0).all()])
    length, found = B.statistics(index, text, starts, 7)
    assert (length == 7).all()
    for k, f in zip(starts, found, strict=True):
        assert f == min(ids[j] for j in range(len(text) - 6) if (text[j : j + 7] == text[k : k + 7]).all())
    stranger = np.append(text, [1, 2, 3, 4, 5, 5, 5])
    n, _ = B.statistics(index, stranger, np.array([len(text)]), 7)
    assert 0 < n[0] <= 7
