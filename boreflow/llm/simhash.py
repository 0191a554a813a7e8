"""SimHash near-dedup: fingerprints, tiled exact comparison, components of linked fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreflow.llm.components import components
from boreflow.llm.text import FOLD, bytes_list, map_arrow, materialize, narrow

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 1024
CELL_ROWS = 32_768  # fingerprints of one side of a cell; larger routes are cut into pairs of parts
SMALL = 64  # cells up to this size are compared by shifting instead of tiles
_CHUNK = 65_536


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half of the shingle hashes (0: no words)."""
    words = text.translate(FOLD).split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    first, last = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[i : i + _CHUNK], last[i : i + _CHUNK], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(b, shingle) for b in bytes_list(batch.column("text"))], np.uint64).view(np.int64)
        return pa.record_batch([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    d = narrow(docs, doc_id=id_col, text=text_col)
    return map_arrow(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def routes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(route, fp): each fingerprint once for every choice of two of radius + 2 bit blocks.

    Two fingerprints within the radius differ in at most ``radius`` blocks, so they agree on two
    blocks at least and meet on some route; nothing is lost by comparing inside routes only.
    """
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned("fp", lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    span = max(b - a for a, b in zip(cuts, cuts[1:], strict=False))
    keys = [
        F.lit(k).cast("long") * (1 << (2 * span)) + F.shiftleft(block[i], span) + block[j]
        for k, (i, j) in enumerate(combinations(range(n), 2))
    ]
    return fps.select("fp", F.explode(F.array(*keys)).alias("route"))


def cells(routed: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(route, lo, hi, side, fp): a route of up to ``cell_rows`` fingerprints is one cell (0, 0).

    A larger one is cut into s parts by hash, and its cells are the pairs of parts (lo <= hi), so
    every pair of fingerprints still meets and no task holds more than two parts.
    """
    sizes = routed.groupBy("route").count().filter(F.col("count") > cell_rows).select("route", F.ceil(F.col("count") / cell_rows).cast("int").alias("parts"))
    r = routed.join(sizes, "route", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    r = r.withColumn("side", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return r.select("route", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "fp")


def _hook(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the classes of i and j; labels always point at the smallest index of their class."""
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return labels
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(nxt := labels[labels], labels):
            labels = nxt


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int, tile: int = TILE) -> np.ndarray:
    """Class labels of concatenated a and b after exact comparison of all their tiles.

    Both sides are sorted by population count; two tiles whose counts differ by more than the
    radius hold no pair within it and are skipped. Without b, a is compared with itself.
    """
    values = a if b is None else np.concatenate([a, b])
    labels = np.arange(len(values))

    def tiles(x: np.ndarray, base: int) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
        ones = np.bitwise_count(x)
        order = np.argsort(ones, kind="stable")
        return [(x[p], p + base, int(ones[p[0]]), int(ones[p[-1]])) for p in (order[k : k + tile] for k in range(0, len(x), tile))]

    left = tiles(a, 0)
    right = left if b is None else tiles(b, len(a))
    for k, (x, xi, low, high) in enumerate(left):
        for y, yi, y_low, y_high in right[k:] if b is None else right:
            if y_low - high > radius or low - y_high > radius:
                continue
            r, c = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            labels = _hook(labels, xi[r], yi[c])
    return labels


def _small_links(cell: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """Class labels of many small cells at once: compare every row with the d-th next of its cell."""
    labels = np.arange(len(fp))
    at = np.arange(len(fp) - 1)
    d = 1
    while len(at := at[at < len(fp) - d]) and len(at := at[cell[at] == cell[at + d]]):
        near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= radius]
        labels = _hook(labels, near, near + d)
        d += 1
    return labels


def _cell_edges(route: np.ndarray, lo: np.ndarray, hi: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, smallest-index fp of its class) of complete cells in sorted order: a forest."""
    new = np.flatnonzero((np.diff(route) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
    bounds = np.concatenate([[0], new, [len(fp)]])
    cell = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    big = np.diff(bounds) > SMALL
    big |= lo[bounds[:-1]] != hi[bounds[:-1]]
    rows = np.flatnonzero(~big[cell])
    a, b = [], []
    labels = _small_links(cell[rows], fp[rows], radius)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    a.append(fp[rows][moved])
    b.append(fp[rows][labels[moved]])
    for k in np.flatnonzero(big):
        x, s = fp[bounds[k] : bounds[k + 1]], side[bounds[k] : bounds[k + 1]]
        p, q = lo[bounds[k]], hi[bounds[k]]
        if p == q:
            values, labels = x, tile_links(x, None, radius)
        else:
            left, right = x[s == p], x[s == q]
            values, labels = np.concatenate([left, right]), tile_links(left, right, radius)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        a.append(values[moved])
        b.append(values[labels[moved]])
    return np.concatenate(a), np.concatenate(b)


def links(fps: DataFrame, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that span every class linked within a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("route", "lo", "hi", "side", "fp")
        held = [np.zeros(0, np.int64)] * 5

        def edges(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _cell_edges(*cols[:4], cols[4].view(np.uint64), radius)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            cols = [np.concatenate([h, batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)]) for h, n in zip(held, names, strict=True)]
            new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0))
            cut = new[-1] + 1 if len(new) else 0  # the last cell may go on in the next batch
            if cut:
                yield edges([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if len(held[0]):
            yield edges(held)

    distinct = fps.select("fp").distinct()
    c = cells(routes(distinct, radius), cell_rows)
    return c.repartition("route", "lo", "hi").sortWithinPartitions("route", "lo", "hi").mapInArrow(run, "a long, b long")


def simhash_dedup(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, group_size.

    Documents are linked when their fingerprints differ in at most ``radius`` bits; component_id
    is the smallest doc_id reachable over links. Copies share a fingerprint, so comparison runs
    over distinct fingerprints. Defined cases: null and empty texts have fingerprint zero and are
    linked like any other; texts shorter than the shingle hash as one shingle; rows with a null id
    take part and get the component of their fingerprint (null if it holds only null ids);
    repeated rows give repeated rows; an empty table gives no rows; extra columns are not read.
    """
    fps = materialize(fingerprints(docs, shingle, id_col, text_col))
    classes = components(links(fps, radius, cell_rows))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    rooted = first.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("group_size"))
    named = rooted.select("fp", "root").join(whole, "root").select("fp", "component_id", "group_size")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")
