"""MinHash near-dedup by min-max hashing: banded signatures of minima and maxima, links confirmed on full sets.

A permutation of the shingles gives two signature values, its minimum and its maximum, so a
signature takes half the hash evaluations of plain MinHash. Two sets agree in a minimum, and
likewise in a maximum, with probability equal to their similarity. Bands only propose: sets that
share a band meet in one cluster, and inside a cluster every pair of sets is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreflow.llm.components import components
from boreflow.llm.simhash import _hook as merge_classes
from boreflow.llm.text import FOLD, SPACE, bytes_list, map_arrow, materialize, mix64, narrow, word_hashes

SHINGLE = 3
SIMILAR = (85, 100)  # linked when intersection / union >= 85 / 100
BANDS = 32
PER_BAND = 3  # permutations of a band, two values each: a pair of similarity 0.85 shares no band with probability 3e-7
PART_DOCS = 200  # texts hashed at once
PART_SETS = 2048  # sets and shingles of a part; larger clusters are compared part by part
PART_SHINGLES = 1 << 21
BITMAP_BITS = 23
RARE = 8  # shingles in up to so many sets of a cell are counted pair by pair, others by matrix products
_COLUMNS = 2048
_N = BANDS * PER_BAND
_SALT = mix64(np.arange(1, _N + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MULT = mix64(np.arange(1001, _N + 1001, dtype=np.uint64)) | np.uint64(1)
_STEP = mix64(np.arange(5001, 5001 + 64, dtype=np.uint64)) | np.uint64(1)
_SET = mix64(np.arange(7001, 7002, dtype=np.uint64))[0]


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes text by text, number of them in each text).

    A text with fewer words than ``size`` has its whole sequence as one shingle, one without words has none.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts, _, words = word_hashes(b" ".join(texts).translate(FOLD), SPACE)
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    n = np.bincount(owner, minlength=len(texts))
    left = np.repeat(np.cumsum(n), n) - np.arange(len(words))  # words from here to the text's end
    total = np.zeros(len(words), np.uint64)
    for k in range(size):
        term = words[k:] * _STEP[k]
        term[left[: len(term)] <= k] = 0
        total[: len(term)] += term
    own = np.repeat(n, n)
    keep = (left >= size) | ((own < size) & (left == own))
    hashes, owner = mix64(total[keep] + np.minimum(left[keep], size).astype(np.uint64)), owner[keep]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.concatenate([[True], (np.diff(owner) != 0) | (hashes[1:] != hashes[:-1])]) if len(hashes) else np.zeros(0, bool)
    return hashes[new], np.bincount(owner[new], minlength=len(texts))


def set_ids(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set (0 for the empty one): equal sets have equal ids."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = mix64(np.add.reduceat(mix64(hashes ^ _SET), (np.cumsum(counts) - counts)[full]) + counts[full].astype(np.uint64))
    return out


def band_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts with shingles, BANDS) keys: each digests the minima and maxima of its PER_BAND permutations."""
    full = counts[counts > 0]
    starts = np.cumsum(full) - full
    keys = np.zeros((len(full), BANDS), np.uint64)
    for j in range(_N if len(full) else 0):
        v = (hashes ^ _SALT[j]) * _MULT[j]
        band = j // PER_BAND
        for value in (np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)):
            keys[:, band] = mix64(keys[:, band] ^ value) + np.uint64(j + 1)
    return keys


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, keys): set id and band keys of each text (null node and no keys without shingles)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = bytes_list(batch.column("text"))
        counts, nodes, keys = [], [], []
        for k in range(0, len(texts), PART_DOCS):
            h, n = shingle_sets(texts[k : k + PART_DOCS])
            counts.append(n)
            nodes.append(set_ids(h, n))
            keys.append(band_keys(h, n))
        n = np.concatenate(counts)
        node = pa.array(np.concatenate(nodes).view(np.int64), mask=n == 0)
        offsets = np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys).view(np.int64).reshape(-1)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), node, lists], names=["doc_id", "n_shingles", "node", "keys"])

    return map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, node long, keys array<long>")


def clusters(sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the sets that share bands, directly or over others, and (node, weight) of those nodes.

    Each set is tied to the smallest set of each of its buckets, so links grow with the bands, not
    with the square of a bucket. The weight is the number of texts in all buckets of a set.
    """
    rows = sketched.filter("n_shingles > 0").select("node", F.posexplode("keys").alias("band", "key"))
    buckets = rows.groupBy("band", "key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most")
    ties = materialize(rows.join(buckets.drop("most"), ["band", "key"]).groupBy("node", "least").agg(F.sum("n").alias("n")))
    weight = ties.groupBy("node").agg(F.sum("n").alias("weight"))
    return components(ties.select(F.col("node").alias("a"), F.col("least").alias("b")).filter("a <> b")), weight


def member_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(node, text): one text of each set in ``members``.

    A fixed bitmap of the members thins the texts before the shuffle (more members make it less
    sharp, never wrong), and a task sends a set once, however many copies it has.
    """
    place = F.shiftrightunsigned("node", 64 - BITMAP_BITS)
    words = members.withColumn("place", place).groupBy(F.shiftright("place", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    table = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for r in words.collect():  # at most 2 ** (BITMAP_BITS - 6) rows
        table[r.w] = r.bits
    bitmap = table.view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = bytes_list(batch.column("text"))
            nodes = np.concatenate([set_ids(*shingle_sets(texts[k : k + PART_DOCS])) for k in range(0, len(texts), PART_DOCS)])
            bit = nodes >> np.uint64(64 - BITMAP_BITS)
            known = (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
            first = np.unique(nodes, return_index=True)[1]
            mine = np.array([i for i in first[known[first]].tolist() if nodes[i] and int(nodes[i]) not in sent], np.int64)
            sent.update(nodes[mine].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(nodes[mine].view(np.int64)), batch.column("text").take(pa.array(mine))], names=["node", "text"])

    return docs.select("text").mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def shared_counts(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Intersection sizes of all pairs of sets of a with sets of b (with each other without b).

    Shingles of one set only are left out; those in few sets are counted pair by pair, the others
    by products of 0/1 matrices, a block of columns at a time.
    """
    sets = a if b is None else a + b
    sizes = np.array([len(s) for s in sets], np.int64)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    out = np.zeros((len(sets), len(sets)) if b is None else (len(a), len(b)), np.float32)
    seen = counts[column]

    rare = np.flatnonzero((seen > 1) & (seen <= RARE))
    rare = rare[np.argsort(column[rare], kind="stable")]
    for d in range(1, RARE):  # rows of one shingle stand together: pair each with the d-th next
        x, y = rare[:-d], rare[d:]
        same = column[x] == column[y]
        i, j = row[x[same]], row[y[same]]
        if b is None:
            np.add.at(out, (np.concatenate([i, j]), np.concatenate([j, i])), 1)
        else:
            cross = (i < len(a)) & (j >= len(a))
            np.add.at(out, (i[cross], j[cross] - len(a)), 1)
    often = np.flatnonzero(counts > RARE)
    name = np.full(len(counts), -1, np.int64)
    name[often] = np.arange(len(often))
    mine = np.flatnonzero(seen > RARE)
    mine = mine[np.argsort(name[column[mine]], kind="stable")]
    cuts = np.searchsorted(name[column[mine]], np.arange(0, len(often) + _COLUMNS, _COLUMNS))
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        m = np.zeros((len(sets), min(_COLUMNS, len(often) - k * _COLUMNS)), np.float32)
        m[row[mine[lo:hi]], name[column[mine[lo:hi]]] - k * _COLUMNS] = 1
        out += m @ m.T if b is None else m[: len(a)] @ m[len(a) :].T
    return out


def links(a: list[np.ndarray], b: list[np.ndarray] | None = None, similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """Class labels of the sets of a and b after the exact comparison of all their pairs."""
    shared = shared_counts(a, b).astype(np.int64)
    n = np.array([len(s) for s in a], np.int64)
    other = n if b is None else np.array([len(s) for s in b], np.int64)
    i, j = np.nonzero(similar[1] * shared >= similar[0] * (n[:, None] + other[None, :] - shared))
    labels = np.arange(len(a) + (0 if b is None else len(b)))
    if b is None:
        i, j = i[i < j], j[i < j]
    else:
        j = j + len(a)
    return merge_classes(labels, i, j)


def cell_edges(cells: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Edges (a, b) that span every class linked within a cell; cells: root, lo, hi, side, node, text.

    A cell with hi < 0 compares all its sets with each other; another one those of side 0 with those of side 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [])

        def edges() -> tuple[list[int], list[int]]:
            (an, asets), (bn, bsets) = (list(zip(*h, strict=True)) if h else ((), ()) for h in held)
            if key[2] >= 0 and not (an and bn):
                return [], []
            nodes = [*an, *bn]
            labels = links(list(asets), None if key[2] < 0 else list(bsets), similar)
            moved = np.flatnonzero(labels != np.arange(len(labels))).tolist()
            return [nodes[k] for k in moved], [nodes[int(labels[k])] for k in moved]

        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("root", "lo", "hi")), strict=True))
            sides, nodes, texts = batch.column("side").to_pylist(), batch.column("node").to_pylist(), bytes_list(batch.column("text"))
            for base in range(0, len(texts), PART_DOCS):
                h, n = shingle_sets(texts[base : base + PART_DOCS])
                for k, s in enumerate(np.split(h, np.cumsum(n)[:-1])):
                    at = base + k
                    if keys[at] != key:
                        if key is not None:
                            for o, e in zip(out, edges(), strict=True):
                                o.extend(e)
                        key, held = keys[at], ([], [])
                    held[sides[at]].append((nodes[at], s))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])
        if key is not None and (last := edges())[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in last], names=["a", "b"])

    return cells.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(run, "a long, b long")


def _parts(members: DataFrame, name: str, part_sets: int) -> DataFrame:
    """(root, <name>): into how many parts the members of each cluster are cut."""
    wide = F.greatest(F.ceil(F.count(F.lit(1)) / part_sets), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int")
    return members.groupBy("root").agg(wide.alias(name))


def _part(parts: str) -> F.Column:
    return F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")


def set_links(docs: DataFrame, sketched: DataFrame, similar: tuple[int, int] = SIMILAR, part_sets: int = PART_SETS) -> DataFrame:
    """Edges (a, b) between set ids that span every class of linked sets.

    A cluster of up to ``part_sets`` sets is one cell. A larger one is cut into parts by hash: first
    each part is compared within itself and with the cluster's pivot, its set of the greatest weight,
    which in a large group of near copies links most of them at once. What is not in the
    pivot's class then is compared with every part. A pair left out has both sets in the pivot's class,
    so no class is missed, and a group around one text costs no square of its size.
    """
    root, weight = clusters(sketched)
    sizes = sketched.filter("n_shingles > 0").groupBy("node").agg(F.max("n_shingles").alias("n"))
    members = materialize(root.join(sizes, "node").join(weight, "node"))
    if members.limit(1).count() == 0:
        return members.select(F.col("node").alias("a"), F.col("node").alias("b"))
    cut = members.join(_parts(members, "parts", part_sets), "root")
    cut = materialize(cut.withColumn("part", _part("parts")))
    texts = materialize(member_texts(docs, cut.select("node")).join(cut, "node"))
    own = texts.select("root", F.col("part").alias("lo"), F.lit(-1).alias("hi"), F.lit(0).alias("side"), "node", "text")
    large = cut.filter("parts > 1").groupBy("root", "parts").agg(F.max(F.struct("weight", "node")).alias("top")).select("root", "parts", F.col("top.node").alias("pivot"))
    led = texts.join(large.select(F.col("pivot").alias("node"), "root"), ["node", "root"], "left_semi")
    led = led.withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("lo <> part")
    led = led.select("root", "lo", F.lit(-1).alias("hi"), F.lit(0).alias("side"), "node", "text")
    edges = materialize(cell_edges(own.unionByName(led), similar))
    if large.limit(1).count() == 0:
        return edges
    classes = components(edges)
    where = cut.filter("parts > 1").join(classes.withColumnRenamed("root", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    main = where.join(large.select("root", F.col("pivot").alias("node")), ["root", "node"], "left_semi").select("root", F.col("class").alias("main"))
    rest = materialize(where.join(main, "root").filter("class <> main").select("root", "node", "n"))
    rest_parts = materialize(_parts(rest, "rest_parts", part_sets))
    rest = rest.join(rest_parts, "root").withColumn("rest_part", _part("rest_parts")).select("root", "node", "rest_part")
    a = texts.join(rest, ["root", "node"]).withColumn("hi", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a = a.select("root", F.col("rest_part").alias("lo"), "hi", F.lit(0).alias("side"), "node", "text")
    b = texts.join(rest_parts, "root").withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("rest_parts") - 1)))
    b = b.select("root", "lo", F.col("part").alias("hi"), F.lit(1).alias("side"), "node", "text")
    return edges.unionByName(materialize(cell_edges(a.unionByName(b), similar)))


def minhash_dedup(
    docs: DataFrame, similar: tuple[int, int] = SIMILAR, id_col: str = "doc_id", text_col: str = "text", part_sets: int = PART_SETS,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A text's set is its distinct 3-word shingles after folding A-Z (fewer words: the whole sequence);
    sets are linked when intersection / union >= 0.85, confirmed on full sets, and component_id is the
    smallest doc_id reachable over links. Sets are compared by 64-bit hashes of their shingles. Defined
    cases: a null text, an empty one and one without words have an empty set and are linked with
    nothing (component_id = doc_id); a very long text is read whole; rows with a null id take part
    and get the smallest id of their component (null if it has none); repeated rows give repeated
    rows, all of the smallest id kept; an empty table gives no rows; extra columns are not read.
    """
    d = narrow(docs, doc_id=id_col, text=text_col)
    sketched = materialize(sketches(d))
    classes = components(set_links(d, sketched, similar, part_sets))
    first = sketched.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = first.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("node", "root").join(whole, "root").select("node", "component_id")
    linked = sketched.filter("n_shingles > 0").join(named, "node").select("doc_id", "n_shingles", "component_id")
    alone = sketched.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
