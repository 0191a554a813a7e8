"""Filter interaction audit: survival words of documents and their positional popcounts.

With five filters there are 32 subsets of filters. A document survives a subset if it fails none of
the subset's filters, so what happens to it under every order of filters is one 32-bit word with a
bit for each subset it survives. Adding up the words bit by bit gives the survivors of every subset,
and every figure of the audit is a difference of two such counts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.llm.text import bytes_list, map_arrow, materialize, narrow

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
ALL = SUBSETS - 1
MIN_WORDS = 50
MIN_DISTINCT = 65  # percent of the words
MAX_UPPER = 5  # percent of the code points
SYMBOLS = b"#$%&*|"
_UPPER = bytes(range(0x41, 0x5B))


def survival_word(failed: int) -> int:
    """Bit S is set if a document that fails exactly the filters in ``failed`` survives subset S."""
    return sum(1 << s for s in range(SUBSETS) if not s & failed)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set, by carry-save adders.

    Sixteen blocks of the words go through a tree of full adders that act on all 32 positions at
    once: the planes ``ones`` to ``eights`` hold the low bits of the counts, and only the carry out of
    the eights has its bits unpacked. The planes that are left are unpacked in the end.
    """
    counts = np.zeros(32, np.int64)

    def unpack(plane: np.ndarray, weight: int) -> None:
        counts[:] += weight * np.unpackbits(plane.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

    def add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = a ^ b
        return u ^ c, (a & b) | (u & c)

    words = np.ascontiguousarray(words, dtype="<u4")
    width = 64  # lanes of a plane
    step = 16 * width
    whole = len(words) // step * step
    planes = [np.zeros(width, "<u4") for _ in range(4)]  # ones, twos, fours, eights
    for block in words[:whole].reshape(-1, 16, width):
        carried = list(block)
        for k in range(4):
            out = []
            for a, b in zip(carried[::2], carried[1::2], strict=True):
                planes[k], c = add(planes[k], a, b)
                out.append(c)
            carried = out
        unpack(carried[0], 16)
    for k, plane in enumerate(planes):
        unpack(plane, 1 << k)
    unpack(words[whole:].copy(), 1)
    return counts


def own_failures(texts: list[bytes], code_points: np.ndarray) -> np.ndarray:
    """Bits A to D of the filters that each text fails."""
    out = np.zeros(len(texts), np.int32)
    for k, t in enumerate(texts):
        words = t.split()
        n = len(words)
        upper = len(t) - len(t.translate(None, _UPPER))
        out[k] = (
            (n < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * n) << 1 | (100 * upper > MAX_UPPER * int(code_points[k])) << 2
            | (len(t.translate(None, SYMBOLS)) != len(t)) << 3
        )
    return out


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, part, failed (bit k: fails filter k of FILTERS).

    Texts are read once; only ids, parts and digests are shuffled, to find the smallest id of each
    text. A text with very many copies is aggregated before its digest is sent, and the join back
    is split by the skew join.
    """
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    d = narrow(docs, doc_id=id_col, text=text_col, part=part_col)
    d = d.select("doc_id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), "text", F.unhex(digest).alias("digest"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column("text")
        points = pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False)
        own = pa.array(own_failures(bytes_list(text), points))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("digest"), own], names=["doc_id", "part", "digest", "own"])

    judged = materialize(map_arrow(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, part string, digest binary, own int"))
    firsts = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return judged.join(firsts, "digest", "left").select("doc_id", "part", F.col("own").bitwiseOR(copy * 16).alias("failed"))


def survivors(failed: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(part, kept, good, toxic): arrays of the survivors of each of the 32 subsets, per part.

    Each task turns its documents into survival words and adds them up by part and label; one row
    per part and task is shuffled. A document is good (toxic) if any row of ``labels`` with its id
    has quality (toxic) 1.
    """
    flags = ["good", "toxic"]
    if labels is None:
        marked = failed.withColumns({f: F.lit(False) for f in flags})
    else:
        known = labels.groupBy(F.col(id_col).alias("doc_id")).agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic")).filter("doc_id is not null and (good = 1 or toxic = 1)")
        marked = failed.join(known, "doc_id", "left").withColumns({f: F.coalesce(F.col(f) == 1, F.lit(False)) for f in flags})
    table = np.array([survival_word(m) for m in range(SUBSETS)], np.uint32)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = table[batch.column("failed").to_numpy()]
        labelled = [np.ones(len(words), bool), *(batch.column(f).to_numpy(zero_copy_only=False) for f in flags)]
        parts = batch.column("part").dictionary_encode()
        code = parts.indices.to_numpy()
        by_part = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[by_part], np.arange(len(parts.dictionary) + 1))
        sums = [[positional_popcount(words[rows[m[rows]]]) for m in labelled] for rows in (by_part[a:b] for a, b in zip(cuts, cuts[1:], strict=False))]
        cells = pa.array(np.array(sums, np.int64).reshape(-1))
        offsets = pa.array(np.arange(0, len(cells) + 1, 3 * SUBSETS, dtype=np.int32))
        return pa.RecordBatch.from_arrays([parts.dictionary, pa.ListArray.from_arrays(offsets, cells)], names=["part", "counts"])

    partial = map_arrow(marked.select("part", "failed", *flags), run, "part string, counts array<long>")
    added = partial.groupBy("part").agg(*[F.sum(F.col("counts")[k]).alias(f"c{k}") for k in range(3 * SUBSETS)])
    return added.select("part", *[F.array(*[f"c{k}" for k in range(j * SUBSETS, (j + 1) * SUBSETS)]).alias(name) for j, name in enumerate(["kept", *flags])])


def steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, filter, subset of the filters before it) of every order's steps."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            out.append(("".join(FILTERS[i] for i in order), k + 1, f, before))
            before |= 1 << f
    return out


def interaction_audit(
    docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
) -> DataFrame:
    """One row per part, filter order and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley, all document counts.

    A: fewer than 50 words; B: under 65 % of the words distinct; C: over 5 % of the code points are
    A-Z; D: holds one of ``#$%&*|``; E: the same text stands under a smaller id anywhere in the
    table. ``shapley`` is what the step's filter removes, summed over all orders. Defined cases: a
    null text is the empty text (it fails A); a null part is the part of the empty string; a null
    id is neither smaller nor larger than another and has no label; rows with the same id and
    text are both kept by E; copies of very long texts compare by digest; an empty table gives no
    rows; extra columns are not read.
    """
    counts = survivors(failures(docs, id_col, text_col, part_col), labels, id_col)
    plan = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(f).alias("f"), F.lit(s).alias("s")) for o, k, f, s in steps()])

    def value(f: int) -> Column:
        """Removed by filter f, summed over all orders: |S|! (4 - |S|)! orders have it right behind the set S."""
        rest = len(FILTERS) - 1
        sets = [s for s in range(SUBSETS) if not s >> f & 1]
        terms = [(F.col("kept")[s] - F.col("kept")[s | 1 << f]) * (factorial(s.bit_count()) * factorial(rest - s.bit_count())) for s in sets]
        return sum(terms[1:], terms[0])

    worth = counts.withColumn("worth", F.array(*[value(f) for f in range(len(FILTERS))]))
    each = worth.select("*", F.explode(plan).alias("p")).select("*", "p.*").withColumn("bit", F.expr("shiftleft(1, f)"))
    after = F.col("s").bitwiseOR(F.col("bit"))
    removed = F.col("kept")[F.col("s")] - F.col("kept")[after]
    others = F.lit(ALL).bitwiseXOR(F.col("bit"))
    return each.select(
        "part", "filter_order", "step", F.col("kept")[after].alias("kept"), removed.alias("removed"),
        (F.col("kept")[0] - F.col("kept")[F.col("bit")] - removed).alias("redundant"),
        (F.col("kept")[others] - F.col("kept")[ALL]).alias("unique_fails"),
        *[(F.col(f)[F.col("s")] - F.col(f)[after]).alias(f"{f}_lost") for f in ("good", "toxic")],
        F.col("worth")[F.col("f")].alias("shapley"))
