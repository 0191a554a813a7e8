"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreflow.llm.text import FOLD, LETTER_WORDS, bytes_list, map_arrow, materialize, mix64, narrow, word_hashes

SHINGLE = 5
CONTAINMENT = 0.8
FUNCTIONS = 64  # MinHash functions, one band each
BITMAP_BITS = 23  # the filter of item signatures has 2 ** BITMAP_BITS bits, whatever the number of items
PART_DOCS = 200  # documents hashed at once
_SPACE = np.array([b == 0x20 for b in LETTER_WORDS])
_MULT = mix64(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEP = mix64(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all word shingles in text order, number of shingles of each text).

    Fewer words than ``size`` make one shingle of the whole sequence; no words make none.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts, _, words = word_hashes(b" ".join(texts).translate(FOLD), _SPACE)
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    n = np.bincount(owner, minlength=len(texts))
    left = np.repeat(np.cumsum(n), n) - np.arange(len(words))  # words from here to the text's end
    total = np.zeros(len(words), np.uint64)
    for k in range(size):
        term = words[k:] * _STEP[k]
        term[left[: len(term)] <= k] = 0
        total[: len(term)] += term
    short = np.repeat(n, n) < size
    keep = (left >= size) | (short & (left == np.repeat(n, n)))
    return mix64(total[keep] + np.minimum(left[keep], size).astype(np.uint64)), np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))


def size_class(n: int) -> int:
    """Smallest power of two that is at least ``n``."""
    return 1 << max(0, n - 1).bit_length()


def _key(values: np.ndarray, function: int, cls: int) -> np.ndarray:
    return mix64(values ^ np.uint64(function * 64 + cls.bit_length()))


def item_signatures(items: DataFrame) -> DataFrame:
    """(item_id, cls, key): the MinHash keys of each item, in the class of its shingle count."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, counts = shingle_hashes(bytes_list(batch.column("text")))
        ids, cls, keys = [], [], []
        for item, h in zip(batch.column("item_id").to_pylist(), np.split(hashes, np.cumsum(counts)[:-1]), strict=True):
            if len(h):
                h = np.unique(h)
                c = size_class(len(h))
                keys.extend(int(_key((h * _MULT[j]).min(keepdims=True), j, c).view(np.int64)[0]) for j in range(FUNCTIONS))
                ids.extend([item] * FUNCTIONS)
                cls.extend([c] * FUNCTIONS)
        return pa.RecordBatch.from_arrays([pa.array(ids, batch.column("item_id").type), pa.array(cls, pa.int64()), pa.array(keys, pa.int64())], names=["item_id", "cls", "key"])

    return map_arrow(items, run, f"item_id {items.schema['item_id'].dataType.simpleString()}, cls long, key long")


def key_bitmap(signatures: DataFrame) -> np.ndarray:
    """Bitmap of the keys' highest bits; at most 2 ** (BITMAP_BITS - 6) words reach the driver."""
    place = F.shiftrightunsigned("key", 64 - BITMAP_BITS)
    words = signatures.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - BITMAP_BITS}) & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for r in words.collect():
        out[r.w] = r.bits
    return out.view(np.uint64)


def window_keys(texts: list[bytes], classes: list[int], bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, key) of MinHash values of all windows that the bitmap of items lets through.

    For class c a text is cut into blocks of c shingles and a window is a block with the next one
    of its text: an item of up to c shingles lies within one window, so the window's resemblance to
    an item contained to 0.8 is at least 0.19 and one of 64 functions agrees with probability 0.999999.
    """
    hashes, counts = shingle_hashes(texts)
    owners, found = [], []
    if not len(hashes) or not classes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    levels = []  # (class, block starts in the level below, owner of each block, last block of its text)
    below, width = counts, 1
    for c in classes:
        step = c // width
        blocks = -(-below // step)
        owner = np.repeat(np.arange(len(texts)), blocks)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(below) - below, blocks) + inside * step
        levels.append((c, start, owner, inside == np.repeat(blocks, blocks) - 1))
        below, width = blocks, c
    for j in range(FUNCTIONS):
        mins = hashes * _MULT[j]
        for c, start, owner, last in levels:
            mins = np.minimum.reduceat(mins, start)
            after = np.append(mins[1:], mins[-1:])
            key = _key(np.where(last, mins, np.minimum(mins, after)), j, c)
            place = key >> np.uint64(64 - BITMAP_BITS)
            hit = np.flatnonzero((bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))
            owners.append(owner[hit])
            found.append(key[hit])
    pairs = np.unique(np.stack([np.concatenate(owners), np.concatenate(found).view(np.int64)]), axis=1)
    return pairs[0], pairs[1]


def candidates(docs: DataFrame, signatures: DataFrame, classes: list[int], bitmap: np.ndarray) -> DataFrame:
    """Distinct (doc_id, item_id) that share a MinHash key in a window of the item's class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PART_DOCS):
                part = batch.slice(k, PART_DOCS)
                at, key = window_keys(bytes_list(part.column("text")), classes, bitmap)
                if len(at):
                    yield pa.record_batch([part.column("doc_id").take(pa.array(at)), pa.array(key)], names=["doc_id", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, key long").join(signatures.select("key", "item_id"), "key").select("doc_id", "item_id").distinct()


def contained(text: bytes, item: bytes, size: int = SHINGLE) -> tuple[int, int]:
    """(distinct shingles of the item, how many of them are shingles of the text), exactly."""
    words, own = text.translate(LETTER_WORDS).split(), item.translate(LETTER_WORDS).split()
    if len(own) < size:
        return (1, int(words == own)) if own else (0, 0)
    line = b" " + b" ".join(words) + b" "
    shingles = {b" ".join(own[k : k + size]) for k in range(len(own) - size + 1)}
    return len(shingles), sum(b" " + s + b" " in line for s in shingles)


def verify(docs: DataFrame, items: DataFrame, pairs: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """Exact containment of candidate pairs: (doc_id, item_id, n_shingles, n_found, containment)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = [], []
            for text, item in zip(bytes_list(batch.column("text")), bytes_list(batch.column("item")), strict=True):
                a, b = contained(text, item)
                n.append(a)
                found.append(b)
            yield pa.record_batch([batch.column("doc_id"), batch.column("item_id"), pa.array(n, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "item_id", "n_shingles", "n_found"])

    both = docs.join(pairs.join(items.withColumnRenamed("text", "item"), "item_id"), "doc_id").select("doc_id", "item_id", "text", "item")
    kinds = [f"{c} {both.schema[c].dataType.simpleString()}" for c in ("doc_id", "item_id")]
    checked = both.mapInArrow(run, f"{', '.join(kinds)}, n_shingles long, n_found long")
    share = F.col("n_found") / F.col("n_shingles")
    return checked.filter(share >= threshold).withColumn("containment", share).distinct()


def contamination(
    docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Every (doc_id, item_id) where the document contains ``threshold`` of the item's word shingles.

    Words are runs of digits, letters and non-ASCII characters, A-Z folded. Items are partitioned
    by shingle count; for each class documents are searched in windows of matching size, so short
    items are found in documents of any length. Candidates are verified by exact shingle
    containment over the whole document. Defined cases: null and empty texts on either side give
    no pair; an item of fewer than five words needs a document of exactly its words; null ids on
    either side give no pair; repeated rows give a pair once; empty tables give no rows.
    """
    d = narrow(docs, doc_id=id_col, text=text_col).filter("doc_id is not null")
    i = narrow(items, item_id=item_id_col, text=item_text_col).filter("item_id is not null")
    signatures = materialize(item_signatures(i))
    classes = sorted(r.cls for r in signatures.select("cls").distinct().collect())  # powers of two: 64 at most
    bitmap = key_bitmap(signatures)
    pairs = materialize(candidates(d, signatures, classes, bitmap))
    return verify(d, i, pairs, threshold)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
