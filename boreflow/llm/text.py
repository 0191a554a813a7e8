"""Byte-level text helpers shared by the operators. Texts are handled as UTF-8 bytes inside tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boreflow.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
# Bytes outside words of letters, digits and all non-ASCII characters become spaces; A-Z are folded.
_WORDISH = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
LETTER_WORDS = bytes(FOLD[b] for b in _WORDISH)


def fold_az(c: Column) -> Column:
    """Lower-case A-Z only (``lower`` would fold other alphabets as well)."""
    return F.translate(c, UPPER, UPPER.lower())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so extra columns never clash."""
    return df.select(*[df[c].alias(name) for name, c in cols.items()])


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame once as Parquet into the cluster's shared checkpoint folder and read it back.

    Cuts the lineage like a checkpoint: after a lost executor the rows are read again, not computed.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_list(column: pa.Array) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes; null is the empty text."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch; batches it turns into None are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64; kept per worker and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(10, (n - 1).bit_length()), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _POWERS[base] = have
    return have[:n]


def word_hashes(data: bytes, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of ``data``; ``space[b]`` marks separator bytes.

    The hash of a word is a polynomial over its bytes, taken from one running sum over the buffer
    and then scrambled; equal words have equal hashes wherever they stand.
    """
    raw = np.frombuffer(data, np.uint8)
    word = ~space[raw]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    # Only the offset inside a word is used as exponent, so equal words sum to equal values.
    first = np.concatenate([[0], starts])
    inside = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    longest = int((ends - starts).max())
    p = powers(_BASE, longest + 1)
    terms = (raw.astype(np.uint64) + np.uint64(1)) * p[np.minimum(inside, longest)]
    terms[~word] = 0
    sums = np.add.reduceat(terms, starts)
    return starts, ends, mix64(sums + (ends - starts).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
