"""Token-id output: documents compressed one by one with a shared zstandard dictionary.

Shard file: MAGIC, one byte id width (2 or 4), 32 bytes SHA-256 of the dictionary, the frames, the
index (offset, token count and id of each document, in order), then a footer (index offset,
document count, MAGIC). A reader seeks to one document through the index and decompresses it alone.
"""

from __future__ import annotations

import functools
import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boreflow.llm.text import bytes_list, materialize, narrow, shuffle_partitions
from boreflow.session import ensure_checkpoint_dir

MAGIC = b"BFTOKEN1"
HEAD = struct.Struct("<8sB32s")
FOOT = struct.Struct("<QQ8s")
INDEX = np.dtype([("offset", "<u8"), ("n_tokens", "<u4"), ("has_id", "u1"), ("doc_id", "<i8")])
END_ID = 2
LEVEL = 3
DICT_BYTES = 65_536
DICT_DOCS = 1_000  # documents the dictionary is trained on
DICT_DOC_BYTES = 65_536  # of a longer text a slice within this size is taken
CACHE_PIECES = 300_000  # distinct pieces with known ids that a worker keeps
BLOCK = 500  # pieces joined for one call of the library
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# Letters that are composed already, digits and ASCII marks but "'" and "<" (contractions, special tokens).
PLAIN = f"^[{_LETTERS}!-&(-;=-~]+$"
PIECE = f"([{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+)"


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _ranges(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[begin[c] : begin[c] + size[c]]`` for every c of ``code`` put together, and their ends."""
    n = size[code]
    ends = np.cumsum(n)
    return flat[np.repeat(begin[code] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


class Encoder:
    """Encodes texts by their distinct pieces; equal to encoding each text whole.

    This holds for tokenizers whose pre-tokens never reach over white space, are runs of letters, single
    digits or runs of marks, are folded to lower case and close with a word end (word_bpe_49k does all
    four). Texts are cut at white space; distinct plain chunks are cut further into such pre-tokens,
    which go through the model in joined blocks and are told apart by their word ends. Any other chunk
    goes through the whole tokenizer. The ids are put together by index.
    """

    def __init__(self, path: str):
        self.tok = _tokenizer(path)
        self.width = np.dtype("<u2" if self.tok.get_vocab_size() < 65_536 else "<u4")
        self.words = self._words_only(self.tok)
        self.closes = np.zeros(self.tok.get_vocab_size(), bool)
        self.closes[[i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self._forget()

    @staticmethod
    def _words_only(tok):
        """The same model over words parted by spaces, without normalizing them."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        words = Tokenizer(tok.model)
        words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        return words

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat = np.zeros(0, self.width)
        self.size = np.zeros(0, np.int64)

    def _learn(self, new: pa.Array) -> None:
        """Add the ids of distinct pieces, plain ones first."""
        plain = pc.match_substring_regex(new, PLAIN)
        words, rest = new.filter(plain), new.filter(pc.invert(plain))
        listed = words.to_pylist()
        blocks = [" ".join(listed[k : k + BLOCK]) for k in range(0, len(listed), BLOCK)]
        parts = [np.array(e.ids, self.width) for e in self.words.encode_batch_fast(blocks, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, self.width), *parts])
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer's words do not close with a word end")
        parts = [np.array(e.ids, self.width) for e in self.tok.encode_batch_fast(rest.to_pylist(), add_special_tokens=False)]
        self.known = pa.concat_arrays([self.known, words, rest])
        self.flat = np.concatenate([self.flat, flat, *parts])
        self.size = np.concatenate([self.size, np.diff(ends, prepend=0), np.fromiter(map(len, parts), np.int64, len(parts))])

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all distinct chunks, their number for each)."""
        plain = pc.match_substring_regex(chunks, PLAIN)
        mixed = pc.and_(plain, pc.invert(pc.match_substring_regex(chunks, f"^[{_LETTERS}]+$")))
        low = pc.if_else(plain, pc.utf8_lower(chunks), chunks)
        cut = pc.ascii_rtrim_whitespace(pc.replace_substring_regex(low.filter(mixed), PIECE, r"\1 "))
        split = pc.ascii_split_whitespace(pc.replace_with_mask(low, mixed, cut))
        coded = split.flatten().dictionary_encode()
        if len(self.known) > CACHE_PIECES:
            self._forget()
        new = coded.dictionary.filter(pc.is_null(pc.index_in(coded.dictionary, self.known)))
        if len(new):
            self._learn(new)
        code = pc.index_in(coded.dictionary, self.known).to_numpy()[coded.indices.to_numpy()]
        ids, ends = _ranges(self.flat, np.cumsum(self.size) - self.size, self.size, code)
        return ids, np.diff(np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, documents' bounds in them); every document is closed by END_ID."""
        column = pa.array(texts, pa.binary()).cast(pa.large_string())
        column = pc.replace_substring_regex(column, f"([0-9{_LETTERS}])([.,]+[ \n])", r"\1 \2")
        split = pc.ascii_split_whitespace(column)
        coded = split.flatten().dictionary_encode()
        flat, sizes = self._chunk_ids(coded.dictionary)
        ids, ends = _ranges(flat, np.cumsum(sizes) - sizes, sizes, coded.indices.to_numpy())
        cuts = split.offsets.to_numpy() - split.offsets[0].as_py()
        at = np.concatenate([[0], ends])[cuts]  # document bounds before the end ids
        out = np.insert(ids, at[1:], END_ID)
        return out, at + np.arange(len(at))


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


def train_dictionary(docs: DataFrame, tokenizer_path: str) -> bytes:
    """A dictionary over the serialized ids of up to DICT_DOCS documents (smallest id hashes).

    A text of more than DICT_DOC_BYTES gives a slice of a quarter as many characters, from a place
    drawn by the id's hash, so what the driver holds is bounded whatever the texts' length. Samples too small to train on become a raw-content dictionary; no sample gives an empty one.
    """
    n = DICT_DOC_BYTES // 4  # a character has 4 bytes at most
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - n + 1)).cast("int") + 1
    whole = F.octet_length(F.coalesce("text", F.lit(""))) <= DICT_DOC_BYTES
    fit = docs.filter("doc_id is not null").select("doc_id", F.when(whole, F.col("text")).otherwise(F.substring(F.col("text"), place, F.lit(n))).alias("text"))
    chosen = fit.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(DICT_DOCS)
    ids = [r.doc_id for r in chosen.collect()]  # DICT_DOCS at most; only their texts follow
    rows = fit.filter(F.col("doc_id").isin(ids)).select("doc_id", "text").dropDuplicates().orderBy("doc_id", "text").limit(DICT_DOCS).collect()
    if not rows:
        return b""
    ids, cuts = encoder(tokenizer_path).encode([(r.text or "").encode() for r in rows])
    samples = [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def _zdict(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class ShardWriter:
    def __init__(self, sink, dictionary: bytes, width: int):
        self.sink, self.index, self.at = sink, [], HEAD.size
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_zdict(dictionary))
        sink.write(HEAD.pack(MAGIC, width, hashlib.sha256(dictionary).digest()))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.press.compress(ids.tobytes())
        self.index.append((self.at, len(ids), doc_id is not None, doc_id or 0))
        self.sink.write(frame)
        self.at += len(frame)

    def close(self) -> None:
        self.sink.write(np.array(self.index, INDEX).tobytes())
        self.sink.write(FOOT.pack(self.at, len(self.index), MAGIC))
        self.sink.close()


class ShardReader:
    """Random access to one shard file (a seekable file object)."""

    def __init__(self, source, size: int, dictionary: bytes):
        self.source = source
        magic, width, digest = HEAD.unpack(self._read(0, HEAD.size))
        self.end, n, tail = FOOT.unpack(self._read(size - FOOT.size, FOOT.size))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError("not a token shard, or cut short")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.width = np.dtype(f"<u{width}")
        self.index = np.frombuffer(self._read(self.end, n * INDEX.itemsize), INDEX)
        self.unpress = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def __len__(self) -> int:
        return len(self.index)

    def doc_id(self, k: int) -> int | None:
        return int(self.index["doc_id"][k]) if self.index["has_id"][k] else None

    def ids(self, k: int) -> np.ndarray:
        a = int(self.index["offset"][k])
        b = int(self.index["offset"][k + 1]) if k + 1 < len(self) else self.end
        raw = self.unpress.decompress(self._read(a, b - a), max_output_size=int(self.index["n_tokens"][k]) * self.width.itemsize)
        return np.frombuffer(raw, self.width)


def write_tokens(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, bytes]:
    """Write every document's ids in ascending id order (null ids first); returns (manifest, dictionary).

    Documents are dealt by ranges of doc_id and each task writes one shard, so shards in manifest
    order hold ascending ids. A shard's name is new for every attempt and the manifest, written to
    the shared folder, names the shards of successful attempts only: a lost executor's task is run
    again into another file. ``folder`` defaults to a new one in the cluster's shared folder.
    """
    spark = docs.sparkSession
    d = narrow(docs, doc_id=id_col, text=text_col)
    folder = folder or f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    dictionary = train_dictionary(d, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        enc, writer, tokens = encoder(tokenizer_path), None, 0
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        for batch in batches:
            if writer is None and batch.num_rows:
                writer = ShardWriter(store.open_output_stream(f"{root}/{name}"), dictionary, enc.width.itemsize)
            for k in range(0, batch.num_rows, 1_000):
                part = batch.slice(k, 1_000)
                ids, cuts = enc.encode(bytes_list(part.column("text")))
                tokens += len(ids)
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), cuts, cuts[1:], strict=False):
                    writer.add(doc_id, ids[a:b])
        if writer is not None:
            writer.close()
            size = store.get_file_info(f"{root}/{name}").size
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "bytes": [size], "n_docs": [len(writer.index)], "n_tokens": [tokens]})

    ordered = d.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    manifest = materialize(ordered.mapInArrow(run, "shard long, name string, bytes long, n_docs long, n_tokens long"))
    return manifest.withColumn("folder", F.lit(folder)), dictionary


def read_tokens(manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """One row per document read back from the shards: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it; the crc is over little-endian 32-bit ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                store, root = pafs.FileSystem.from_uri(s["folder"])
                with store.open_input_file(f"{root}/{s['name']}") as f:
                    r = ShardReader(f, s["bytes"], dictionary)
                    for k in range(0, len(r), 10_000):
                        rows = range(k, min(k + 10_000, len(r)))
                        n = r.index["n_tokens"][rows.start : rows.stop].astype(np.int64)
                        before = s["start"] + np.cumsum(n) - n
                        s["start"] += int(n.sum())
                        crc = [zlib.crc32(r.ids(i).astype("<u4").tobytes()) for i in rows]
                        yield pa.record_batch(
                            [pa.array([r.doc_id(i) for i in rows], pa.int64()), pa.array(before), pa.array(n), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    # One manifest row per shard; the running total over shards is the only step in one task.
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    m = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    spread = m.repartition(shuffle_partitions(manifest.sparkSession), "name")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write the shards and return what is read back from them, one row per document.

    Defined cases: null and empty texts have just the end id; repeated ids each keep a frame, next
    to one another; null ids come first; an empty table writes no shard and gives no rows; extra
    columns are not read; texts of any length are encoded whole.
    """
    return read_tokens(*write_tokens(docs, tokenizer_path, folder, id_col, text_col))
