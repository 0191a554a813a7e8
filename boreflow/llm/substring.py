"""Substring dedup: compressed FM-indexes per shard, searched backward over wavelet matrices.

A shard holds all text around one set of minimizers: every window of 13 words belongs to the shard
of the smallest hash among its word 6-grams, so equal windows meet in one shard whichever
documents they stand in, and the work grows with the text, not with pairs of shards. Where the
segments of one minimizer exceed a shard, each of their windows goes to the shard of its own hash.
"""

from __future__ import annotations

import copy
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreflow.llm.text import SPACE, bytes_list, mix64, narrow, word_hashes

WINDOW = 13
GRAM = 6
BATCH_BYTES = 6_000_000  # text per batch of documents; batches send each distinct segment once
SHARD_BYTES = 6_000_000  # text of the corpus per shard
PART_DOCS = 100  # documents hashed at once
SEARCH = 65_536  # windows searched at once
_STEP = mix64(np.arange(301, 301 + GRAM, dtype=np.uint64)) | np.uint64(1)
_NONE = np.iinfo(np.int64).max
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# ---- segments of documents -------------------------------------------------------------------


class Segments:
    """Runs of consecutive windows of a text with the same minimizer, in text order.

    ``doc`` (index of the text), ``word`` (its word where the first window starts), ``n`` (windows),
    ``route`` (the minimizer) and ``cut`` (a single window of a split route, see ``split``); ``texts``
    cuts out their words, joined by one space.
    """

    def __init__(self, texts: list[bytes], window: int = WINDOW):
        cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(7)]
        self.window = window
        self.data: list[bytes] = []
        self.part_sizes: list[int] = []
        for base in range(0, len(texts), PART_DOCS):
            found = self._part(texts[base : base + PART_DOCS], window)
            if found is not None:
                doc, word, n, route, begin, end, sums = found
                for c, v in zip(cols, (doc + base, word, n, route.view(np.int64), begin, end, sums.view(np.int64)), strict=True):
                    c.append(v)
                self.part_sizes.append(len(doc))
        self.doc, self.word, self.n, route, self.begin, self.end, sums = map(np.concatenate, cols)
        self.route, self.sums = route.view(np.uint64), sums.view(np.uint64)
        self.part = np.repeat(np.arange(len(self.data)), self.part_sizes)
        self.cut = np.zeros(len(self.n), bool)

    def _part(self, part: list[bytes], window: int) -> tuple[np.ndarray, ...] | None:
        sizes = np.fromiter(map(len, part), np.int64, len(part)) + 1
        data = b" ".join(part)
        starts, ends, words = word_hashes(data, SPACE)
        if len(words) < window:
            return None
        owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
        n_gram = min(GRAM, window)
        gram = np.zeros(len(words) - n_gram + 1, np.uint64)
        for k in range(n_gram):
            gram += words[k : k + len(gram)] * _STEP[k]
        gram = mix64(gram)
        least = gram[: len(words) - window + 1].copy()
        for k in range(1, window - n_gram + 1):
            np.minimum(least, gram[k : k + len(least)], out=least)
        whole = np.flatnonzero(owner[: len(least)] == owner[window - 1 :])
        if not len(whole):
            return None
        least, own = least[whole], owner[whole]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(least) != 0) | (np.diff(own) != 0) | (np.diff(whole) != 1)]))
        n = np.diff(np.append(first, len(whole)))
        at = whole[first]
        n_words = np.bincount(owner, minlength=len(part))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(gram, dtype=np.uint64)])
        sums = total[at + n + window - n_gram] - total[at]
        self.data.append(data)
        return own[first], at - (np.cumsum(n_words) - n_words)[own[first]], n, least[first], starts[at], ends[at + n + window - 2], sums

    def texts(self, rows: np.ndarray) -> list[bytes]:
        places = zip(self.part[rows].tolist(), self.begin[rows].tolist(), self.end[rows].tolist(), strict=True)
        return [b" ".join(self.data[p][a:b].split()) for p, a, b in places]

    def places(self) -> np.ndarray:
        """The number of each segment's first window among all windows; ``split`` does not change them."""
        return np.cumsum(self.n) - self.n

    def sizes(self, routes: np.ndarray) -> np.ndarray:
        """Bytes of the distinct segments of each of the sorted ``routes``, told apart by sums of gram hashes."""
        _, one = np.unique(self.route ^ mix64(self.sums), return_index=True)
        size = np.bincount(np.searchsorted(routes, self.route[one]), self.end[one] - self.begin[one], len(routes))
        return size.astype(np.int64)

    def split(self, routes: np.ndarray) -> Segments:
        """Segments of ``routes`` cut into their single windows, whose route is a hash of their text."""
        split = np.isin(self.route, routes)
        if not split.any():
            return self
        count = np.where(split, self.n, 1)
        back = np.repeat(np.arange(len(count)), count)
        out = copy.copy(self)
        out.doc, out.part, out.route, out.begin, out.end, out.cut = (c[back] for c in (self.doc, self.part, self.route, self.begin, self.end, split))
        out.word = self.word[back] + np.arange(len(back)) - np.repeat(np.cumsum(count) - count, count)
        out.n = np.where(out.cut, 1, self.n[back])
        begin, end = [], []
        for r in np.flatnonzero(split).tolist():
            words = [m.span() for m in _WORD.finditer(self.data[self.part[r]], self.begin[r], self.end[r])]
            begin += [a for a, _ in words[: len(words) - self.window + 1]]
            end += [b for _, b in words[self.window - 1 :]]
        rows = np.flatnonzero(out.cut)
        out.begin[rows], out.end[rows] = begin, end
        out.route[rows] = np.array([xxhash.xxh64_intdigest(t) for t in out.texts(rows)], np.uint64)
        return out

    def copies(self, rows: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The first of ``rows`` with the same text as each of them, and the texts of those firsts."""
        first: dict[bytes, int] = {}
        canon = np.fromiter((first.setdefault(t, r) for t, r in zip(self.texts(rows), rows.tolist(), strict=True)), np.int64, len(rows))
        return canon, list(first)


def bounds(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with their smallest and largest id."""
    distinct, back = np.unique(keys, return_inverse=True)
    low, high = np.full(len(distinct), _NONE), np.full(len(distinct), -_NONE - 1)
    np.minimum.at(low, back, ids)
    np.maximum.at(high, back, ids)
    return distinct, low, high


def pack(arrays: list[np.ndarray], texts: list[bytes]) -> bytes:
    """Integer arrays (byte planes apart, so that leading zeros cost nothing) and texts, compressed."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    parts = [a.astype(np.int64) for a in (*arrays, sizes)]
    head = np.array([len(parts), *map(len, parts)], np.int64)
    planes = (p.view(np.uint8).reshape(-1, 8).T.tobytes() for p in parts)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), *planes, *texts]))


def unpack(blob: bytes) -> tuple[list[np.ndarray], list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    lengths = np.frombuffer(raw, np.int64, k, 8)
    at, arrays = 8 * (k + 1), []
    for n in lengths.tolist():
        planes = np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n)
        arrays.append(np.ascontiguousarray(planes.T).view(np.int64).reshape(-1))
        at += 8 * n
    ends = at + np.cumsum(arrays[-1])
    return arrays[:-1], [raw[e - n : e] for e, n in zip(ends.tolist(), arrays[-1].tolist(), strict=True)]


# ---- the index -------------------------------------------------------------------------------


class WaveletMatrix:
    """Rank over a sequence of small integers: one packed bit vector with block counts per bit."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.n, self.levels = len(values), []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            padded = np.zeros(-(-(self.n + 1) // 64) * 64, bool)
            padded[: self.n] = ones
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32)
            self.levels.append((bit, words, counts, self.n - int(ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

        # Where each symbol's own places begin below the last level.
        self.start = self._fall(np.arange(sigma), np.zeros(sigma, np.int64))

    def _fall(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for bit, words, counts, zeros in self.levels:
            block = place >> 6
            below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[block] + np.bitwise_count(words[block] & below)
            place = np.where(symbol >> bit & 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``place``, for arrays of both."""
        return self._fall(symbol, place) - self.start[symbol]


class FMIndex:
    """FM-index of a text of symbols for patterns of up to ``depth`` symbols (1 .. sigma - 1; 0 separates).

    Suffixes are sorted by their first symbols up to the next power of two above ``depth``, which
    fixes the order of all intervals such patterns have. Kept: the Burrows-Wheeler transform in a
    wavelet matrix, the symbols' counts and the smallest document id of each row.
    """

    def __init__(self, text: np.ndarray, ids: np.ndarray, sigma: int, depth: int):
        n = len(text)
        rank, step = text.astype(np.int64), 1
        while True:
            after = np.full(n, -1, np.int64)
            after[: n - step] = rank[step:]
            order = np.argsort(rank * (n + sigma + 1) + after + 1)
            a, b = rank[order], after[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum((np.diff(a) != 0) | (np.diff(b) != 0))])
            step *= 2
            if step >= depth:
                break
        self.wavelet = WaveletMatrix(text[order - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.ids = ids[order]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: intervals of ``symbol`` followed by what the intervals stand for."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.before[symbol] + both[: len(low)], self.before[symbol] + both[len(low) :]

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest id in each interval; equal-depth intervals are equal or disjoint."""
        starts, back = np.unique(low, return_inverse=True)
        ends = np.zeros(len(starts), np.int64)
        ends[back] = high
        cuts = np.stack([starts, ends], axis=1).reshape(-1)
        padded = np.append(self.ids, _NONE)
        return np.minimum.reduceat(padded, cuts)[::2][back] if len(low) else np.zeros(0, np.int64)


def statistics(index: FMIndex, text: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Matching statistics of the positions ``at``, up to ``window``: (length, smallest id of the match).

    The words of each window are read from its last to its first; a search ends where the interval
    runs empty, so its length falls short of the window.
    """
    length = np.zeros(len(at), np.int64)
    found = np.full(len(at), _NONE)
    for k in range(0, len(at), SEARCH):
        place = at[k : k + SEARCH]
        live = np.arange(len(place))
        symbol = text[place + window - 1]
        low, high = index.before[symbol], index.before[symbol + 1]
        for back in range(window - 2, -1, -1):
            some = high > low
            live, low, high = live[some], low[some], high[some]
            if not len(live):
                break
            length[k + live] = window - 1 - back
            low, high = index.extend(text[place[live] + back], low, high)
        some = high > low
        live, low, high = live[some], low[some], high[some]
        length[k + live] = window
        found[k + live] = index.smallest(low, high)
    return length, found


def _spans(values: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal values."""
    edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return list(zip(edges, edges[1:], strict=False)) if len(values) else []


def by_batch(batch: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """The columns' rows of each batch, packed."""
    order = np.argsort(batch, kind="stable")
    owner = batch[order]
    for a, b in _spans(owner):
        yield int(owner[a]), pack([c[order[a:b]] for c in columns], [])


def shared_routes(entries: list[tuple[np.ndarray, ...]], most_bytes: int) -> Iterator[tuple[int, bytes]]:
    """One shard's (batch, number, route, low, high, size): (number, split) of routes that two documents have.

    A route is split (1) if its segments of all batches have more than ``most_bytes``.
    """
    batch, number, route, low, high, size = (np.concatenate([e[k] for e in entries]) for k in range(6))
    _, group = np.unique(route, return_inverse=True)
    least, most = np.full(group.max() + 1, _NONE), np.full(group.max() + 1, -_NONE - 1)
    np.minimum.at(least, group, low)
    np.maximum.at(most, group, high)
    keep = (least < most)[group]
    split = (np.bincount(group, size) > most_bytes)[group]
    yield from by_batch(batch[keep], [number[keep], split[keep]])


def answer(entries: list[tuple], window: int = WINDOW) -> Iterator[tuple[int, bytes]]:
    """One shard: (batch, its packed answers) from its entries (batch, number, low, high, texts).

    The distinct texts are indexed, each with its smallest document, and streamed through the index;
    a window's answer is the smallest document that holds it. Answers are runs of windows (entry
    number, first window, windows, document), left out where no document of the batch is larger.
    """
    batch, number, low, high = (np.concatenate([e[k] for e in entries]) for k in range(4))
    unit_of: dict[bytes, int] = {}
    unit = np.fromiter((unit_of.setdefault(t, len(unit_of)) for e in entries for t in e[4]), np.int64, len(number))
    first = np.full(len(unit_of), _NONE)
    np.minimum.at(first, unit, low)
    units = list(unit_of)
    words = pa.array(b" ".join(units).split(b" "), pa.binary()).dictionary_encode()
    sizes = np.fromiter((u.count(b" ") + 1 for u in units), np.int64, len(units))
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    inside = np.arange(len(text)) - np.repeat(begin, sizes + 1) < np.repeat(sizes, sizes + 1)
    text[inside] = words.indices.to_numpy().astype(np.int64) + 1
    index = FMIndex(text, np.repeat(first, sizes + 1), len(words.dictionary) + 1, window)
    n = sizes - window + 1
    ends = np.cumsum(n)
    inner = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
    length, found = statistics(index, text, np.repeat(begin, n) + inner, window)
    found[length < window] = _NONE
    # Runs of windows with the same answer within a text.
    run = np.flatnonzero((inner == 0) | np.concatenate([[True], np.diff(found) != 0]))
    run_unit, run_n = np.searchsorted(ends, run, side="right"), np.diff(np.append(run, len(inner)))
    per_unit = np.bincount(run_unit, minlength=len(units))
    offset = np.cumsum(per_unit) - per_unit
    # Each entry gets the runs of its text, as far as they can matter to its largest document.
    count = per_unit[unit]
    who = np.repeat(np.arange(len(unit)), count)
    which = np.repeat(offset[unit] - (np.cumsum(count) - count), count) + np.arange(len(who))
    useful = found[run[which]] < high[who]
    who, which = who[useful], which[useful]
    yield from by_batch(batch[who], [number[who], inner[run[which]], run_n[which], found[run[which]]])


# ---- the job ---------------------------------------------------------------------------------


def covered(seg: Segments, ids: np.ndarray, blobs: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc index, first word, last word + 1) of word runs covered by windows of smaller documents."""
    parts = [unpack(b)[0] for b in blobs]
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    number, at, n, found = (np.concatenate([p[k] for p in parts]) for k in range(4))
    place, cut = number >> 1, (number & 1).astype(bool)
    seg = seg.split(seg.route[np.searchsorted(seg.places(), place[cut], side="right") - 1])
    number = np.searchsorted(seg.places(), place)
    rows = np.flatnonzero(np.isin(seg.route, seg.route[number]))
    canon, _ = seg.copies(rows)
    order = np.argsort(canon, kind="stable")
    rows, canon = rows[order], canon[order]
    low, high = np.searchsorted(canon, number, side="left"), np.searchsorted(canon, number, side="right")
    count = high - low
    k = np.repeat(np.arange(len(number)), count)
    s = rows[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(k))]
    hit = found[k] < ids[seg.doc[s]]
    k, s = k[hit], s[hit]
    begin = seg.word[s] + at[k]
    return seg.doc[s], begin, begin + n[k] + window - 1


def batched(docs: DataFrame, batch_bytes: int, total: int) -> DataFrame:
    """Documents dealt to batches of about ``batch_bytes`` of text by a hash of id and text."""
    n = max(1, -(-total // batch_bytes))
    return docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("long")).repartition(n, "batch")


def _ids(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Document ids; a null id is below every other, so none of its windows is a repeat."""
    return table.column("doc_id").cast(pa.int64()).fill_null(-_NONE - 1).to_numpy().astype(np.int64)


def _above(ids: np.ndarray) -> np.ndarray:
    """Null ids as above every other, so that their rows count for nobody."""
    return np.where(ids == -_NONE - 1, _NONE, ids)


def _record(names: tuple[str, ...], row: tuple) -> pa.RecordBatch:
    return pa.record_batch([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in row], names=list(names))


def _canonical(table: pa.Table) -> pa.Table:
    """A batch in an order that depends on its rows only, whatever order they arrive in."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def substring_dedup(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    batch_bytes: int = BATCH_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, n_passages.

    Removes each word covered by a window of ``window`` words whose sequence also starts in a
    document with a smaller doc_id, judged on the input. Documents are dealt to batches. A batch first
    sends the minimizers of its segments to their shards and learns which of them other documents
    have too; a segment without such company cannot match. It then sends each distinct remaining
    segment once, and gets back the smallest document of each of its windows. A passage common to
    many documents so reaches a shard once per batch. A minimizer whose segments have more than
    ``shard_bytes`` (a frequent phrase in ever different contexts) is split: its distinct windows are
    sent one by one to the shards of their own hashes, so no shard gets all text around it. kept_sha256 is over the kept words joined by one space. Defined cases: a null
    text has no words (the digest of the empty string); texts shorter than the window stay whole;
    a null id is above every other document's reach: such rows are left whole and count for nobody;
    repeated rows of one id never remove each other's words; an empty table gives no rows.
    """
    d = narrow(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(1, -(-total // shard_bytes))
    dealt = batched(d, batch_bytes, total)

    def deal(number: int, keys: np.ndarray, columns: list[np.ndarray], texts: list[bytes] | None) -> Iterator[tuple[int, int, bytes]]:
        """(shard, batch, blob) of one batch's rows, by the shard of their route."""
        shard = (mix64(keys) % np.uint64(n_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        for a, b in _spans(shard[order]):
            rows = order[a:b]
            yield int(shard[rows[0]]), number, pack([c[rows] for c in columns], [texts[k] for k in rows] if texts else [])

    def opened(table: pa.Table) -> tuple[pa.Table, np.ndarray, Segments]:
        table = _canonical(table)
        return table, _ids(table), Segments(bytes_list(table.column("text").combine_chunks()), window)

    def send_routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _grouped(batches, "batch"):
            _, ids, seg = opened(table)
            route, low, high = bounds(seg.route, _above(ids)[seg.doc])
            # 32 bits tell the routes of a shard apart well enough: a clash only lets more text through.
            columns = [np.arange(len(route)), (route >> np.uint64(32)).astype(np.int64), low, high, seg.sizes(route)]
            for row in deal(number, route, columns, None):
                yield _record(("shard", "batch", "blob"), row)

    def share_routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _grouped(batches, "shard"):
            entries = []
            for number, blob in zip(table.column("batch").to_pylist(), table.column("blob").to_pylist(), strict=True):
                arrays, _ = unpack(blob)
                entries.append((np.full(len(arrays[0]), number), *arrays))
            for row in shared_routes(entries, shard_bytes):
                yield _record(("batch", "answers"), row)

    def send_texts(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, bytes]] = []
        if right.num_rows:
            _, ids, seg = opened(left)
            answers = [unpack(b)[0] for b in right.column("answers").to_pylist()]
            number, split = (np.concatenate([a[k] for a in answers]) for k in range(2))
            wanted = np.unique(seg.route)[number]
            seg = seg.split(wanted[split == 1])
            chosen = np.flatnonzero(seg.cut | np.isin(seg.route, wanted))
            canon, texts = seg.copies(chosen)
            first, low, high = bounds(canon, _above(ids)[seg.doc[chosen]])
            # The first window's number names an entry, with one more bit for windows of split routes.
            name = seg.places()[first] * 2 + seg.cut[first]
            rows = list(deal(left.column("batch")[0].as_py(), seg.route[first], [name, low, high], texts))
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["shard", "batch", "blob"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _grouped(batches, "shard"):
            entries = []
            for number, blob in zip(table.column("batch").to_pylist(), table.column("blob").to_pylist(), strict=True):
                arrays, texts = unpack(blob)
                entries.append((np.full(len(texts), number), *arrays, texts))
            for row in answer(entries, window):
                yield _record(("batch", "answers"), row)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        left, ids, seg = opened(left)
        texts = bytes_list(left.column("text").combine_chunks())
        doc, begin, end = covered(seg, ids, right.column("answers").to_pylist(), window)
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(len(texts) + 1))
        out = []
        for k, text in enumerate(texts):
            words = text.split()
            rows = order[cuts[k] : cuts[k + 1]]
            kept, removed, passages = words, 0, 0
            if len(rows):
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, begin[rows], 1)
                np.add.at(edge, end[rows], -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = int(gone.sum())
                passages = int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum())
                kept = [words[w] for w in np.flatnonzero(~gone)]
            out.append((len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest(), passages))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([left.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "n_passages"])

    def by_shard(df: DataFrame, fn) -> DataFrame:
        return df.repartition(n_shards, "shard").sortWithinPartitions("shard").mapInArrow(fn, "batch long, answers binary")

    routes = by_shard(dealt.sortWithinPartitions("batch").mapInArrow(send_routes, "shard long, batch long, blob binary"), share_routes)
    sent = dealt.groupBy("batch").cogroup(routes.groupBy("batch")).applyInArrow(send_texts, "shard long, batch long, blob binary")
    found = by_shard(sent, search)
    return dealt.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(
        apply, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, n_passages long"
    )


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Complete groups of a stream sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    current: int | None = None
    for batch in batches:
        values = batch.column(key).to_numpy()
        for a, b in _spans(values):
            if current is not None and values[a] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = int(values[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)
