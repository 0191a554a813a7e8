"""Periodic run detection: Lyndon arrays from Baier's grouping, Lyndon roots extended to runs.

Every maximal repetition (run) of a word sequence has a Lyndon root: in one of the two orders of the
alphabet (plain and reversed) the longest Lyndon word that starts at an inner position of the run is
as long as the run's period. Phase one of Baier's suffix sorter refines groups of suffixes until each
group's context is the longest Lyndon word its suffixes start with, so it yields that array without
sorting any suffix to the end. Two longest-common-extension queries turn each (position, length) into
the repetition it lies in.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreflow.llm.text import bytes_list, map_arrow, narrow

MIN_LENGTH = 6
MIN_EXPONENT = 4
PART_BYTES = 1 << 21  # bytes of text analysed at once; a longer text is a part of its own


def lyndon_lengths(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word starting at each position (phase one of Baier's grouping).

    Groups are ranges of ``order`` in increasing order of their context. They are taken from the
    largest down; the nearest smaller position to the left of each member (``prev``) has the group's
    context, once or several times, appended to its own context and moves into a new group right
    behind its old one. Those repeated more often come out larger. A group's context no longer
    grows when the group is taken, and it is then the longest Lyndon word of its members. ``left``
    skips positions already taken, with path halving, so the whole work is close to linear.
    """
    n = len(symbols)
    perm = np.argsort(symbols, kind="stable")
    rank = symbols[perm]
    first = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, n))
    start_of = np.empty(n, np.int64)
    start_of[perm] = np.repeat(first, sizes)
    place_of = np.empty(n, np.int64)
    place_of[perm] = np.arange(n)
    order, place, start = perm.tolist(), place_of.tolist(), start_of.tolist()
    size = [0] * (n + 1)
    for f, s in zip(first.tolist(), sizes.tolist(), strict=True):
        size[f] = s
    length = [1] * n
    left = list(range(n + 1))  # position i stands at i + 1; 0 is the place before the text
    end = n
    while end:
        begin = start[order[end - 1]]
        members = order[begin:end]
        for i in members:
            left[i + 1] = i
        own = length[members[0]]
        times: dict[int, int] = {}
        for i in members:
            p = i
            while left[p] != p:
                left[p] = p = left[left[p]]
            if p:
                times[p - 1] = times.get(p - 1, 0) + 1
        if times:
            if len(members) == 1 or (most := max(times.values())) == 1:
                levels = ((1, times),)
            else:
                by: list[list[int]] = [[] for _ in range(most + 1)]
                for p, k in times.items():
                    by[k].append(p)
                levels = tuple((k, by[k]) for k in range(most, 0, -1) if by[k])
            for k, moving in levels:
                grow = k * own
                for p in moving:
                    g = start[p]
                    size[g] = s = size[g] - 1
                    other, at, to = order[g + s], place[p], g + s
                    order[at], order[to] = other, p
                    place[other], place[p] = at, to
                    length[p] += grow
                for p in moving:
                    # all members of the old group that moved stand behind what is left of it
                    g = start[p]
                    start[p] = -1 - (g + size[g])
                for p in moving:
                    start[p] = g = -1 - start[p]
                    size[g] += 1
        end = begin
    return np.array(length, np.int64)


def block_names(symbols: np.ndarray, longest: int) -> list[np.ndarray]:
    """names[k][i] names the block of 2 ** k symbols at i; equal blocks have equal names (exact)."""
    names = [symbols.astype(np.int64)]
    while 1 << len(names) <= longest:
        half, below = 1 << (len(names) - 1), names[-1]
        if len(below) <= half:
            break
        pair = below[:-half] * (int(below.max()) + 1) + below[half:]
        names.append(np.unique(pair, return_inverse=True)[1])
    return names


def extensions(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """Longest common extension of positions i < j: to the right from them, or to the left before them."""
    total = np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        name, width = names[k], 1 << k
        a, b = (i - total - width, j - total - width) if back else (i + total, j + total)
        inside = (a >= 0) if back else (b + width <= len(names[0]))
        same = np.zeros(len(i), bool)
        same[inside] = name[a[inside]] == name[b[inside]]
        total[same] += width
    return total


def find_runs(symbols: np.ndarray, starts: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Rows (start, length, period) of all runs inside the pieces that begin at ``starts``.

    A separator smaller than every symbol in both orders closes each piece, so no Lyndon word
    leaves its piece; for the extensions each separator has a name of its own.
    """
    n, pieces = len(symbols), len(starts)
    if not n:
        return np.zeros((0, 3), np.int64)
    shift = np.arange(n) + np.searchsorted(starts, np.arange(n), side="right") - 1
    whole = np.zeros(n + pieces, np.int64)
    whole[shift] = np.unique(symbols, return_inverse=True)[1] + 1
    top = int(whole.max())
    closed = np.flatnonzero(whole == 0)
    unique = whole.copy()
    unique[closed] = top + 1 + np.arange(pieces)
    names = block_names(unique, int(np.diff(np.append(starts, n)).max()))
    found = []
    for text in (whole, np.where(whole > 0, top + 1 - whole, 0)):
        period = lyndon_lengths(text)
        i = np.flatnonzero((whole > 0) & (np.arange(len(whole)) + period < len(whole)))
        q = period[i]
        # a repetition with this root goes on by one symbol at least on one side
        i, q = (x[(unique[i] == unique[i + q]) | ((i > 0) & (unique[i - 1] == unique[i + q - 1]))] for x in (i, q))
        right, before = extensions(names, i, i + q, False), extensions(names, i, i + q, True)
        length = before + q + right
        ok = (length >= min_length) & (length >= min_exponent * q)
        found.append(np.stack([i - before, length, q], axis=1)[ok])
    rows = np.unique(np.concatenate(found), axis=0)
    back = np.full(len(whole), -1, np.int64)
    back[shift] = np.arange(n)
    rows[:, 0] = back[rows[:, 0]]
    return rows


def _pieces(words: np.ndarray, text: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, piece starts among them) of the words that a run can hold.

    Each word of a period stands at least ``min_exponent`` times in a run, so a word that is rarer in
    its piece is in none and cuts it; pieces shorter than ``min_length`` hold none. No run is lost
    by this. It is repeated while a round removes over a tenth of the words.
    """
    at = np.arange(len(words))
    piece = text.copy()
    while True:
        key = piece * (int(words.max(initial=0)) + 1) + words[at]
        _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
        keep = counts[where] >= min_exponent
        left, of = at[keep], piece[keep]
        new = np.concatenate([[True], (np.diff(left) != 1) | (np.diff(of) != 0)]) if len(left) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        long = (np.bincount(group) >= min_length)[group] if len(left) else np.zeros(0, bool)
        before = len(at)
        at, piece = left[long], group[long]
        if len(at) >= 0.9 * before or not len(at):
            break
    return at, np.flatnonzero(np.concatenate([[True], np.diff(piece) != 0])) if len(at) else np.zeros(0, np.int64)


def runs_of_texts(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[np.ndarray]:
    """Rows (start, length, period) of every text's runs, sorted; texts are lists of words."""
    ids: dict[bytes, int] = {}
    number = count()
    words = np.array([i if (i := ids.get(w)) is not None else ids.setdefault(w, next(number)) for t in texts for w in t], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    at, starts = _pieces(words, np.repeat(np.arange(len(texts)), sizes), min_length, min_exponent)
    rows = find_runs(words[at], starts, min_length, min_exponent)
    begin = at[rows[:, 0]]
    owner = np.searchsorted(first, begin, side="right") - 1  # an empty text begins where the next one does
    rows[:, 0] = begin - first[owner]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words of no run's continuation (its words after the first period), joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist())


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring texts with up to PART_BYTES bytes together."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > PART_BYTES:
            yield begin, k
            begin, held = k, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def periodic_runs(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, runs array<struct<start, length, period>>, collapsed.

    A run is a stretch of consecutive words with smallest period q that no neighbouring word extends
    and that is at least ``max(min_length, min_exponent * q)`` long (``min_exponent`` is 2 or more);
    runs are sorted by start, then period. ``collapsed`` is the text without the words that continue
    a run after its first period. Words are separated by ASCII white space, case matters. Defined
    cases: a null or empty text has no words and no runs and collapses to the empty text; a very
    long text is analysed whole, in linear space; rows with a null or repeated id are judged each by
    its own text; an empty table gives no rows; extra columns are not read.
    """
    if min_exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    spans = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = bytes_list(batch.column("text"))
        runs: list[np.ndarray] = []
        sizes: list[int] = []
        short: list[str] = []
        for a, b in _parts(texts):
            words = [t.split() for t in texts[a:b]]
            found = runs_of_texts(words, min_length, min_exponent)
            runs += found
            sizes += map(len, words)
            short += [collapse(t, r).decode() for t, r in zip(words, found, strict=True)]
        flat = np.concatenate(runs)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(spans)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), lists, pa.array(short, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    d = narrow(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    return map_arrow(d, run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def repeat_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text by id checksum gets a periodic tail, made from its own words.

    With h the CRC-32 of the decimal id and g = h div 10, texts with h mod 10 = 0 and n > 0 words have
    word i >= a replaced by their word a + (i - a) mod p, a = g mod n, p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    tail = docs.filter(F.coalesce(h % 10 == 0, F.lit(False))).select("doc_id", words.alias("w"), F.floor(h / 10).cast("long").alias("g"))
    tail = tail.select("doc_id", "w", "g", F.size("w").cast("long").alias("n")).select("*", F.expr("case when n > 0 then g % n else 0 end").alias("a"))
    tail = tail.select("*", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    made = F.array_join(F.expr("transform(w, (x, i) -> case when i < a then x else w[int(a + (i - a) % p)] end)"), " ")
    return docs.filter(~F.coalesce(h % 10 == 0, F.lit(False))).select("doc_id", "text").unionByName(tail.select("doc_id", made.alias("text")))


def run_digest(found: DataFrame) -> DataFrame:
    """Counts, the run of the greatest exponent and digests of ``periodic_runs``' result.

    Exponents are compared exactly, by cross-multiplication; ties go to the smallest start, then
    period. A text without runs has four nulls and the digest of the empty list.
    """
    better = "x.length * acc.period > acc.length * x.period or (x.length * acc.period = acc.length * x.period and (x.start < acc.start or (x.start = acc.start and x.period < acc.period)))"
    top = F.expr(f"case when size(runs) > 0 then aggregate(slice(runs, 2, size(runs)), runs[0], (acc, x) -> case when {better} then x else acc end) end")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
