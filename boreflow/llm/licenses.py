"""License scans: Aho-Corasick over words for phrases and tags, a shunting-yard for expressions."""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from boreflow.llm.text import FOLD, LETTER_WORDS, bytes_list, map_arrow, narrow

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# The method's own notice phrases, as words of letters and digits.
NOTICES = {
    "apache license": "apache", "licensed under the apache license version 2 0": "apache-2.0", "mit license": "mit",
    "permission is hereby granted free of charge": "mit", "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd", "bsd license": "bsd", "public domain": "public-domain",
    "creative commons attribution": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd",
    "cc by nc nd": "cc-by-nc-nd", "cc by nc sa": "cc-by-nc-sa", "cc0": "cc0",
}
TAG = "spdx license identifier"
TAG_AT = re.compile(rb"spdx-license-identifier\s*:[ \t]*([^\r\n]*)")
TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+\-]*")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
# How far a licence restricts reuse, by the first matching prefix; anything else counts as UNKNOWN.
STRICTNESS = (
    ("public-domain", 0.1), ("cc0", 0.1), ("unlicense", 0.1), ("0bsd", 0.1), ("mit", 0.2), ("bsd", 0.2), ("isc", 0.2),
    ("zlib", 0.2), ("apache", 0.2), ("cc-by-nc", 0.9), ("cc-by-nd", 0.9), ("cc-by-sa", 0.6), ("cc-by", 0.3), ("mpl", 0.5),
    ("epl", 0.5), ("lgpl", 0.5), ("agpl", 0.9), ("gpl", 0.8), ("reserved", 1.0),
)
UNKNOWN = 0.7
EXCEPTION_RELIEF = 0.2  # a "with" exception loosens the licence by so much


def strictness(licence: str) -> float:
    return next((v for prefix, v in STRICTNESS if licence.startswith(prefix)), UNKNOWN)


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: the longest well-formed expression at the start of ``tokens`` in postfix order.

    Reading stops before the first token that cannot follow, so text after the expression is left
    alone; unclosed brackets and a dangling operator are dropped.
    """
    out: list[str] = []
    ops: list[str] = []
    operand = False  # whether the last thing read ends an operand
    for t in tokens:
        if t in PRECEDENCE:
            if not operand:
                break
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[t]:
                out.append(ops.pop())
            ops.append(t)
            operand = False
        elif t == "(":
            if operand:
                break
            ops.append(t)
        elif t == ")":
            if not operand or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        else:
            if operand:
                break
            out.append(t)
            operand = True
    if not operand:  # a dangling operator, possibly behind opening brackets
        while ops and ops[-1] == "(":
            ops.pop()
        if ops:
            ops.pop()
    while ops:
        if (op := ops.pop()) != "(":
            out.append(op)
    return out


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels of an expression (licences, exceptions left out) and its strictness.

    ``or`` lets the user choose (the looser side), ``and`` binds both (the stricter side), ``with``
    loosens its licence.
    """
    stack: list[tuple[set[str], float, str]] = []
    for t in postfix(TOKEN.findall(expression.lower())):
        if t not in PRECEDENCE:
            stack.append(({t}, strictness(t), t))
            continue
        (rl, rs, _), (ll, ls, lt) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((ll, max(0.1, ls - EXCEPTION_RELIEF), lt))
        else:
            stack.append((ll | rl, min(ls, rs) if t == "or" else max(ls, rs), lt))
    return (stack[0][0], stack[0][1]) if stack else (set(), 0.0)


@functools.cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    words = text.translate(LETTER_WORDS).split()
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    starts: list[int] = []
    base, labels, score = set(), set(), 0.0
    tagged, spaces, seen = False, 0, 0
    for end, phrase in automaton().iter(line):
        tagged |= phrase == TAG
        if phrase in NOTICES:
            labels.add(NOTICES[phrase])
        if phrase in BASE:
            base.add(BASE[phrase])
            begin = end - len(phrase) - 1  # the space before the phrase
            spaces += line.count(" ", seen, begin) if begin >= seen else -line.count(" ", begin, seen)
            seen = begin
            starts.append(spaces)
    labels |= base
    for label in labels:
        score = max(score, strictness(label))
    if tagged:
        for m in TAG_AT.finditer(text.translate(FOLD)):
            found, strict = evaluate(m[1].decode("utf-8", "replace"))
            labels |= found
            score = max(score, strict)
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters and non-ASCII characters after folding A-Z. n_base counts
    all places of the base phrases, first_word and last_word are their smallest and largest start.
    labels adds notice phrases and the licences of identifier tags, whose expressions are parsed
    and evaluated; score is the strictness of the strictest notice or expression (0: none).
    Defined cases: null and empty texts have no words, empty labels and score 0; malformed
    expressions give the licences of their well-formed beginning; repeated rows are scanned one by
    one; an empty table gives no rows; texts of any length are read whole.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*(scan(b) for b in bytes_list(batch.column("text"))), strict=True))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.record_batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=NAMES)

    d = narrow(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    return map_arrow(d, run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
