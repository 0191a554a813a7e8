"""Language identification with a bidirectional gated recurrent network over bytes, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreflow.llm.text import FOLD, narrow

SPAN = 128  # bytes per window; every byte of a text belongs to one window
HIDDEN = 8
LANES = 2_048  # windows run through the network at once
TRAIN_DOCS = 80  # documents per language the network learns from
TRAIN_SPANS = 12  # windows taken from each, evenly over the text
EPOCHS = 14
BATCH = 128
RATE = 0.02
UNDETERMINED = "und"


@dataclass
class Model:
    """``table[d, byte]``: gate inputs of a byte (update, reset, candidate) in direction d."""

    langs: list[str]
    table: np.ndarray  # 2 x 256 x 3H
    recur: np.ndarray  # 2 x H x 3H
    out: np.ndarray  # 2H x C
    bias: np.ndarray  # C

    def params(self) -> list[np.ndarray]:
        return [self.table, self.recur, self.out, self.bias]


def _gate(x: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid, in place."""
    x *= np.float32(0.25)
    x += np.float32(0.5)
    return np.clip(x, 0, 1, out=x)


def _states(m: Model, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states at every position: T x 2 x N x H, the second direction read backwards.

    ``x`` is T x N bytes. ``keep`` collects what back-propagation needs.
    """
    steps, n = x.shape
    h = m.recur.shape[1]
    state = np.zeros((2, n, h), np.float32)
    out = np.empty((steps, 2, n, h), np.float32)
    given = np.empty((2, n, 3 * h), np.float32)
    for t in range(steps):
        np.take(m.table[0], x[t], axis=0, out=given[0], mode="clip")
        np.take(m.table[1], x[steps - 1 - t], axis=0, out=given[1], mode="clip")
        fed = state @ m.recur
        both = given[..., : 2 * h] + fed[..., : 2 * h]
        raw = both.copy() if keep is not None else None
        _gate(both)
        update, reset = both[..., :h], both[..., h:]
        cand = reset * fed[..., 2 * h :]
        cand += given[..., 2 * h :]
        np.tanh(cand, out=cand)
        new = state - cand
        new *= update
        new += cand
        if keep is not None:
            keep.append((state, raw, both, fed[..., 2 * h :].copy(), cand))
        state = new
        out[t, 0] = new[0]
        out[steps - 1 - t, 1] = new[1]
    return out


def probabilities(m: Model, x: np.ndarray) -> np.ndarray:
    """Language probabilities of every position: T x N x C."""
    s = _states(m, x)
    h = s.shape[-1]
    z = s[:, 0] @ m.out[:h]
    z += s[:, 1] @ m.out[h:]
    z += m.bias
    z -= z.max(axis=-1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=-1, keepdims=True)
    return z


def gradients(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean position loss of windows ``x`` (T x N; byte 0 is padding) and its gradients, through time."""
    steps, n = x.shape
    h = m.recur.shape[1]
    keep: list = []
    s = _states(m, x, keep)
    p = s[:, 0] @ m.out[:h] + s[:, 1] @ m.out[h:] + m.bias
    p -= p.max(axis=-1, keepdims=True)
    p = np.exp(p)
    p /= p.sum(axis=-1, keepdims=True)
    real = (x != 0).astype(np.float32)
    total = max(1.0, float(real.sum()))
    lane = np.arange(n)
    loss = float(-(np.log(p[:, lane, y] + 1e-9) * real).sum() / total)
    dz = p
    dz[:, lane, y] -= 1
    dz *= (real / total)[..., None]
    g_out = np.concatenate([np.einsum("tnh,tnc->hc", s[:, d], dz) for d in (0, 1)])
    g_bias = dz.sum(axis=(0, 1))
    g_table, g_recur = np.zeros_like(m.table), np.zeros_like(m.recur)
    back = np.zeros((2, n, h), np.float32)
    for t in range(steps - 1, -1, -1):
        before, raw, both, fed_n, cand = keep[t]
        back = back + np.stack([dz[t] @ m.out[:h].T, dz[steps - 1 - t] @ m.out[h:].T])
        update, reset = both[..., :h], both[..., h:]
        open_ = (np.abs(raw) < 2).astype(np.float32) * np.float32(0.25)
        d_cand = back * (1 - update) * (1 - cand * cand)
        d_gates = np.concatenate([back * (before - cand), d_cand * fed_n], axis=-1) * open_
        d_fed = np.concatenate([d_gates, d_cand * reset], axis=-1)
        d_given = np.concatenate([d_gates, d_cand], axis=-1)
        g_recur += before.transpose(0, 2, 1) @ d_fed
        np.add.at(g_table[0], x[t], d_given[0])
        np.add.at(g_table[1], x[steps - 1 - t], d_given[1])
        back = back * update + d_fed @ m.recur.transpose(0, 2, 1)
    return loss, [g_table, g_recur, g_out, g_bias]


def fit(spans: list[bytes], labels: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7) -> Model | None:
    """Train on windows by Adam; deterministic for a given list. No window gives no model."""
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    c = len(langs)
    m = Model(
        langs,
        rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32),
        rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden)).astype(np.float32),
        rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, c)).astype(np.float32),
        np.zeros(c, np.float32),
    )
    x = np.zeros((len(spans), SPAN), np.uint8)
    for k, s in enumerate(spans):
        x[k, : min(SPAN, len(s))] = np.frombuffer(s[:SPAN], np.uint8)
    y = np.array([langs.index(v) for v in labels])
    first = [np.zeros_like(p) for p in m.params()]
    second = [np.zeros_like(p) for p in m.params()]
    step, total = 0, epochs * -(-len(x) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            rows = order[k : k + BATCH]
            _, grads = gradients(m, np.ascontiguousarray(x[rows].T), y[rows])
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = RATE * (1 - 0.9 * step / total)
            for p, g, a, b in zip(m.params(), grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return m


def pooled(m: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: mean probabilities over its positions, and the share of positions labelled by each language."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n_spans = -(-sizes // SPAN)
    owner = np.repeat(np.arange(len(texts)), n_spans)
    sums = np.zeros((len(texts), len(m.langs)))
    votes = np.zeros((len(texts), len(m.langs)))
    padded = np.zeros((int(n_spans.sum()), SPAN), np.uint8)
    flat = padded.reshape(-1)
    at = (np.cumsum(n_spans) - n_spans) * SPAN
    for t, a in zip(texts, at.tolist(), strict=True):
        flat[a : a + len(t)] = np.frombuffer(t, np.uint8)
    used = np.minimum(SPAN, np.repeat(sizes, n_spans) - SPAN * (np.arange(len(owner)) - np.repeat(at // SPAN, n_spans)))
    for k in range(0, len(owner), LANES):
        x = np.ascontiguousarray(padded[k : k + LANES].T)
        p = probabilities(m, x)
        valid = np.arange(SPAN)[:, None] < used[k : k + LANES]
        p *= valid[..., None]
        np.add.at(sums, owner[k : k + LANES], p.sum(axis=0))
        best = p.argmax(axis=-1)
        for c in range(len(m.langs)):
            np.add.at(votes[:, c], owner[k : k + LANES], ((best == c) & valid).sum(axis=0))
    total = np.maximum(sizes, 1)[:, None]
    return sums / total, votes / total


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from up to TRAIN_DOCS documents per language, none held out, TRAIN_SPANS windows of each.

    The documents are those of the smallest id hashes; rows repeated with one id and language are one
    document, read from its smallest text. Only the documents' windows reach the driver, so what it
    holds is bounded by the number of languages, whatever the documents' number and length.
    """
    d = narrow(docs, doc_id=id_col, text=text_col, lang=lang_col)
    usable = d.filter("doc_id is not null and lang is not null and length(text) > 0").filter(~held_out(F.col("doc_id")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct().withColumn("rn", rank).filter(F.col("rn") <= TRAIN_DOCS)
    share = F.greatest(F.lit(0), F.length("text") - SPAN) / max(1, TRAIN_SPANS - 1)
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(TRAIN_SPANS - 1)), lambda k: F.floor(k * share).cast("int") + 1))
    # TRAIN_DOCS ids per language: small enough to broadcast however many documents there are.
    single = usable.join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    spans = single.select(
        "lang", F.xxhash64("doc_id").alias("h"), F.explode(F.transform(places, lambda p: F.substring(F.col("text"), p, F.lit(SPAN)))).alias("span")
    )
    rows = sorted((r.lang, r.h, r.span) for r in spans.collect())
    return fit([s.encode().translate(FOLD) for _, _, s in rows], [lang for lang, _, _ in rows])


def predictor(model: Model | None):
    """A pandas UDF text -> struct(lang_pred, score, position_share)."""

    @F.pandas_udf("lang_pred string, score double, position_share double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = pd.DataFrame({"lang_pred": [UNDETERMINED] * len(s), "score": 0.0, "position_share": 0.0})
            rows = [k for k, t in enumerate(s) if t and any(map(str.isalpha, t))] if model else []
            for a in range(0, len(rows), 500):
                part = rows[a : a + 500]
                p, v = pooled(model, [s.iloc[k].encode().translate(FOLD) for k in part])
                best = p.argmax(axis=1)
                at = np.arange(len(part))
                out.loc[part, "lang_pred"] = [model.langs[b] for b in best]
                out.loc[part, "score"] = np.minimum(p[at, best], 1.0)
                out.loc[part, "position_share"] = v[at, best]
            yield out

    return predict


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, position_share.

    score is the mean probability of lang_pred over all bytes of the whole text, position_share
    the share of bytes labelled with it. Defined cases: null texts and texts without a letter (of the
    Unicode categories L*; numerals and marks are none) are ``und`` with score 0 (so is everything if no
    labelled text exists); a very long text is read whole; a tie goes to the first language by name; a
    null id is not held out and not learned from; repeated rows are judged one by one; an empty
    table gives no rows; extra columns are not read.
    """
    model = train(docs, id_col, text_col, lang_col)
    d = narrow(docs, doc_id=id_col, text=text_col)
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predictor(model)("text").alias("p")).select("doc_id", "held_out", "p.*")
