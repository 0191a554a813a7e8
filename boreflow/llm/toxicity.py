"""Toxic passages: maximum-scoring segments of token log-odds with extreme-value calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.llm.text import LETTER_WORDS, bytes_list, map_arrow, materialize, narrow

TRAIN_PER_CLASS = 8_000  # about so many labelled documents of each class the scores are learned from
FEATURES = 20_000  # features with the largest |z| that the model keeps
LEAST_DOCS = 3  # distinct training documents a feature occurs in
PRIOR_SHARE = 0.05  # the Dirichlet prior is so large a share of the corpus' document counts
STEMS = (4, 5)  # a longer word also counts as its beginnings of so many characters
DRIFT = 0.05  # a token without evidence lowers a running segment by so much
SIGNIFICANT = 0.05  # expected number of such segments in a clean text of the same length
THRESHOLD = 0.7
MEMO_WORDS = 300_000


def features(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace")
    return [w, *(w[:n] + "*" for n in STEMS if len(w) > n)]


@dataclass
class Model:
    scores: dict[str, tuple[float, float]] = field(default_factory=dict)  # feature -> (|z|, log-odds)
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    memo: dict[bytes, float] = field(default_factory=dict)

    def token(self, word: bytes) -> float:
        """Score of a word: the log-odds of its most significant feature, less the drift."""
        s = self.memo.get(word)
        if s is None:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            known = [self.scores[f] for f in features(word) if f in self.scores]
            s = self.memo[word] = (max(known)[1] if known else 0.0) - DRIFT
        return s

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memo": {}}


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) in one pass, best score first.

    A list of candidates is kept with the running totals before and after each; a new positive
    token joins the nearest candidate whose total before it is lower, unless that candidate's own
    end total is already as high, and swallows those between.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float, int]] = []  # begin, end, total before, total after, place to look on
    for k in positive.tolist():
        begin, left, right = k, float(total[k]), float(total[k + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((begin, k + 1, left, right, j))
                break
            begin, left = found[j][0], found[j][2]
            del found[j:]
    return sorted(((b, e, r - lo) for b, e, lo, r, _ in found), key=lambda s: -s[2])


def token_scores(m: Model, text: bytes) -> np.ndarray:
    """Scores of a text's words in order; the k-th place of a word with a positive score has 1/k of it,
    so that a line repeated many times is no more evidence than a few different words."""
    words = text.translate(LETTER_WORDS).split()
    scores = np.fromiter(map(m.token, words), np.float64, len(words))
    seen: Counter = Counter()
    for k in np.flatnonzero(scores > 0).tolist():
        seen[words[k]] += 1
        scores[k] /= seen[words[k]]
    return scores


def evidence(m: Model, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
    """(evidence, significant segments) of one text.

    A segment's calibrated score is lam * S - ln(K n): minus the log of the number of segments as
    good that a clean text of n words has by chance. All segments better than chance add up as the
    sum statistic of the r best, less ln r! for their order; the evidence is the largest over r.
    """
    if not len(scores):
        return 0.0, []
    chance = m.log_k + math.log(len(scores))
    best, running, kept = 0.0, 0.0, []
    for r, (b, e, s) in enumerate(segments(scores), 1):
        calibrated = m.lam * s - chance
        if calibrated <= 0:
            break
        if calibrated >= -math.log(SIGNIFICANT):
            kept.append((b, e, calibrated))
        running += calibrated - math.log(r)
        best = max(best, running)
    return best, kept


def extreme_value_scale(histogram: dict[float, int]) -> float:
    """The positive root of E[exp(lam * s)] = 1 over clean tokens.

    One made-up token with the best score keeps the root finite where clean text has no hit.
    """
    values = np.array([*histogram, max([*histogram, 1.0])])
    counts = np.array([*histogram.values(), 1], float)
    logs = np.log(counts / counts.sum())

    def excess(lam: float) -> float:
        x = logs + lam * values
        top = x.max()
        return top + math.log(np.exp(x - top).sum())

    low, high = 1e-6, 1e-3
    while excess(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, lightly penalised so they stay finite."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    ridge = np.diag([1e-2, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge @ w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame, usable: DataFrame, n: dict[int, int]) -> DataFrame:
    """(text, toxic) of about TRAIN_PER_CLASS distinct labelled texts per class.

    A class of n labelled documents gives those whose id hash lies in the lowest TRAIN_PER_CLASS / n
    of its range, all of them if there are fewer; no sort or window gathers a class in one task. The
    chosen ids, bounded by that parameter, are broadcast to the scan of the documents.
    """
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    part = F.when(F.col("toxic") == 1, TRAIN_PER_CLASS / max(1, n.get(1, 0))).otherwise(TRAIN_PER_CLASS / max(1, n.get(0, 0)))
    chosen = usable.filter(place < part).distinct()
    rows = docs.filter("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    return materialize(rows.dropDuplicates(["text", "toxic"]))


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, docs, toxic_docs, clean_docs) by documents that hold a feature; toxic may be absent."""
    labelled = "toxic" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms: dict[bytes, list[str]] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                part = batch.slice(k, 2_000)
                count = {0: Counter(), 1: Counter()}
                kinds = part.column("toxic").to_pylist() if labelled else [0] * part.num_rows
                for text, kind in zip(bytes_list(part.column("text")), kinds, strict=True):
                    held: set[str] = set()
                    for w in set(text.translate(LETTER_WORDS).split()):
                        f = forms.get(w)
                        if f is None:
                            if len(forms) > MEMO_WORDS:
                                forms.clear()
                            f = forms[w] = features(w)
                        held.update(f)
                    count[kind].update(held)
                for kind, c in count.items():
                    if c:
                        yield pa.record_batch([pa.array(list(c)), pa.array([kind] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["feature", "kind", "n"])

    counted = rows.mapInArrow(run, "feature string, kind int, n long")
    return counted.groupBy("feature").agg(
        F.sum("n").alias("docs"), F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("toxic_docs"),
        F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("clean_docs"),
    )


def log_odds(train: DataFrame, docs: DataFrame) -> dict[str, tuple[float, float]]:
    """Features with significant log-odds between toxic and clean texts under a Dirichlet prior.

    The prior of a feature is proportional to its document count over the whole corpus, labelled or
    not. Of V features tested, those with |z| above sqrt(2 ln V) count, a bound that chance alone hardly
    passes however many there are; the FEATURES most significant of them reach the driver.
    """
    own = materialize(feature_counts(train).filter(F.col("docs") >= LEAST_DOCS))
    corpus = feature_counts(docs.select("text")).select("feature", (F.col("docs") * PRIOR_SHARE).alias("a"))
    c = materialize(own.join(corpus, "feature"))
    s = c.agg(*(F.sum(x).alias(x) for x in ("toxic_docs", "clean_docs", "a")), F.count(F.lit(1)).alias("v")).first()
    if not s.toxic_docs or not s.clean_docs:
        return {}
    y, x, a = F.col("toxic_docs") + F.col("a"), F.col("clean_docs") + F.col("a"), s.a
    delta = F.log(y / (s.toxic_docs + a - y)) - F.log(x / (s.clean_docs + a - x))
    z = delta / F.sqrt(1 / y + 1 / x)
    top = c.select("feature", delta.alias("d"), F.abs(z).alias("z")).filter(F.col("z") >= math.sqrt(2 * math.log(s.v))).orderBy(F.desc("z"), "feature").limit(FEATURES)
    return {r.feature: (r.z, r.d) for r in top.collect()}


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The whole model; only bounded sums, features and training scores reach the driver."""
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    share = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    rows = training_rows(docs, usable, share)
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    m = Model()
    if not n.get(0) or not n.get(1):
        m.offset = math.log((share.get(1, 0) + 1) / (share.get(0, 0) + 1))
        return m
    m.scores = log_odds(rows, docs)

    def clean_tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        count: Counter = Counter()
        for text in bytes_list(batch.column("text")):
            count.update(np.round(token_scores(m, text), 3).tolist())
        return pa.record_batch([pa.array(list(count), pa.float64()), pa.array(list(count.values()), pa.int64())], names=["s", "n"])

    tokens = map_arrow(rows.filter("toxic = 0").select("text"), clean_tokens, "s double, n long").groupBy("s").agg(F.sum("n").alias("n"))
    m.lam = extreme_value_scale({r.s: r.n for r in tokens.collect()})

    def best(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in bytes_list(batch.column("text")):
            s = token_scores(m, text)
            found = segments(s)
            rows.append(m.lam * found[0][2] - math.log(len(s)) if found else None)
        return pa.record_batch([pa.array(rows, pa.float64())], names=["top"])

    # Location by the mean of the extreme-value law over clean texts; texts without a hit have none.
    top = map_arrow(rows.filter("toxic = 0").select("text"), best, "top double").agg(F.avg("top").alias("top")).first().top
    m.log_k = top - 0.5772156649 if top is not None else 0.0

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = [evidence(m, token_scores(m, t))[0] for t in bytes_list(batch.column("text"))]
        return pa.record_batch([pa.array(e, pa.float64()), batch.column("toxic").cast(pa.int32())], names=["e", "toxic"])

    pairs = map_arrow(rows, scored, "e double, toxic int").groupBy(F.round("e", 2).alias("e"), "toxic").count().collect()
    pairs.sort(key=lambda r: (r.e, r.toxic))
    weight = np.array([r["count"] * share[r.toxic] / n[r.toxic] for r in pairs])
    m.slope, m.offset = logistic(np.log1p([r.e for r in pairs]), np.array([float(r.toxic) for r in pairs]), weight / weight.mean())
    return m


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic",
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_segments, first_word, last_word.

    score is the calibrated probability that the text is toxic; predicted is 1 from THRESHOLD on.
    The significant toxic passages are counted and first_word / last_word bound them (null: none).
    Defined cases: null and empty texts have no evidence and get the score of a text without any
    hit; labels other than 0 and 1 and labels of null ids are not learned from; with one class only
    every text gets the classes' smoothed share; repeated rows are scored one by one; an empty
    table gives no rows; texts of any length are read whole.
    """
    d = narrow(docs, doc_id=id_col, text=text_col)
    known = narrow(labels, doc_id=label_id_col, toxic=label_col).withColumn("toxic", F.col("toxic").cast("int"))
    m = train(d, known)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in bytes_list(batch.column("text")):
            e, kept = evidence(m, token_scores(m, text))
            score = 1 / (1 + math.exp(-max(-30.0, min(30.0, m.slope * math.log1p(e) + m.offset))))
            out.append((score, int(score >= THRESHOLD), len(kept), min((b for b, _, _ in kept), default=None), max((x - 1 for _, x, _ in kept), default=None)))
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), *cols], names=["doc_id", "held_out", "score", "predicted", "n_segments", "first_word", "last_word"])

    kind = d.schema["doc_id"].dataType.simpleString()
    marked = d.withColumn("held_out", held_out(F.col("doc_id")))
    return map_arrow(marked, run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_segments long, first_word long, last_word long")
