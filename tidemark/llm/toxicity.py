"""Toxicity: maximum-scoring segments of token log-odds with Dirichlet priors, calibrated as extreme values.

A word's log-odds come from how many labelled documents of either class have it, with a Dirichlet prior whose mean is the
rate of the words that share its beginning, which in turn has a prior of shorter beginnings, and these that of all documents.
Counts are kept in a hashed table of fixed size. A text's scores, less a drift that makes the expected score negative, are
scanned once, which finds all maximal-scoring segments (Ruzzo and Tompa). By extreme-value theory a segment's chance of
arising in n words of harmless text is about 1 - exp(-K n exp(-lambda S)); lambda and K are fitted on harmless documents. A
document's score is a logistic function of its best segment's surprise and of the number of significant segments, fitted on
labelled documents whose own counts are left out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_batches, small_batches, texts_of

#: Labelled rows that the model is fitted on, at most about: a bounded sample, taken by a hash of the id.
FIT_ROWS = 50_000
#: Of these, rows that the calibration is fitted on.
CALIBRATION_ROWS = 8_000
#: Cells of the hashed count table; with two 4-byte counts each, this bounds what is broadcast to 8 MiB.
TABLE_CELLS = 1 << 20
#: Lengths of the beginnings of words that back a word up, shortest first.
BEGINNINGS = (4, 5)
#: Weight of the prior, in documents.
PRIOR = 6.0
#: What every word costs: makes the expected score of harmless text negative.
DRIFT = 0.35
#: A segment is significant if harmless text of the document's length has such a one with at most this chance.
SIGNIFICANT = 0.05
#: Words whose scores a worker remembers.
CACHE_WORDS = 500_000

#: Middles of the bins of word scores, for the background.
_CENTRES = (np.arange(4096) - 2047.5) / 128

_WORDS = re.compile(r"[^\W_]+")
_CHUNKS = 64


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def _cells(word: str) -> tuple[int, ...]:
    """Table cells of a word, most general first: its beginnings, then itself."""
    keys = [f"{n}^{word[:n]}" if len(word) >= n else f"={word}" for n in BEGINNINGS] + [f"={word}"]
    return tuple(xxhash.xxh32_intdigest(k.encode()) % TABLE_CELLS for k in keys)


def count_cells(texts: list[str], toxic: list[int], table: np.ndarray, known: dict) -> None:
    """Add the documents that have each cell to table[class]."""
    for text, label in zip(texts, toxic, strict=True):
        table[int(label)][doc_cells(text, known)] += 1


def doc_cells(text: str, known: dict) -> np.ndarray:
    cells = set()
    for w in set(words_of(text)):
        at = known.get(w)
        if at is None:
            at = known[w] = _cells(w)
        cells.update(at)
    return np.fromiter(cells, np.int64, len(cells))


@dataclass
class Model:
    table: np.ndarray  # harmless and toxic documents of each cell
    docs: np.ndarray  # of each class
    lam: float = 1.0
    k: float = 0.1
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def log_odds(self, cells: np.ndarray, without: int | None = None) -> np.ndarray:
        """Scores of words given by rows of cells; `without`: a class whose counts are less by one, the own document's."""
        non, tox = (self.table[c][cells].astype(np.float64) - (1.0 if without == c else 0.0) for c in (0, 1))
        totals = [max(1.0, self.docs[c] - (without == c)) for c in (0, 1)]
        # rates by class, each class weighing the same, so that a word without information scores zero
        a, b = tox / totals[1], non / totals[0]
        scale = np.minimum(*totals)
        rate = np.full(len(cells), 0.5)
        for level in range(cells.shape[1]):
            x, y = np.maximum(a[:, level], 0) * scale, np.maximum(b[:, level], 0) * scale
            rate = (x + PRIOR * rate) / (x + y + PRIOR)
        return np.log(rate / (1 - rate))


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, stop) of a sequence, disjoint and from left to right, in linear time."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list[float]] = []  # left sum, right sum, start, stop, place of the nearest earlier one with a smaller left sum
    for k in np.flatnonzero(scores > 0).tolist():
        left, right, start, stop = total[k], total[k + 1], k, k + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append([left, right, start, stop, j])
                break
            left, start = stack[j][0], stack[j][2]
            del stack[j:]
    return [(r - x, a, b) for x, r, a, b, _ in stack]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def word_scores(self, words: list[str], without: int | None = None) -> np.ndarray:
        if without is not None:
            distinct = list(dict.fromkeys(words))
            got = dict(zip(distinct, self.model.log_odds(np.array([_cells(w) for w in distinct]), without).tolist(), strict=True)) if distinct else {}
            return np.fromiter((got[w] for w in words), np.float64, len(words))
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            known.update(zip(new, self.model.log_odds(np.array([_cells(w) for w in new])).tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def surprise(self, s: float, n: int) -> float:
        """-log of the chance that n harmless words have a segment of score s."""
        rate = self.model.k * max(n, 1) * math.exp(-self.model.lam * s)
        return -math.log(-math.expm1(-rate)) if rate > 1e-12 else self.model.lam * s - math.log(self.model.k * max(n, 1))

    def found(self, words: list[str], without: int | None = None) -> list[tuple[float, int, int]]:
        """(surprise, first word, word after the last) of all maximal-scoring segments."""
        return [(self.surprise(s, len(words)), a, b) for s, a, b in segments(self.word_scores(words, without) - DRIFT)]

    def features(self, found: list[tuple[float, int, int]]) -> tuple[float, float]:
        """What the logistic function sees: the best segment's surprise, and the number of significant segments."""
        return min(max((x[0] for x in found), default=0.0), 60.0), math.log1p(sum(significant(x) for x in found))

    def judge(self, text: str) -> tuple[float, list[tuple[float, int, int]]]:
        """The score of a text and its significant passages."""
        found = self.found(words_of(text))
        a, b = self.features(found)
        w = self.model.weights
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, w[0] + w[1] * a + w[2] * b)))), [x for x in found if significant(x)]


def significant(segment: tuple[float, int, int]) -> bool:
    return segment[0] >= -math.log(SIGNIFICANT)


def fit_background(counts: np.ndarray, best: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """lambda with E exp(lambda s) = 1 over harmless words, and K by the mean of the best segments' scores (Gumbel).

    counts: words by score, in the bins of _CENTRES; best and words: best segment's score and length of each document.
    """
    total = max(1, counts.sum())
    low, high, lam = 1e-3, 20.0, 1.0
    if counts[_CENTRES > 0].any() and (counts * _CENTRES).sum() < 0:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (counts * np.exp(np.minimum(mid * _CENTRES, 500))).sum() / total < 1 else (low, mid)
        lam = max(low, 0.05)
    enough = words >= 20
    if not enough.any():
        return lam, 0.1
    # for a Gumbel variable, E[lambda S] = log(K n) + Euler's constant
    k = math.exp(float(np.mean(lam * best[enough] - np.log(words[enough]))) - 0.5772156649)
    return lam, min(max(k, 1e-6), 10.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (bias first) of a logistic regression, by Newton steps."""
    z = np.c_[np.ones(len(x)), x]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z / len(z) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) / len(z) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(labelled: DataFrame) -> Model:
    """A model of labelled(doc_id, text, toxic), a bounded table of labelled rows that is cheap to read again.

    Tasks count cells in tables of fixed size; these are added up by ranges of cells, so the driver gets one table.
    """
    small_batches(labelled.sparkSession)

    def count(batches):
        table, known = np.zeros((2, TABLE_CELLS), np.int32), {}
        docs = np.zeros(2, np.int64)
        for batch in batches:
            labels = batch.column(1).to_pylist()
            count_cells(texts_of(batch.column(0)), labels, table, known)
            docs += np.bincount(labels, minlength=2)
            if len(known) > CACHE_WORDS:
                known.clear()
        if docs.sum():
            parts = table.reshape(2, _CHUNKS, -1)
            rows = [(k, parts[:, k].tobytes()) for k in range(_CHUNKS)] + [(_CHUNKS, docs.astype(np.int32).tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in group.column("counts").to_pylist())
        return pa.table({"part": group.column("part")[:1], "counts": pa.array([total.astype(np.int32).tobytes()], pa.binary())})

    rows = labelled.select(F.col("text"), F.col("toxic").cast("int").alias("toxic")).coalesce(16)
    parts = {r.part: r.counts for r in rows.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()}
    if not parts:
        return Model(np.zeros((2, TABLE_CELLS), np.int32), np.zeros(2))
    table = np.concatenate([np.frombuffer(parts[k], np.int32).reshape(2, -1) for k in range(_CHUNKS)], axis=1)
    model = Model(table, np.frombuffer(parts[_CHUNKS], np.int32).astype(np.int64))
    share = CALIBRATION_ROWS / max(CALIBRATION_ROWS, int(model.docs.sum()))
    calibrate(model, labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(1_000_000)) < int(share * 1_000_000)))
    return model


def calibrate(model: Model, sample: DataFrame) -> None:
    """Fit the background and the logistic weights on a bounded sample, each document without its own counts."""
    spark = sample.sparkSession
    rows = sample.select("text", F.col("toxic").cast("int").alias("toxic"))

    first = spark.sparkContext.broadcast(model)

    def background(batches):
        scorer, counts = Scorer(first.value), np.zeros(len(_CENTRES), np.int64)
        for batch in batches:
            best, words = [], []
            for text in texts_of(batch.column(0)):
                scores = scorer.word_scores(words_of(text), 0) - DRIFT
                counts += np.bincount(np.clip((scores * 128 + 2048).astype(int), 0, len(counts) - 1), minlength=len(counts))
                best.append(max((x for x, _, _ in segments(scores)), default=0.0))
                words.append(len(scores))
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), pa.array(words, pa.int64()), pa.nulls(len(best), pa.binary())], names=["best", "words", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.float64()), pa.nulls(1, pa.int64()), pa.array([counts.tobytes()], pa.binary())], names=["best", "words", "counts"])

    got = rows.filter("toxic = 0").coalesce(16).mapInArrow(background, "best double, words long, counts binary").collect()
    counts = sum((np.frombuffer(r.counts, np.int64) for r in got if r.counts is not None), np.zeros(len(_CENTRES), np.int64))
    documents = [(r.best, r.words) for r in got if r.counts is None]
    model.lam, model.k = fit_background(counts, np.array([x for x, _ in documents]), np.array([n for _, n in documents]))
    second = spark.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(second.value)

        def one(batch):
            labels = batch.column(1).to_pylist()
            got = [scorer.features(scorer.found(words_of(t), y)) for t, y in zip(texts_of(batch.column(0)), labels, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in got]), pa.array([b for _, b in got]), batch.column(1)], names=["a", "b", "y"])

        return one

    got = map_batches(rows, make, "a double, b double, y int").toArrow()
    x, y = np.c_[np.asarray(got["a"]), np.asarray(got["b"])], np.asarray(got["y"]).astype(float)
    model.weights = tuple(logistic(x, y).tolist()) if len(y) else (0.0, 0.0, 0.0)


def bounded_sample(labels: DataFrame, rows: int, salt: str = "fit") -> DataFrame:
    """At most about `rows` of labels' rows, by a hash of doc_id: the same rows in every run."""
    n = labels.count()
    return labels if n <= rows else labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000_000)) < int(rows / n * 1_000_000_000))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on a bounded sample of the labelled documents, which is read from the corpus once and kept in the shared folder.

    Labels without an id or a class are left out, repeated ones count once (as toxic if they differ). Of documents that
    share an id the smallest text counts.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sample = F.broadcast(bounded_sample(known, fit_rows))  # fit_rows bounds its size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    return fit(checkpoint(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, passages) of every row: passages are the significant ones, as (surprise, first, stop) in words.

    Only the text counts. A null or empty text has no passages and the score of a document without any. Rows are independent
    of each other; an empty table gives an empty one; other columns are left out.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            judged = [scorer.judge(t) for t in texts_of(batch.column(1))]
            scores = [x for x, _ in judged]
            passages = [[{"surprise": p, "first": a, "stop": b} for p, a, b in found] for _, found in judged]
            kind = pa.list_(pa.struct([("surprise", pa.float64()), ("first", pa.int64()), ("stop", pa.int64())]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)], names=["doc_id", "score", "passages"])

        return one

    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(kept, make, f"doc_id {kept.schema[0].dataType.simpleString()}, score double, passages array<struct<surprise: double, first: bigint, stop: bigint>>")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages of every document; held-out rows' labels aren't used."""
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
