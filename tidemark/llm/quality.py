"""Quality classifier by co-training: a text view and a page-metadata view teach each other with confident pseudo-labels.

The text view sees only the whole text: its words (log-odds of hashed words and word pairs, counted over the labelled fit
set; a fitted document's own counts are left out) and measures of its form (repetition, capitals, symbols, table bars, word
and line shapes), as means and as the worst stretch of words. The metadata view sees only language, source and declared
length. Both are logistic regressions over binned measures. In each round, each view scores all unlabelled documents and
labels those that it is surest about, for the other one: by class, those over a threshold from the histogram of all scores.
The documents labelled so far are written to the shared folder, and the views are refitted by Newton steps whose sums are
passes over these. At the end each view is calibrated on labelled documents that it wasn't fitted on, and the calibrated views
are combined. Only the labelled fit set is a bounded sample; bin edges, pseudo-labels and scores take every document.
"""

from __future__ import annotations

import functools
import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, map_batches, small_batches, texts_of
from .toxicity import bounded_sample, held_out, logistic

#: Labelled rows that the model is fitted on, at most about: a bounded sample by a hash of the id.
FIT_ROWS = 20_000
ROUNDS = 3
#: Share of the unlabelled documents of a class that a view labels for the other in a round; equal scores go together.
SHARE = 0.05
#: Newton steps of a refit, at most; they begin at zero, since steps from saturated weights overshoot.
STEPS = 12
#: Taught rows whose sums a task adds up in a step, at least if there are so many.
STEP_ROWS = 20_000
#: Cells of a histogram of scores (log-odds from -20 to 20).
SCORE_CELLS = 4000
#: Cells of the words' counts, a power of two: with the bounded fit set, all that is ever counted in them.
WORD_CELLS = 1 << 18
#: Weight of the prior of a word's log-odds, in documents.
WORD_PRIOR = 2.0
#: Quantiles that are bin edges. Many measures are zero but for bad documents: those need edges in their upper end too.
QUANTILES = [k / 10 for k in range(10)] + [0.93, 0.96, 0.98, 0.99]
#: A pseudo-label needs at least this calibrated chance of its class.
CONFIDENT = 0.9
#: Documents with less than this chance of being good are rejected.
THRESHOLD = 0.5
#: Words of a stretch.
STRETCH = 24
#: Cells of languages, sources and lengths.
META_CELLS = (16, 64, 32)

_UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _STOP, _WIDE = range(7)
_KIND = np.full(256, 7, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = _UPPER, _LOWER, _DIGIT, _WIDE
_KIND[[ord(c) for c in "|#$%&*<>{}[]=_\\~^@+"]] = _SYMBOL
_KIND[[ord(c) for c in "!?"]] = _BANG
_KIND[[ord(c) for c in ".,;:"]] = _STOP
TEXT_FEATURES = 26

_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, _MIX))


def word_cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the words and of the pairs of neighbours; A-Z count as a-z."""
    raw = np.frombuffer(" ".join(words).encode().lower(), np.uint8)
    begins = np.concatenate([[0], np.flatnonzero(raw == 32) + 1])
    sizes = np.diff(begins, append=len(raw) + 1)
    at = np.arange(len(raw)) - np.repeat(begins, sizes)[: len(raw)]
    h = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * (raw != 32) * _POWERS[at % 64], begins)
    h = (h ^ h >> np.uint64(29)) * _MIX
    pairs = (h[:-1] * np.uint64(3) + h[1:]) * _MIX
    drop = np.uint64(64 - (WORD_CELLS.bit_length() - 1))
    return (h >> drop).astype(np.int64), (pairs >> drop).astype(np.int64)


@dataclass
class Words:
    """How many bad and good documents of the fit set have each cell."""

    counts: np.ndarray = field(default_factory=lambda: np.zeros((2, WORD_CELLS), np.int32))
    docs: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))

    @functools.cached_property
    def odds(self) -> np.ndarray:
        return self._odds(self.counts[0], self.counts[1], self.docs)

    @staticmethod
    def _odds(bad: np.ndarray, good: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Log-odds of being good, the classes weighing the same."""
        n = np.maximum(docs, 1)
        scale = n.min()
        return np.log((good * (scale / n[1]) + WORD_PRIOR) / (bad * (scale / n[0]) + WORD_PRIOR))

    def of(self, cells: np.ndarray, own: int | None = None) -> np.ndarray:
        """Log-odds of cells; `own`: the class of the fitted document that they are from, whose counts are left out."""
        if own is None:
            return self.odds[cells]
        return self._odds(*(np.maximum(0, self.counts[c][cells] - (own == c)) for c in (0, 1)), self.docs - (np.arange(2) == own))


def _worst(marks: np.ndarray) -> np.ndarray:
    """For each row of marks of the words: the highest mean of a stretch; a shorter last one counts as filled up with zeros."""
    n = marks.shape[1]
    full = n // STRETCH * STRETCH
    sums = [marks[:, :full].reshape(len(marks), -1, STRETCH).sum(axis=2).max(axis=1)] if full else []
    sums += [marks[:, full:].sum(axis=1)] if n > full else []
    return np.maximum.reduce(sums) / STRETCH


def text_features(text: str, known: Words | None = None, own: int | None = None) -> np.ndarray:
    """Measures of a whole text; all zero for one without words."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(TEXT_FEATURES)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ids = np.fromiter(map(hash, words), np.int64, n)
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    kinds = _KIND[raw]
    total = np.bincount(kinds, minlength=8) / len(raw)
    begins = np.concatenate([[0], np.flatnonzero(raw == 32) + 1])  # words hold no blanks of one byte

    def has(kind: int) -> np.ndarray:
        return np.logical_or.reduceat(kinds == kind, begins)

    marks = np.zeros((6, n))
    marks[0] = has(_UPPER) & ~has(_LOWER)
    marks[1], marks[2] = has(_SYMBOL), has(_BANG)
    marks[3, 1:] = ids[1:] == ids[:-1]
    for lag in range(1, min(13, n)):
        marks[4, lag:] += ids[lag:] == ids[:-lag]
    np.minimum(marks[4], 1, out=marks[4])
    content = 0.0
    if known is not None:
        single, pairs = word_cells(words)
        odds = known.of(single, own)
        content = (odds.sum() + known.of(pairs, own).sum()) / (2 * n - 1)
        marks[5] = -odds
    worst = _worst(marks)
    lines = [x for x in text.split("\n") if x.strip()]
    counts = np.unique(ids, return_counts=True)[1]
    mean = sizes.sum() / n
    out = [*(marks[:5].sum(axis=1) / n), *worst[:5]]
    out += [len(counts) / n, counts.max() / n, mean, min(1.0, math.sqrt(max(0.0, (sizes * sizes).sum() / n - mean * mean)) / 10), math.log1p(n)]
    out += [total[k] for k in (_DIGIT, _SYMBOL, _BANG, _STOP, _WIDE, _UPPER)]
    out += [len(set(lines)) / len(lines), math.log1p(len(lines)), np.count_nonzero(sizes <= 3) / n]
    return np.array([*out, content, worst[5]])


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> tuple[int, int, int]:
    """Cells of language, source and length; nulls have cells of their own."""
    return zlib.crc32((lang or "").encode()) % META_CELLS[0], zlib.crc32((source or "").encode()) % META_CELLS[1], min(31, max(0, int(n_chars if n_chars is not None else -1) + 1).bit_length())


def _meta_matrix(cells: np.ndarray) -> np.ndarray:
    return np.hstack([np.arange(n) == cells[:, k : k + 1] for k, n in enumerate(META_CELLS)]).astype(float)


@dataclass
class View:
    edges: list[np.ndarray] | None = None  # of the bins of each measure; None for the metadata view
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    platt: tuple[float, float] = (0.0, 1.0)

    def matrix(self, x: np.ndarray) -> np.ndarray:
        if self.edges is None:
            return _meta_matrix(x.astype(int))
        cols = []
        for k, e in enumerate(self.edges):
            cols.append(x[:, k : k + 1] > e[None, :])  # cumulative bins
        return np.hstack(cols).astype(float)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.weights = logistic(self.matrix(x), y, ridge=3e-4)

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log-odds. Cumulative bins add up to a value for each bin, and one-hot cells have a weight each."""
        raw = np.full(len(x), self.weights[0])
        if len(self.weights) > 1:
            at = 1
            for k, n in enumerate(map(len, self.edges) if self.edges is not None else META_CELLS):
                w = self.weights[at : at + n]
                raw += np.concatenate([[0.0], np.cumsum(w)])[np.searchsorted(self.edges[k], x[:, k])] if self.edges is not None else w[x[:, k].astype(int)]
                at += n
        return np.clip(self.platt[0] + self.platt[1] * raw, -20, 20)

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


@dataclass
class Model:
    text: View
    meta: View
    weights: np.ndarray  # bias, text view, metadata view
    words: Words = field(default_factory=Words)

    def chance(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        z = self.weights[0] + self.weights[1] * self.text.logit(text) + self.weights[2] * self.meta.logit(meta)
        return 1 / (1 + np.exp(-np.clip(z, -20, 20)))


@dataclass
class Lesson:
    """What the views taught each other in a round: the views as they were, and by taught view the (bad, good) log-odds of
    the other one from which its label holds."""

    views: list[View]
    limits: list[tuple[float, float]]


def _taught(v: int, data: tuple[np.ndarray, np.ndarray], lessons: list[Lesson]) -> np.ndarray:
    """The label that view v was given for each row in the first lesson that covers it; nan without one."""
    out = np.full(len(data[0]), np.nan)
    for lesson in lessons:
        z = lesson.views[1 - v].logit(data[1 - v])
        bad, good = lesson.limits[v]
        out = np.where(np.isnan(out) & (z <= bad), 0.0, np.where(np.isnan(out) & (z >= good), 1.0, out))
    return out


def _cell(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((z + 20) * (SCORE_CELLS / 40)).astype(int), 0, SCORE_CELLS - 1)


def _scores(data: tuple[np.ndarray, np.ndarray], views: list[View], lessons: list[Lesson]) -> np.ndarray:
    """By taught view: the histogram of the other view's log-odds, over rows that it has no label for yet."""
    free = [np.isnan(_taught(v, data, lessons)) for v in (0, 1)]
    return np.concatenate([np.bincount(_cell(views[1 - v].logit(data[1 - v][free[v]])), minlength=SCORE_CELLS) for v in (0, 1)]).astype(float)


def _newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Row count, gradient and curvature of the log-likelihood, flat."""
    z = np.c_[np.ones(len(x)), x]
    p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
    return np.concatenate([[len(x)], z.T @ (y - p), ((z * (p * (1 - p) + 1e-9)[:, None]).T @ z).ravel()])


def _refit_sums(data: tuple[np.ndarray, np.ndarray], labels: np.ndarray, views: list[View]) -> np.ndarray:
    """labels: by view, nan where it was taught nothing."""
    parts = []
    for v in (0, 1):
        known = ~np.isnan(labels[v])
        parts.append(_newton_sums(views[v].matrix(data[v][known]), labels[v][known], views[v].weights))
    return np.concatenate(parts)


def _limit(histogram: np.ndarray, take: int, sure: float) -> float:
    """The log-odds from which the highest cells hold `take` rows, but at least `sure`; one cell, however full, is allowed."""
    above = np.cumsum(histogram[::-1])
    k = int(np.searchsorted(above, take)) if len(above) and above[-1] > take else SCORE_CELLS - 1
    return max(sure, (SCORE_CELLS - 1 - k) * (40 / SCORE_CELLS) - 20)


class Held:
    """Unlabelled rows that are held in memory."""

    def __init__(self, text: np.ndarray, meta: np.ndarray):
        self.data, self.size = (text, meta), len(text)

    def histograms(self, views: list[View], lessons: list[Lesson]) -> np.ndarray:
        return _scores(self.data, views, lessons)

    def taught(self, lessons: list[Lesson]):
        """A function of views: the refit's sums over the rows that were taught something."""
        labels = np.array([_taught(v, self.data, lessons) for v in (0, 1)])
        return lambda views: _refit_sums(self.data, labels, views)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, test: np.ndarray, rounds: int = ROUNDS, edges: list[np.ndarray] | None = None) -> Model:
    """y: 1, 0, or nan for unlabelled rows; test: labelled rows kept for calibration. All rows are held here."""
    if edges is None:
        edges = [np.unique(np.quantile(text[:, k], QUANTILES)) if len(text) else np.zeros(1) for k in range(TEXT_FEATURES)]
    known = ~np.isnan(y)
    return co_train_over(edges, text[known], meta[known], y[known], test[known], Held(text[~known], meta[~known]), rounds)


def co_train_over(edges: list[np.ndarray], text: np.ndarray, meta: np.ndarray, y: np.ndarray, test: np.ndarray, pool, rounds: int = ROUNDS) -> Model:
    """Labelled rows are held here; pool has the unlabelled ones, as Held does."""
    views = [View(edges), View()]
    data = [text, meta]
    train, held = np.flatnonzero(~test), np.flatnonzero(test)
    if not len(train) or not len(held) or len(np.unique(y[train])) < 2 or len(np.unique(y[held])) < 2:
        good = float(np.mean(y)) if len(y) else 1.0
        prior = math.log((good * len(y) + 1) / ((1 - good) * len(y) + 1))
        return Model(*views, np.array([prior, 0.0, 0.0]))

    def calibrate(v: int) -> None:
        views[v].platt = (0.0, 1.0)
        views[v].platt = tuple(logistic(views[v].logit(data[v][held])[:, None], y[held]))

    for v in (0, 1):
        views[v].fit(data[v][train], y[train])
        calibrate(v)
    sure = math.log(CONFIDENT / (1 - CONFIDENT))
    good = float(np.mean(y[train]))
    lessons: list[Lesson] = []
    for _ in range(rounds if pool.size else 0):
        histograms = pool.histograms(views, lessons).reshape(2, SCORE_CELLS)
        take = [max(1, int(SHARE * pool.size * share)) for share in (1 - good, good)]
        limits = [(-_limit(h[::-1], take[0], sure), _limit(h, take[1], sure)) for h in histograms]
        lessons.append(Lesson([View(x.edges, x.weights, x.platt) for x in views], limits))
        refit = pool.taught(lessons)
        for x in views:
            x.weights = np.zeros_like(x.weights)
        for _ in range(STEPS):
            sums, at, moved = refit(views), 0, 0.0
            for v in (0, 1):
                n = len(views[v].weights)
                own, pseudo = _newton_sums(views[v].matrix(data[v][train]), y[train], views[v].weights), sums[at : at + 1 + n + n * n]
                at += len(pseudo)
                total = own + min(1.0, len(train) / max(1.0, pseudo[0])) * pseudo  # together at most the labelled rows' weight
                ridge = 3e-4
                step = np.linalg.solve(total[1 + n :].reshape(n, n) / total[0] + ridge * np.eye(n), total[1 : 1 + n] / total[0] - ridge * views[v].weights)
                views[v].weights = np.round(views[v].weights + step, 9)  # the same model whatever order sums are added in
                moved = max(moved, float(np.abs(step).max()))
            if moved < 1e-2:
                break
        for v in (0, 1):
            calibrate(v)
    both = np.c_[views[0].logit(text[held]), views[1].logit(meta[held])]
    return Model(views[0], views[1], logistic(both, y[held], ridge=1e-3))


_IN = ("lang", "source", "n_chars")


def _inputs(docs: DataFrame, *keep) -> DataFrame:
    """keep, then text and metadata by fixed types; metadata columns that docs lacks are null."""
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}
    meta = [(F.col(c) if c in docs.columns else F.lit(None)).cast(kinds[c]).alias(f"__{c}") for c in _IN]
    return docs.select(*keep, F.col("text").cast("string").alias("__text"), *meta)


def _features(batch: pa.RecordBatch, at: int, words: Words, own=None) -> tuple[np.ndarray, np.ndarray]:
    texts = texts_of(batch.column(at))
    text = np.array([text_features(t, words, c) for t, c in zip(texts, own or [None] * len(texts), strict=True)])
    meta = np.array([meta_features(*x) for x in zip(*(batch.column(at + 1 + k).to_pylist() for k in range(3)), strict=True)])
    return text.reshape(-1, TEXT_FEATURES), meta.reshape(-1, 3)


def _sums(rows: DataFrame, function, *given) -> np.ndarray:
    """function(the columns' values, ...) added up: each task its own rows, then eight tasks these, then the driver eight."""
    shared = rows.sparkSession.sparkContext.broadcast(given)

    def own(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = function([np.asarray(c.flatten(), float).reshape(batch.num_rows, -1) for c in batch.columns], *shared.value)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def added(batches):
        total = None
        for batch in batches:
            for x in batch.column(0):
                part = np.frombuffer(x.as_buffer())
                total = part.copy() if total is None else np.add(total, part, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    got = rows.mapInArrow(own, "s binary").repartition(8).mapInArrow(added, "s binary").collect()
    shared.unpersist()
    return functools.reduce(np.add, [np.frombuffer(r.s) for r in got]) if got else np.zeros(0)


class Pool:
    """Unlabelled rows of a table (t, m): measures and metadata cells."""

    def __init__(self, rows: DataFrame, size: int):
        self.rows, self.size = rows, size

    def histograms(self, views: list[View], lessons: list[Lesson]) -> np.ndarray:
        return _sums(self.rows, _scores, views, lessons)

    def taught(self, lessons: list[Lesson]):
        """As Held.taught(); the taught rows are written to the shared folder, so that the steps read only them."""
        shared = self.rows.sparkSession.sparkContext.broadcast(lessons)

        def label(batches):
            for batch in batches:
                if batch.num_rows:
                    data = tuple(np.asarray(c.flatten(), float).reshape(batch.num_rows, -1) for c in batch.columns)
                    labels = np.array([_taught(v, data, shared.value) for v in (0, 1)])
                    some = np.flatnonzero(~np.isnan(labels).all(axis=0))
                    if len(some):
                        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(some)) for c in batch.columns), pa.array(list(labels[:, some].T), pa.list_(pa.float64()))], names=["t", "m", "y"])

        rows = checkpoint(self.rows.mapInArrow(label, "t array<double>, m array<int>, y array<double>"))
        rows = rows.coalesce(max(1, -(-rows.count() // STEP_ROWS)))  # a task's sums are as large as some thousand rows
        empty = [1 + n + n * n for n in (len(lessons[0].views[0].weights), len(lessons[0].views[1].weights))]

        def sums(views: list[View]) -> np.ndarray:
            got = _sums(rows, lambda columns, views: _refit_sums(tuple(columns[:2]), columns[2].T, views), views)
            return got if len(got) else np.zeros(sum(empty))

        return sums


def _count_words(fitted: DataFrame) -> Words:
    """Counts over the fitted rows that don't calibrate, a bounded table of cells and classes."""

    def cells(batches):
        for batch in batches:
            for text, y in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if words := text.split():
                    at = np.unique(np.concatenate(word_cells(words)))
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), y, np.int32))], names=["cell", "y"])

    rows = fitted.filter("not test")
    got = rows.select("__text", "y").mapInArrow(cells, "cell long, y int").groupBy("cell", "y").count().toArrow()
    words = Words()
    words.counts[np.asarray(got["y"]), np.asarray(got["cell"])] = np.asarray(got["count"])
    for r in rows.groupBy("y").count().collect():
        words.docs[r.y] = r["count"]
    return words


@dataclass
class Measured:
    """The fit set (test, y, t, m) and all documents (kept columns, __fitted, __t, __m), in the shared folder."""

    words: Words
    fit: DataFrame
    rows: DataFrame


def measured(docs: DataFrame, labels: DataFrame, keep: list[str], fit_rows: int = FIT_ROWS) -> Measured:
    """Labels without an id or a class are left out, repeated ones count once (as bad if they differ), and of documents that
    share a labelled id the smallest by content is fitted. Every document is measured once."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").cast("int").alias("__y"))
    sample = F.broadcast(bounded_sample(known.withColumnRenamed("__id", "doc_id"), fit_rows).withColumnRenamed("doc_id", "__id"))  # fit_rows bounds its size
    inputs = ["__text", *(f"__{c}" for c in _IN)]
    rows = _inputs(docs, *keep, F.col("doc_id").cast("long").alias("__doc"))
    chosen = rows.join(sample, F.col("__doc") == F.col("__id")).groupBy("__id").agg(F.min(F.struct(*inputs)).alias("r"), F.max("__y").alias("y"))
    held = F.pmod(F.xxhash64("__id", F.lit("calibrate")), F.lit(4)) == 0
    fitted = checkpoint(chosen.select(held.alias("test"), "y", "r.*"))
    shared = spark.sparkContext.broadcast(words := _count_words(fitted))

    def make_fit():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            classes = [None if t else y for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            text, meta = _features(batch, 2, shared.value, classes)
            return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(list(text), pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.int32()))], names=["test", "y", "t", "m"])

        return one

    n = len(keep) + 1
    every = rows.join(sample.select("__id"), F.col("__doc") == F.col("__id"), "left").select(*keep, F.col("__id").isNotNull().alias("__fitted"), *inputs)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            text, meta = _features(batch, n, shared.value)
            return pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(list(text), pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.int32()))], names=[*keep, "__fitted", "__t", "__m"])

        return one

    schema = T.StructType([*every.schema.fields[:n], T.StructField("__t", T.ArrayType(T.DoubleType())), T.StructField("__m", T.ArrayType(T.IntegerType()))])
    fit = checkpoint(map_batches(fitted, make_fit, "test boolean, y int, t array<double>, m array<int>"))
    return Measured(words, fit, checkpoint(map_batches(every, make, schema)))


def fit_model(found: Measured) -> Model:
    """The model of measured documents: all without a label of the fit set are unlabelled."""
    pool = found.rows.filter("not __fitted").select(F.col("__t").alias("t"), F.col("__m").alias("m"))
    quantiles = F.array(*map(F.lit, QUANTILES))
    seen = pool.select("t", F.lit(1).alias("n")).unionAll(found.fit.select("t", F.lit(0))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *(F.percentile_approx(F.col("t")[k], quantiles, 2000).alias(f"e{k}") for k in range(TEXT_FEATURES))).first()
    edges = [np.unique(seen[f"e{k}"] or [0.0]) for k in range(TEXT_FEATURES)]
    got = found.fit.toArrow()
    text = np.array(got["t"].to_pylist(), float).reshape(-1, TEXT_FEATURES)
    meta = np.array(got["m"].to_pylist(), int).reshape(-1, 3)
    y, test = np.array(got["y"].to_pylist(), float), np.array(got["test"].to_pylist(), bool)
    order = np.lexsort((*text.T, *meta.T, y))  # the same model whatever order the tasks end in
    model = co_train_over(edges, text[order], meta[order], y[order], test[order], Pool(pool, seen.n))
    model.words = found.words
    return model


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    return fit_model(measured(docs, labels, [], fit_rows))


_VIEWS = ("__text_view", "__meta_view", "__score")


def _chances(model: Model, text: np.ndarray, meta: np.ndarray) -> list[pa.Array]:
    return [pa.array(v, pa.float64()) for v in (model.text.chance(text), model.meta.chance(meta), model.chance(text, meta))]


def judged(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` with __text_view, __meta_view and __score, by a model of these documents, which are measured once."""
    found = measured(docs, labels, keep)
    shared = docs.sparkSession.sparkContext.broadcast(fit_model(found))
    n = len(keep)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            text, meta = (np.asarray(batch.column(k).flatten(), float).reshape(batch.num_rows, -1) for k in (n, n + 1))
            return pa.RecordBatch.from_arrays([*batch.columns[:n], *_chances(shared.value, text, meta)], names=[*keep, *_VIEWS])

        return one

    schema = T.StructType([*found.rows.schema.fields[:n], *(T.StructField(c, T.DoubleType()) for c in _VIEWS)])
    return map_batches(found.rows.drop("__fitted"), make, schema)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id if not given) with __text_view, __meta_view and __score, chances of being good."""
    keep = keep or ["doc_id"]
    small_batches(docs.sparkSession)
    rows = _inputs(docs, *keep)
    at = len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns[:at], *_chances(model, *_features(batch, at, model.words))], names=[*batch.schema.names[:at], *_VIEWS])

        return one

    return map_batches(rows, make, T.StructType([*rows.schema.fields[:at], *(T.StructField(c, T.DoubleType()) for c in _VIEWS)]))


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, hold_out: bool = True) -> DataFrame:
    """doc_id, held_out, text_view, meta_view, score and kept of every document.

    With hold_out, labels of the held-out ids (those with crc32 mod 5 = 0) are used for nothing, so that figures over them are
    honest. Null texts are empty texts; these, very long ones, and rows with null metadata, get scores as any other. Repeated
    rows repeat; an empty table gives an empty one; columns other than the known ones don't matter. Without labels of both
    classes, every document gets the labels' share of good ones.
    """
    apart = held_out(F.col("doc_id")) if hold_out else F.lit(False)
    found = judged(docs, labels.filter(~apart), ["doc_id"])
    return found.select("doc_id", apart.alias("held_out"), F.col("__text_view").alias("text_view"), F.col("__meta_view").alias("meta_view"), F.col("__score").alias("score"), (F.col("__score") >= threshold).alias("kept"))


def recalls(found: DataFrame, labels: DataFrame) -> DataFrame:
    """quality, n and right: the held-out labelled documents of each class in a report, and how many of them it judged right."""
    rows = found.filter("held_out").join(labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id")
    return rows.groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("kept") == (F.col("quality") == 1)).alias("right"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that the classifier, which here learns from all labels, rejects. Columns may have any names:
    a row travels as one struct beside what the classifier reads."""
    read = [c for c in ("doc_id", "text", *_IN) if c in docs.columns]
    packed = docs.select(*read, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    return judged(packed, labels, ["__row"]).filter(F.col("__score") >= threshold).select("__row.*")
