"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

A word's vector counts its letters. One inserted or deleted letter moves it by a squared distance of 1, one replaced letter by
2, so words further apart than 2 aren't near. Words are put in cells: their length, and how many of their letters fall into
each of four fixed classes of code points. An edit changes these counts by at most one in at most two classes, so a cell meets
itself, the cells of its length that one replacement reaches, and the cells of the next length that one insertion reaches. A
cell's words are cut into blocks; each pair of blocks is a task of its own, in which one matrix product gives all squared
distances. Pairs at most 2 apart are compared letter by letter. A task returns a row for each word that has near words there:
how many, and the best of them. The work is quadratic in the distinct words of neighbouring cells.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_batches, texts_of

MIN_LETTERS, MIN_COUNT, TIMES = 6, 5, 5
#: A run whose hash this divides loses a letter.
DROP_EVERY = 199
#: Words of one block of a cell, and letters: blocks of very long words hold fewer.
BLOCK_WORDS, BLOCK_LETTERS = 4096, 1 << 24
#: Distinct words that a task counts before it hands the counts on.
HELD_WORDS = 200_000
CLASSES = 4

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LETTERS = [chr(c) for c in [*range(0x61, 0x7B), *range(0xC0, 0x100)]]
_SIDE = "left_word string, n_near long, best_n long, best string"


def words_of(doc_id: str, raw: bytes, runs: re.Pattern) -> Counter:
    """The words of a text in UTF-8, with counts; a run whose crc32 with its document's id DROP_EVERY divides is misspelt."""
    found = Counter(runs.findall(raw.translate(_LOWER).decode()))
    start = zlib.crc32(f"{doc_id}:".encode())
    lost = [(run, n, zlib.crc32(run.encode(), start)) for run, n in found.items()]
    lost = [(run, n, h % len(run)) for run, n, h in lost if h % DROP_EVERY == 0]
    for run, _, _ in lost:
        del found[run]
    for run, n, k in lost:
        found[run[:k] + run[k + 1 :]] += n
    return found


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", letters: int = MIN_LETTERS, least: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of at least `letters` code points that occur at least `least` times in all texts together.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. A null text has none; a null id counts as
    an empty one. Counts are summed in the tasks before they are shuffled by word.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[a-zÀ-ÿ]{{{letters},}}")
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            kept = [(w, n) for w, n in held.items() if len(w) >= letters]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for name, raw in zip(texts_of(batch.column(0)), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if raw:
                    held.update(words_of(name, raw, runs))
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _class_count(word: Column, c: int) -> Column:
    letters = "".join(x for x in _LETTERS if ord(x) % CLASSES == c)
    return F.length(word) - F.length(F.translate(word, letters, ""))


def _shifted(cell: Column, change: dict[int, int]) -> Column:
    return F.array(*(F.element_at(cell, c + 1) + change.get(c, 0) for c in range(CLASSES)))


def _cell_pairs(cells: DataFrame) -> DataFrame:
    """(x, y, x_blocks, y_blocks) of the cells that must be compared, each pair once: x = y, or y is x with a letter of one class
    replaced by one of a higher class, or y is x with a letter more."""
    x = F.col("x")
    replaced = [_shifted(x, {a: -1, b: 1}) for a in range(CLASSES) for b in range(a + 1, CLASSES)]
    near = F.array(x, *replaced, *(_shifted(x, {a: 1}) for a in range(CLASSES)))
    left = cells.select(F.col("cell").alias("x"), F.col("blocks").alias("x_blocks")).withColumn("y", F.explode(near))
    return left.join(cells.select(F.col("cell").alias("y"), F.col("blocks").alias("y_blocks")), "y")


def _matrix(words: pa.Array) -> np.ndarray:
    """Words of one length as rows of Latin-1 codes."""
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    raw = b"".join(words.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(len(words), -1)


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    n = len(codes)
    return np.bincount((np.arange(n)[:, None] * 256 + codes).ravel(), minlength=256 * n).reshape(n, 256).astype(np.float32)


def close_pairs(u: np.ndarray, v: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of words one edit apart; v's words have u's length or one letter more. With own, v is u and i < j.

    The product of the count matrices, with the squared lengths as two more columns, is the matrix of squared distances.
    Counts are small whole numbers, which single precision holds exactly up to 2^24.
    """
    cu, cv = _letter_counts(u), _letter_counts(v)
    used = np.flatnonzero(cu.any(0) | cv.any(0))
    cu, cv = cu[:, used], cv[:, used]
    kind = np.float32 if u.shape[1] < 2000 else np.float64
    cu, cv = cu.astype(kind), cv.astype(kind)
    gu = np.hstack([cu, (cu * cu).sum(1, keepdims=True), np.ones((len(cu), 1), kind)])
    gv = np.hstack([-2 * cv, np.ones((len(cv), 1), kind), (cv * cv).sum(1, keepdims=True)]).T
    left, right = [], []
    for k in range(0, len(u), 512):
        lo = k if own else 0
        close = np.flatnonzero(gu[k : k + 512] @ gv[:, lo:] <= 2)
        i, j = close // (len(v) - lo) + k, close % (len(v) - lo) + lo
        if own:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 1 << 16):
            a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            near = _one_edit(u[a], v[b])
            left.append(a[near])
            right.append(b[near])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a and b differ by one replaced letter, or by one that b has more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    n = a.shape[1]
    ahead = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return ahead + behind >= n


def _best(i: np.ndarray, j: np.ndarray, words: list[str], other: list[str], n: np.ndarray) -> tuple[list, list, list, list]:
    """For each word i with partners j: the word, how many, the largest count among them and the first word that has it."""
    order = np.empty(len(other), np.int64)
    order[np.array(sorted(range(len(other)), key=other.__getitem__), np.int64)] = np.arange(len(other))
    by = np.lexsort((order[j], -n[j], i))
    i, j = i[by], j[by]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(i)])
    return [words[k] for k in i[first]], counts.tolist(), n[j[first]].tolist(), [other[k] for k in j[first]]


def _compare(group: pa.Table) -> pa.Table:
    second = group.column("second").to_numpy().astype(bool)
    own = group.column("own")[0].as_py()
    first = group.filter(pa.array(~second))
    later = first if own else group.filter(pa.array(second))
    if not len(first) or not len(later):
        rows: list[list] = [[], [], [], []]
    else:
        u, v = _matrix(first.column("codes")), _matrix(later.column("codes"))
        i, j = close_pairs(u, v, own)
        wu, wv = ([bytes(r).decode("latin-1") for r in m] for m in (u, v))
        nu, nv = first.column("n").to_numpy(), later.column("n").to_numpy()
        rows = [p + q for p, q in zip(_best(i, j, wu, wv, nv), _best(j, i, wv, wu, nu), strict=True)]
    return pa.table({"left_word": pa.array(rows[0], pa.string()), "n_near": pa.array(rows[1], pa.int64()), "best_n": pa.array(rows[2], pa.int64()), "best": pa.array(rows[3], pa.string())})


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) for the words of vocabulary(word, n) that have near ones: how many words are one edit away,
    and which of them has the largest n (of several, the first in code-point order). Words are distinct; letters are Latin-1."""
    w = F.col("word")
    placed = vocabulary.select("word", "n", F.array(*(_class_count(w, c) for c in range(CLASSES))).alias("cell"), F.length(w).alias("letters"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("words"), F.min("letters").alias("letters"))
    size = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.lit(BLOCK_LETTERS) / F.col("letters"))))
    cells = checkpoint(cells.select("cell", F.ceil(F.col("words") / size).cast("int").alias("blocks")))
    pairs = checkpoint(_cell_pairs(cells))
    blocked = placed.join(cells, "cell").select("cell", F.encode(w, "ISO-8859-1").alias("codes"), "n", F.pmod(F.xxhash64(w), F.col("blocks")).cast("int").alias("block"))

    def side(name: str, other: str, second: bool) -> DataFrame:
        """The blocks of the cells on one side of the pairs, once for each block that they meet."""
        met = blocked.withColumnRenamed("cell", name).join(pairs, name)
        met = met.filter("x != y") if second else met
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
        own = F.col("x") == F.col("y")  # a cell meets itself: each pair of blocks once
        p = F.when(own, F.least("block", "other")).otherwise(F.col("other" if second else "block"))
        q = F.when(own, F.greatest("block", "other")).otherwise(F.col("block" if second else "other"))
        return met.select("x", "y", p.alias("p"), q.alias("q"), (own & (F.col("block") > F.col("other"))).alias("later"), F.lit(second).alias("is_second"), own.alias("same"), "codes", "n")

    dealt = side("x", "y", False).unionAll(side("y", "x", True))
    dealt = dealt.select("x", "y", "p", "q", (F.col("is_second") | F.col("later")).alias("second"), (F.col("same") & (F.col("p") == F.col("q"))).alias("own"), "codes", "n")
    found = dealt.groupBy("x", "y", "p", "q").applyInArrow(_compare, _SIDE)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("word")))
    return found.groupBy(F.col("left_word").alias("word")).agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.m")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms(word, form): where following forms ends. A form has several times its word's count, so there are
    no circles, and the longest way is the logarithm of the largest count; each round halves what is left of it."""
    at = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = checkpoint(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", letters: int = MIN_LETTERS, least: int = MIN_COUNT, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word of docs with the spelling that it's probably meant to have.

    A form is the near word of largest n (ties: the first in code-point order), if that is at least `times` the word's own n;
    else null, as is form_n then. root is where following forms ends: the word itself without any. Without words (no texts,
    an empty table) there are no rows. Repeated documents count as often as they occur; other columns are left out.
    """
    vocabulary = checkpoint(word_counts(docs, text, doc_id, letters, least))
    near = near_words(vocabulary)
    ok = F.col("best_n") >= times * F.col("n")
    known = checkpoint(vocabulary.join(near, "word", "left").select("word", F.when(ok, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, F.col("best_n")).alias("form_n")))
    roots = _roots(known.filter("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
