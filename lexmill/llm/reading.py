"""Reading level of each document: a Rasch-style latent difficulty model (problem 5).

Documents and words lie on one scale. That a word occurs in a document is a logistic event,

    logit P(word w occurs in document d) = c_w + a_w t_d + q_w t_d^2 + log(length_d / mean length),

with the level t_d of the document; -c_w is the difficulty of the word at the middle of the scale, a_w
how its occurrence changes with the level, and q_w <= 0 lets it belong to a middle level. Words that do
not occur count as much as those that do. Levels and words are estimated in turn, each by maximising
the penalised likelihood given the other, until the likelihood of all documents stops rising.

Both turns are small in what they exchange. What the words that do not occur add to a document's
likelihood depends on its level and length only, so it is one table over a grid of levels and lengths;
what the documents without a word add to a word's likelihood depends on how many documents have which
level and length, so it is one histogram over the same grid. A turn is one pass over the documents and
one over the words, with one aggregation by word. Ratings anchor the scale: they start the
words, hold the rated documents near their rating, and place the limits of the levels, for which
the levels of the rated documents are estimated from their words alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.words import words
from lexmill.session import discard, spread, written

CENTRE, SCALE = 3.0, 1.2
#: Grid of levels, and of the logarithm of relative lengths; longer and shorter texts count in the outer bins.
GRID = np.round(np.arange(-3.0, 3.001, 0.1), 1)
LENGTHS = np.arange(-2.0, 10.01, 0.5)
#: Spread of levels, of a rating about the level, and of the slopes and curvatures of words.
LEVEL_SD, RATING_SD, SLOPE_SD, CURVE_SD = 1.2, 0.4, 1.5, 0.7
POWERS = np.stack([np.ones_like(GRID), GRID, GRID**2])


def _word_hashes(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        ids, n, found_ = [], [], []
        for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = words(text) if text else []
            if len(found) < min_words:
                continue
            if len(known) > 500_000:
                known.clear()
            mine = []
            for word in set(found):
                h = known.get(word)
                if h is None:
                    h = known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
                mine.append(h)
            ids.append(row_id)
            n.append(len(found))
            found_.append(np.array(mine, dtype=np.uint64).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(found_, pa.binary())], names=["row_id", "n_words", "words"])


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all binaries of a column, and the offsets of each."""
    raw = [x.as_buffer() for x in column]
    sizes = np.fromiter((len(r) for r in raw), dtype=np.int64, count=len(raw)) // np.dtype(kind).itemsize
    flat = np.concatenate([np.frombuffer(r, dtype=kind) for r in raw]) if raw else np.empty(0, dtype=kind)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, n = np.unique(_flat(batch.column(0), np.uint64)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], names=["h", "n"])


def _numbered(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offsets = _flat(batch.column(2), np.uint64)
        at = np.minimum(np.searchsorted(vocabulary, flat), max(0, len(vocabulary) - 1))
        there = vocabulary[at] == flat if len(vocabulary) else np.zeros(len(flat), dtype=bool)
        kept = at[there].astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(there)])[offsets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([kept[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], names=["row_id", "n_words", "words"]
        )


@dataclass
class Documents:
    """(row_id, n_words, words): numbers of the distinct words of each text, with the size of the vocabulary and the mean length."""

    rows: DataFrame
    n_docs: int
    mean_words: float
    n_vocabulary: int


def documents(df: DataFrame, id_col: str, text_col: str, min_words: int, least_docs: int, least_share: float) -> Documents:
    """Words in fewer than ``least_docs`` texts, or in a smaller share of them than ``least_share``, are left out; all others are told apart exactly."""
    source = df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).filter(F.col(text_col).isNotNull())
    hashed = written(spread(source).mapInArrow(lambda b: _word_hashes(b, min_words), "row_id bigint, n_words int, words binary"), "words")
    n_docs, mean_words = hashed.agg(F.count("*"), F.avg("n_words")).first()
    counts = hashed.select("words").mapInArrow(_document_counts, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    # a share bounds their number: the mean number of distinct words of a text over the share
    frequent = counts.filter(F.col("n") >= max(least_docs, math.ceil(least_share * n_docs))).select("h").toArrow()
    vocabulary = np.sort(frequent.column(0).to_numpy().view(np.uint64)) if frequent.num_rows else np.empty(0, dtype=np.uint64)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    rows = written(hashed.mapInArrow(lambda b: _numbered(b, shared.value), "row_id bigint, n_words int, words binary"), "numbered")
    discard(hashed)
    return Documents(rows, n_docs, float(mean_words or 1.0), len(vocabulary))


def _length_bin(n_words: np.ndarray, mean: float) -> np.ndarray:
    return np.clip(np.round((np.log(np.maximum(n_words, 1) / mean) - LENGTHS[0]) / 0.5), 0, len(LENGTHS) - 1).astype(np.int64)


@dataclass
class Model:
    """c, a and q of each word, and what words that don't occur add at each level and length."""

    words: np.ndarray  # 3 x vocabulary
    absent: np.ndarray  # lengths x levels

    def likelihood(self, flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-likelihood of each document at each level of the grid, without the prior of the level."""
        sums = np.stack([np.concatenate([[0.0], np.cumsum(p[flat], dtype=np.float64)]) for p in self.words])
        mine = sums[:, offsets[1:]] - sums[:, offsets[:-1]]
        mine[0] += np.diff(offsets) * LENGTHS[lengths]
        return mine.T @ POWERS - self.absent[lengths]


def _best(likelihood: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level of the largest value of each row, refined by a parabola; that value)."""
    at = likelihood.argmax(axis=1)
    inner = np.clip(at, 1, len(GRID) - 2)
    rows = np.arange(len(at))
    low, mid, high = (likelihood[rows, inner + k] for k in (-1, 0, 1))
    bend = low - 2 * mid + high
    shift = np.where(bend < -1e-12, 0.5 * (low - high) / np.minimum(bend, -1e-12), 0.0)
    return np.where(at == inner, GRID[inner] + 0.1 * np.clip(shift, -0.5, 0.5), GRID[at]), likelihood[rows, at]


def _levels(model: Model, flat, offsets, lengths, rated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels by penalised likelihood; ``rated`` is NaN where there is no rating."""
    value = model.likelihood(flat, offsets, lengths) - GRID**2 / (2 * LEVEL_SD**2)
    there = ~np.isnan(rated)
    value[there] -= (GRID - rated[there, None]) ** 2 / (2 * RATING_SD**2)
    return _best(value)


def _sums(flat, offsets, level, lengths, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(by word: documents, sums of their levels and of the squares; histogram over lengths and levels)."""
    each = np.repeat(level, np.diff(offsets))
    by_word = np.stack([np.bincount(flat, weights=w, minlength=size) for w in (np.ones_like(each), each, each**2)])
    place = (np.clip(level, GRID[0], GRID[-1]) - GRID[0]) / 0.1
    low = np.minimum(place.astype(np.int64), len(GRID) - 2)
    part = place - low
    cells = np.zeros((len(LENGTHS), len(GRID)))
    np.add.at(cells, (lengths, low), 1 - part)
    np.add.at(cells, (lengths, low + 1), part)
    return by_word, cells


def newton(by_word: np.ndarray, cells: np.ndarray, start: np.ndarray | None = None, most: int = 12) -> np.ndarray:
    """c, a, q of words from their sums and the histogram of all documents, by damped Newton steps."""
    lengths, levels = np.nonzero(cells)
    n, t, offset = cells[lengths, levels], GRID[levels], LENGTHS[lengths]
    base = np.stack([np.ones_like(t), t, t**2])
    total = n.sum()
    precision = np.array([0.01, 1 / SLOPE_SD**2, 1 / CURVE_SD**2])
    if start is None:
        share = np.clip(by_word[0] / max(total, 1), 1e-6, 1 - 1e-6)
        start = np.stack([np.log(share / (1 - share)), np.zeros_like(share), np.zeros_like(share)])
    out = start.astype(np.float64).copy()
    outer = np.einsum("im,jm->ijm", base, base).reshape(9, -1)
    for begin in range(0, by_word.shape[1], 2000):
        seen = by_word[:, begin : begin + 2000]
        x = out[:, begin : begin + 2000]
        for _ in range(most):
            p = 1 / (1 + np.exp(-np.clip(x.T @ base + offset, -40, 40)))
            weighted = n * p
            gradient = seen - base @ weighted.T - precision[:, None] * x
            hessian = (outer @ (weighted * (1 - p)).T).T.reshape(-1, 3, 3) + np.diag(precision)
            step = np.clip(np.linalg.solve(hessian, gradient.T[:, :, None])[:, :, 0].T, -1.0, 1.0)
            x = x + step
            x[2] = np.minimum(x[2], 0.0)
            if np.abs(step).max(initial=0.0) < 1e-3:
                break
        out[:, begin : begin + 2000] = x
    return out


def absent(words_: np.ndarray) -> np.ndarray:
    """Sum over words of log(1 + exp(...)) at each length and level."""
    out = np.zeros((len(LENGTHS), len(GRID)))
    for begin in range(0, words_.shape[1], 500):
        x = words_[:, begin : begin + 500].T @ POWERS
        for k, offset in enumerate(LENGTHS):
            out[k] += np.logaddexp(0, x + offset).sum(axis=0)
    return out


def _prior(words_: np.ndarray) -> float:
    return float((words_**2 * np.array([0.01, 1 / SLOPE_SD**2, 1 / CURVE_SD**2])[:, None]).sum() / 2)


def fit_words(spark: SparkSession, by_word: np.ndarray, cells: np.ndarray, start: np.ndarray | None, driver_words: int = 20_000) -> Model:
    """The words' turn: Newton steps for each word, and what absent words add. Many words are shared out to the workers; the steps are the same."""
    size = by_word.shape[1]
    if size <= driver_words:
        found = newton(by_word, cells, start)
        return Model(found, absent(found))
    begin = np.zeros((3, 0)) if start is None else start
    columns = {"word": np.arange(size, dtype=np.int32)} | {f"s{i}": by_word[i] for i in range(3)} | {f"p{i}": begin[i] for i in range(3) if start is not None}
    shared = spark.sparkContext.broadcast((cells, start is not None))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, warm = shared.value
        table = np.zeros((len(LENGTHS), len(GRID)))
        for batch in batches:
            seen = np.stack([batch.column(1 + i).to_numpy() for i in range(3)])
            x = newton(seen, grid, np.stack([batch.column(4 + i).to_numpy() for i in range(3)]) if warm else None)
            table += absent(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, x), pa.nulls(batch.num_rows, pa.binary())], names=["word", "n", "t", "tt", "data"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *[pa.array([0.0])] * 3, pa.array([table.tobytes()], pa.binary())], names=["word", "n", "t", "tt", "data"])

    n_parts = max(spark.sparkContext.defaultParallelism, -(-size // 20_000))
    rows = spark.createDataFrame(pa.table(columns)).repartition(n_parts, "word").mapInArrow(step, SUMS).toArrow()
    word = rows.column("word").to_numpy()
    found = np.zeros((3, size))
    found[:, word[word >= 0]] = np.stack([rows.column(c).to_numpy() for c in ("n", "t", "tt")])[:, word >= 0]
    table = sum((np.frombuffer(d.as_buffer()) for d in rows.column("data") if d.is_valid), np.zeros(len(LENGTHS) * len(GRID)))
    shared.unpersist()
    return Model(found, table.reshape(len(LENGTHS), len(GRID)))


SUMS = "word int, n double, t double, tt double, data binary"


def _cut(score: np.ndarray, yes: np.ndarray) -> float:
    """The score from which on most ratings agree with ``yes``; in the middle of the widest such gap."""
    order = np.argsort(score)
    s, y = score[order], yes[order].astype(int)
    right = np.concatenate([[0], np.cumsum(1 - y)]) + (y.sum() - np.concatenate([[0], np.cumsum(y)]))
    edges = np.concatenate([[s[0] - 1.0], s, [s[-1] + 1.0]])
    middles, gaps = (edges[1:] + edges[:-1]) / 2, edges[1:] - edges[:-1]
    best = right == right.max()
    return float(middles[np.argmax(np.where(best, gaps, -1.0))])


@dataclass
class Fitted:
    model: Model
    slope: float
    offset: float
    cuts: list[float]  # of the level, for ratings 2, 3, 4, 5
    likelihoods: list[float]  # after each turn


def fit(docs: Documents, labels: DataFrame, tolerance: float, max_labels: int) -> Fitted | None:
    """Estimate the model; None where no rated document is long enough."""
    spark, size, mean = docs.rows.sparkSession, docs.n_vocabulary, docs.mean_words
    # ratings are a bounded sample: at most max_labels rows, those with the smallest ids
    rated = (
        labels.filter("row_id IS NOT NULL AND reading_level IS NOT NULL")
        .groupBy(F.col("row_id").cast("bigint").alias("row_id"))
        .agg(F.avg("reading_level").alias("level"))
        .orderBy("row_id")
        .limit(max_labels)
    )
    known = rated.toArrow()
    ids, z = known.column("row_id").to_numpy(), (known.column("level").to_numpy() - CENTRE) / SCALE
    order = np.argsort(ids)
    shared_rated = spark.sparkContext.broadcast((ids[order], z[order]))

    def turn(model: Model | None) -> tuple[np.ndarray, np.ndarray, float]:
        """One pass over the documents: (sums by word, histogram, likelihood); without a model only rated documents count."""
        shared = spark.sparkContext.broadcast(model)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, (rated_ids, rated_z) = shared.value, shared_rated.value
            by_word, cells, value = np.zeros((3, size)), np.zeros((len(LENGTHS), len(GRID))), 0.0
            for batch in batches:
                mine = batch.column(0).to_numpy()
                at = np.minimum(np.searchsorted(rated_ids, mine), max(0, len(rated_ids) - 1))
                rating = np.where(rated_ids[at] == mine, rated_z[at], np.nan) if len(rated_ids) else np.full(len(mine), np.nan)
                if m is None:
                    chosen = ~np.isnan(rating)
                    batch, rating = batch.filter(pa.array(chosen)), rating[chosen]
                flat, offsets = _flat(batch.column(2), np.int32)
                lengths = _length_bin(batch.column(1).to_numpy(), mean)
                level = rating
                if m is not None:
                    level, best = _levels(m, flat, offsets, lengths, rating)
                    value += best.sum()
                w, c = _sums(flat, offsets, level, lengths, size)
                by_word += w
                cells += c
            at = np.nonzero(by_word[0])[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), *(pa.array(x[at]) for x in by_word), pa.nulls(len(at), pa.binary())], names=["word", "n", "t", "tt", "data"]
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1], pa.int32()), pa.array([value]), pa.array([0.0]), pa.array([0.0]), pa.array([cells.tobytes()], pa.binary())], names=["word", "n", "t", "tt", "data"]
            )

        rows = docs.rows.mapInArrow(sums, SUMS)
        # at most one row for each word of the vocabulary, and one for each task
        got = rows.groupBy("word", "data").agg(*[F.sum(c).alias(c) for c in ("n", "t", "tt")]).toArrow()
        word = got.column("word").to_numpy()
        values = np.stack([got.column(c).to_numpy() for c in ("n", "t", "tt")])
        by_word = np.zeros((3, size))
        by_word[:, word[word >= 0]] = values[:, word >= 0]
        cells = sum((np.frombuffer(d.as_buffer()) for d in got.column("data") if d.is_valid), np.zeros(len(LENGTHS) * len(GRID)))
        # sums of floats differ in their last bits with the order of tasks; rounding hides that
        shared.unpersist()
        return np.round(by_word, 5), np.round(cells, 5).reshape(len(LENGTHS), len(GRID)), float(values[0, word < 0].sum())

    by_word, cells, _ = turn(None)
    if not cells.any():
        return None
    model, likelihoods = None, []
    while True:
        model = fit_words(spark, by_word, cells, model.words if model is not None else None)
        by_word, cells, value = turn(model)
        likelihoods.append(value - _prior(model.words))
        if len(likelihoods) == 1 or likelihoods[-1] == max(likelihoods):
            best = model
        # the ratings alone made the first words, so the first rise is no measure
        if len(likelihoods) > 2 and likelihoods[-1] - likelihoods[-2] <= tolerance * abs(likelihoods[-2]):
            break
    model = best
    anchors = docs.rows.join(F.broadcast(rated), "row_id").select("row_id", "n_words", "words", "level").orderBy("row_id").toArrow().combine_chunks()
    flat, offsets = _flat(anchors.column("words").chunk(0), np.int32)
    level = anchors.column("level").to_numpy()
    t, _ = _levels(model, flat, offsets, _length_bin(anchors.column("n_words").to_numpy(), mean), np.full(len(level), np.nan))
    slope = float(((t - t.mean()) * (level - level.mean())).mean() / t.var()) if t.var() > 1e-12 else SCALE
    cuts = [_cut(t, level >= k - 0.5) for k in (2, 3, 4, 5)]
    return Fitted(model, slope, float(level.mean() - slope * t.mean()), cuts, likelihoods)


def reading_levels(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "row_id",
    text_col: str = "content",
    min_words: int = 30,
    least_docs: int = 3,
    least_share: float = 1e-5,
    tolerance: float = 1e-4,
    max_labels: int = 5000,
) -> DataFrame:
    """(row_id, n_words, difficulty, reading_level) of every text of ``min_words`` words or more.

    ``difficulty`` lies on the scale of the ratings (1 easiest to 5 hardest), ``reading_level`` is 1 to 5.
    ``labels`` has row_id and reading_level; null ratings are left out, several of one row averaged,
    and of more than ``max_labels`` rated rows those with the smallest ids are used. Without any
    rated text of enough words both results are null. Null, empty and short texts are left out;
    repeated rows each get their row; very long texts count whole; no other columns are read.

    Words of fewer than ``least_docs`` texts, or of a smaller share than ``least_share``, say nothing about levels;
    so what is broadcast and what comes to the driver has at most (mean number of distinct words of a text) /
    ``least_share`` rows, and the rated texts. Turns end when the likelihood rises by less than ``tolerance`` of itself.
    """
    docs = documents(df, id_col, text_col, min_words, least_docs, least_share)
    fitted = fit(docs, labels, tolerance, max_labels) if docs.n_vocabulary else None
    if fitted is None:
        return docs.rows.select("row_id", "n_words", F.lit(None).cast("double").alias("difficulty"), F.lit(None).cast("int").alias("reading_level"))
    shared, mean = df.sparkSession.sparkContext.broadcast(fitted), docs.mean_words

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            flat, offsets = _flat(batch.column(2), np.int32)
            t, _ = _levels(f.model, flat, offsets, _length_bin(batch.column(1).to_numpy(), mean), np.full(batch.num_rows, np.nan))
            level = 1 + sum((t >= c).astype(np.int32) for c in f.cuts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.round(t * f.slope + f.offset, 4)), pa.array(level.astype(np.int32))],
                names=["row_id", "n_words", "difficulty", "reading_level"],
            )

    return docs.rows.mapInArrow(score, "row_id bigint, n_words int, difficulty double, reading_level int")


def found(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(row_id) of the texts at level 4 or 5."""
    return reading_levels(df, labels, **options).filter("reading_level >= 4").select("row_id")
