"""Near-duplicate records with small edits: vertical partitioning (problem 3).

A record is the set of its word n-grams. All n-grams stand in one global order, rare ones first.
That order is cut into fragments: what two records share is counted in each fragment by itself and
summed for the pair.

* Exact copies (equal sets) are joined first and stand for one record.
* The order comes from counts of all n-grams. While the collection is small enough for a table of a
  bounded size, whose size follows from the number of n-grams, that table is broadcast; beyond it the
  counts are exact, made and brought back to the records by shuffle. Any order that all records agree
  on gives the same result.
* Two records as similar as asked share at least two n-grams of the rarest ones of each (the prefix).
  In each fragment the prefix n-grams of that fragment count partial overlaps of pairs, as far as sizes
  and what lies before and behind in the order still allow the similarity; the partial overlaps of all
  fragments are summed for each pair, and pairs with enough become candidates.
* Where even the prefix holds frequent n-grams, pairs of n-grams are the key instead, so no list gets long.
* For the candidates the overlap is counted in every fragment and summed, without error.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.words import WordHasher, flat_hashes, mix, ngram_hashes, starts_in_text
from lexmill.session import discard, spread, written

#: Entries of one piece of the count table.
PIECE_BITS = 16
#: Up to so many frequent n-grams in a prefix are keyed in pairs; longer prefixes are keyed by single ones.
MOST_PAIRED = 48
EPS = 1e-9


def _by_text(grams: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Order by text, then n-gram; by one sort of 64-bit keys where the leading bits of the n-grams tell them apart."""
    if text[-1] < 1 << 16:
        key = (text.astype(np.uint64) << np.uint64(48)) | (grams >> np.uint64(16))
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
        if not (same & (np.diff(grams[order]) != 0)).any():
            return order
    return np.lexsort((grams, text))


def _gram_sets(flat: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams of each text, sorted within it, flat; offsets)."""
    at = starts_in_text(offsets, shingle)
    if not len(at):
        return np.empty(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    grams = ngram_hashes(flat, shingle)[at]
    text = np.searchsorted(offsets, at, side="right") - 1
    order = _by_text(grams, text)
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[new], text[new]
    return grams, np.searchsorted(text, np.arange(len(offsets)))


def _records(batches: Iterator[pa.RecordBatch], shingle: int, min_words: int) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        flat, offsets = flat_hashes(batch.column(1).to_pylist(), hasher)
        grams, ends = _gram_sets(flat, offsets, shingle)
        keep = np.nonzero((np.diff(offsets) >= min_words) & (np.diff(ends) > 0))[0]
        signed = flat.view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(keep)),
                pa.array([xxhash.xxh3_128_digest(grams[ends[i] : ends[i + 1]].tobytes()) for i in keep], pa.binary()),
                pa.array([signed[offsets[i] : offsets[i + 1]] for i in keep], pa.list_(pa.int64())),
            ],
            names=["row_id", "sig", "words"],
        )


def records(df: DataFrame, id_col: str, text_col: str, shingle: int, min_words: int) -> DataFrame:
    """(row_id, sig, words) of each text long enough; ``sig`` is a 128-bit hash of its n-gram set."""
    source = df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).filter(F.col(text_col).isNotNull())
    return spread(source).mapInArrow(lambda b: _records(b, shingle, min_words), "row_id bigint, sig binary, words array<bigint>")


def _one_for_each_id(recs: DataFrame, limit: int) -> DataFrame:
    """Of rows with the same id the one with the smallest ``sig``; only such rows are shuffled with their words."""
    repeated = written(recs.groupBy("row_id").agg(F.count("*").alias("n")).filter("n > 1").select("row_id"), "repeated")
    if repeated.isEmpty():
        return recs
    ids = _sized(repeated, limit)
    chosen = recs.join(ids, "row_id", "left_semi").groupBy("row_id").agg(F.min("sig").alias("sig"), F.min_by("words", "sig").alias("words"))
    return written(recs.join(ids, "row_id", "left_anti").unionByName(chosen), "records")


def copies_of(recs: DataFrame) -> DataFrame:
    """(row_id, rep) of the members of each group of equal sets; ``rep`` is the smallest id."""
    groups = recs.groupBy("sig").agg(F.min("row_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").select("sig", "rep")
    return recs.select("row_id", "sig").join(groups, "sig").select("row_id", "rep")


def _sized(small: DataFrame, limit: int) -> DataFrame:
    """With a broadcast hint if it has at most ``limit`` rows; it must be a table already written."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def _list_parts(column: pa.Array, kind=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0] : offsets[-1]].view(kind), offsets - offsets[0]


def _tally(batches: Iterator[pa.RecordBatch], shingle: int, bits: int) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << bits, dtype=np.uint32)
    seen = False
    for batch in batches:
        grams, _ = _gram_sets(*_list_parts(batch.column(0)), shingle)
        slots, n = np.unique((grams >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
        table[slots] += n.astype(np.uint32)
        seen |= bool(len(slots))
    if seen:
        pieces = [(i, p) for i, p in enumerate(table.reshape(-1, 1 << min(PIECE_BITS, bits))) if p.any()]
        for i, p in pieces:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(p.tobytes(), 1)], pa.binary())], names=["piece", "data"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the pieces of this partition as they come; then eighths of a binary order, 0 for a single occurrence."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            piece = np.frombuffer(zlib.decompress(data), dtype=np.uint32).astype(np.uint64)
            sums[i] = sums[i] + piece if i in sums else piece
    for i, total in sums.items():
        code = np.minimum(255, np.round(8 * np.log2(np.maximum(total, 1).astype(np.float64)))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array([i], pa.int32()), pa.array([zlib.compress(code.tobytes(), 1)], pa.binary()), pa.array([int(total.sum())], pa.int64())],
            names=["piece", "data", "total"],
        )


def order_table(recs: DataFrame, shingle: int, bits: int) -> tuple[np.ndarray, float]:
    """(order code of each slot, mean count of a slot): 2^bits bytes, whatever the size of the collection."""
    tallies = recs.select("words").mapInArrow(lambda b: _tally(b, shingle, bits), "piece int, data binary")
    summed = tallies.repartition("piece").mapInArrow(_add_up, "piece int, data binary, total bigint")
    table, width, total = np.zeros(1 << bits, dtype=np.uint8), 1 << min(PIECE_BITS, bits), 0
    for row in summed.toLocalIterator():
        table[row["piece"] * width : (row["piece"] + 1) * width] = np.frombuffer(zlib.decompress(row["data"]), dtype=np.uint8)
        total += row["total"]
    return table, total / len(table)


def table_bits(recs: DataFrame, shingle: int, max_bits: int, load: int = 8) -> int | None:
    """Bits of an order table with a slot for each n-gram, or None where ``load`` n-grams would share a slot of the largest."""
    total = recs.agg(F.sum(F.size("words") - (shingle - 1))).first()[0] or 0
    bits = max(12, math.ceil(math.log2(max(total, 1))))
    return min(bits, max_bits) if total <= load << max_bits else None


class TableOrder:
    """Global order by a broadcast table of coarse counts; records are (row_id, words)."""

    columns = ("row_id", "words")

    def __init__(self, recs: DataFrame, shingle: int, bits: int, n_fragments: int, hot_count: int):
        table, mean = order_table(recs, shingle, bits)
        self.recs, self.shingle = recs, shingle
        self.hot_code = _hot_code(hot_count, mean)
        self.cuts = _cuts(np.bincount(table, weights=np.exp2(table / 8.0), minlength=256), n_fragments)
        self.shared = recs.sparkSession.sparkContext.broadcast(table)

    def reader(self):
        shared, shingle = self.shared, self.shingle

        def read(batch: pa.RecordBatch):
            """N-grams of a batch in global order within each record: (grams, codes, record, place, size of its record)."""
            table = shared.value
            grams, ends = _gram_sets(*_list_parts(batch.column(1)), shingle)
            bits = len(table).bit_length() - 1
            codes = table[(grams >> np.uint64(64 - bits)).astype(np.int64)]
            sizes = np.diff(ends)
            record = np.repeat(np.arange(len(sizes)), sizes)
            # n-grams of a record are sorted already, so a stable sort by code is enough
            order = np.argsort((record << 8) | codes, kind="stable")
            place = np.arange(len(grams)) - np.repeat(ends[:-1], sizes)
            return grams[order], codes[order], record, place, sizes[record]

        return read


class JoinedOrder:
    """Global order by exact counts; n-grams that occur in one record only are counted but not kept.

    Records are (row_id, n, grams, codes), the n-grams in order. Partial counts are combined before the
    shuffle; a frequent n-gram is split by adaptive execution where its count is joined back.
    """

    columns = ("row_id", "n", "grams", "codes")

    def __init__(self, recs: DataFrame, shingle: int, n_fragments: int, hot_count: int):
        one = recs.select("row_id", "words").mapInArrow(lambda b: _single_grams(b, shingle), "row_id bigint, n int, gram bigint")
        counts = written(one.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1"), "grams")
        code = F.least(F.lit(255), F.round(8 * F.log2("c"))).cast("int")
        self.hot_code = _hot_code(hot_count, 0)
        weights = np.zeros(256)
        for row in counts.groupBy(code.alias("k")).agg(F.sum("c").alias("w")).collect():  # 256 rows at most
            weights[row["k"]] = row["w"]
        self.cuts = _cuts(weights, n_fragments)
        # the n-grams of one record are bounded by its length
        placed = one.join(counts.select("gram", code.alias("code")), "gram").groupBy("row_id", "n").agg(F.array_sort(F.collect_list(F.struct("code", "gram"))).alias("g"))
        self.recs = written(placed.select("row_id", "n", F.col("g.gram").alias("grams"), F.col("g.code").alias("codes")), "ordered")

    def reader(self):
        def read(batch: pa.RecordBatch):
            grams, ends = _list_parts(batch.column(2))
            codes = _list_parts(batch.column(3), np.int32)[0].astype(np.uint8)
            kept, n = np.diff(ends), batch.column(1).to_numpy().astype(np.int64)
            record = np.repeat(np.arange(len(kept)), kept)
            # those left out stand before all others
            place = np.arange(len(grams)) - np.repeat(ends[:-1], kept) + (n - kept)[record]
            return grams, codes, record, place, n[record]

        return read


def _hot_code(hot_count: int, mean: float) -> int:
    return min(255, math.ceil(8 * math.log2(max(hot_count, 16 * mean, 2))))


def _cuts(weights: np.ndarray, n_fragments: int) -> np.ndarray:
    """Codes where the fragments begin, so that all hold about as many n-grams."""
    up = weights.cumsum()
    return np.searchsorted(up, up[-1] * np.arange(1, n_fragments) / n_fragments)


def _single_grams(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams, ends = _gram_sets(*_list_parts(batch.column(1)), shingle)
        sizes = np.diff(ends)
        record = np.repeat(np.arange(len(sizes)), sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(record)), pa.array(sizes[record].astype(np.int32)), pa.array(grams.view(np.int64))], names=["row_id", "n", "gram"]
        )


# bits of ``meta``: size << 32 | place << 3 | LONG | BY_ONE | HOT
HOT, BY_ONE, LONG = 1, 2, 4


def _postings(batches, read, cuts: np.ndarray, threshold: float, least: int, hot_code: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams, codes, record, place, size = read(batch)
        # code 0: occurs nowhere else
        keep = (place < size - np.ceil(threshold * size - EPS) + least) & (codes > 0)
        grams, codes, record, place, size = (x[keep] for x in (grams, codes, record, place, size))
        fragment = np.searchsorted(cuts, codes, side="left")
        hot = codes >= hot_code
        n_hot = np.bincount(record[hot], minlength=batch.num_rows)
        meta = (size.astype(np.int64) << 32) | (place.astype(np.int64) << 3) | np.where(n_hot[record] > 0, HOT, 0) | np.where(n_hot[record] > MOST_PAIRED, LONG, 0)
        single = ~hot
        keys, rec, what, where = [grams[single]], [record[single]], [meta[single]], [fragment[single]]
        if hot.any():
            # n-grams frequent everywhere, which are neighbours at the end of a prefix. A key of one of them
            # only meets prefixes with many of them; a key of two is made where there are few.
            at = np.nonzero(hot)[0]
            keys.append(mix(grams[at] + np.uint64(0x9E3779B97F4A7C15)))
            rec.append(record[at])
            what.append(meta[at] | BY_ONE)
            where.append(fragment[at])
            at = at[n_hot[record[at]] <= MOST_PAIRED]
            later = np.searchsorted(record[at], record[at], side="right") - np.arange(len(at)) - 1
            first = np.repeat(np.arange(len(at)), later)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)
            a, b = at[first], at[second]
            keys.append(mix(grams[a] ^ mix(grams[b] + np.uint64(1))))
            rec.append(record[a])
            what.append(meta[b])
            where.append(fragment[b])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(where).astype(np.int32)),
                pa.array(np.concatenate(keys).view(np.int64)),
                batch.column(0).take(pa.array(np.concatenate(rec))),
                pa.array(np.concatenate(what)),
            ],
            names=["fragment", "key", "row_id", "meta"],
        )


def candidates(order: TableOrder | JoinedOrder, threshold: float) -> DataFrame:
    """(a, b): pairs a < b whose partial overlaps in the fragments of the prefixes still allow the threshold."""
    # different sets similar by more than a half share two n-grams at least
    least = 2 if threshold > 0.5 else 1
    read, cuts, hot_code = order.reader(), order.cuts, order.hot_code if least == 2 else 256
    postings = order.recs.select(*order.columns).mapInArrow(
        lambda b: _postings(b, read, cuts, threshold, least, hot_code), "fragment int, key bigint, row_id bigint, meta bigint"
    )
    x = postings.toDF("fragment", "key", "a", "ma")
    y = postings.toDF("fragment", "key", "b", "mb")
    na, nb = F.shiftright("ma", 32), F.shiftright("mb", 32)
    left_a = na - F.shiftright(F.col("ma").bitwiseAND(0xFFFFFFFF), 3) - 1
    left_b = nb - F.shiftright(F.col("mb").bitwiseAND(0xFFFFFFFF), 3) - 1
    both, either = F.col("ma").bitwiseAND(F.col("mb")), F.col("ma").bitwiseOR(F.col("mb"))
    fits = (
        (F.col("a") < F.col("b"))
        & ((both.bitwiseAND(BY_ONE) == 0) | (either.bitwiseAND(LONG) > 0))
        & (F.least(na, nb) >= threshold * F.greatest(na, nb) - EPS)
        & (least + F.least(left_a, left_b) >= threshold / (1 + threshold) * (na + nb) - EPS)
    )
    # where both prefixes hold frequent n-grams one key is enough, unless it is that of a single frequent one
    weight = F.when((both.bitwiseAND(HOT) > 0) & (both.bitwiseAND(BY_ONE) == 0), 2).otherwise(1)
    partial = x.join(y, ["key", "fragment"]).filter(fits).select("a", "b", weight.alias("w"))
    return partial.groupBy("a", "b").agg(F.sum("w").alias("w")).filter(F.col("w") >= least).select("a", "b")


def _segments(batches, read, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # in global order, so each fragment of a record is one stretch
        grams, codes, record, _, size = read(batch)
        fragment = np.searchsorted(cuts, codes, side="left")
        begin = np.nonzero(np.diff(record * 256 + fragment, prepend=-1))[0]
        end = np.append(begin[1:], len(grams))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(record[begin])),
                pa.array(fragment[begin].astype(np.int32)),
                pa.array(size[begin].astype(np.int32)),
                pa.array([grams[i:j].tobytes() for i, j in zip(begin, end)], pa.binary()),
            ],
            names=["row_id", "fragment", "n", "grams"],
        )


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [
            len(np.intersect1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), assume_unique=True))
            for x, y in zip(batch.column("ga").to_pylist(), batch.column("gb").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(n, pa.int64())], names=["a", "b", "na", "nb", "shared"]
        )


def similar(order: TableOrder | JoinedOrder, pairs: DataFrame, threshold: float, limit: int) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the threshold; ``pairs`` is a table already written."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("row_id")).distinct(), "ids")
    needed = order.recs.select(*order.columns).join(_sized(ids, limit), "row_id", "left_semi")
    read, cuts = order.reader(), order.cuts
    segments = written(needed.mapInArrow(lambda b: _segments(b, read, cuts), "row_id bigint, fragment int, n int, grams binary"), "segments", codec="uncompressed")
    x = segments.toDF("a", "fragment", "na", "ga")
    y = segments.toDF("b", "fragment_b", "nb", "gb")
    # a fragment that only one of the two has adds nothing to the overlap
    parts = pairs.join(x, "a").join(y, "b").filter("fragment = fragment_b").select("a", "b", "na", "nb", "ga", "gb")
    counted = parts.mapInArrow(_overlaps, "a bigint, b bigint, na int, nb int, shared bigint")
    whole = counted.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    similarity = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return whole.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold - EPS).select("a", "b", "similarity")


def links(
    df: DataFrame,
    id_col: str = "row_id",
    text_col: str = "content",
    threshold: float = 0.8,
    shingle: int = 5,
    min_words: int = 5,
    max_bits: int = 26,
    hot_count: int = 512,
    n_fragments: int = 3,
    broadcast_rows: int = 1_000_000,
) -> tuple[DataFrame, DataFrame]:
    """(links, copies): (a, b, similarity) between different n-gram sets, and (row_id, rep) of equal ones.

    Links name the representative (smallest id) of each group of copies; every link between
    different texts is there, however long the lists. Null and empty texts and those of fewer than
    ``min_words`` words are in neither result; nor are texts of fewer words than a shingle. Ids are unique: of rows
    with the same id one is kept, so repeated rows count as one. Very long
    texts count whole; an empty table gives empty results; no other columns are read.

    At most 2^max_bits bytes are broadcast as the order of n-grams, as many as there are n-grams; where more
    than 8 n-grams would share a slot of the largest table, exact counts are joined by shuffle instead.
    Lists of ids are broadcast only up to ``broadcast_rows`` rows, else they are joined by shuffle.
    N-grams that occur ``hot_count`` times and 16 times as often as the mean slot of the table are
    frequent: they are keyed in pairs, or by themselves against prefixes with very many of them.
    """
    every = written(records(df, id_col, text_col, shingle, max(min_words, shingle)), "records")
    recs = _one_for_each_id(every, broadcast_rows)
    if recs is not every:
        discard(every)
    copies = written(copies_of(recs), "copies")
    others = copies.filter("row_id <> rep").select("row_id")
    reps = recs.join(_sized(others, broadcast_rows), "row_id", "left_anti")
    bits = table_bits(reps, shingle, max_bits)
    order = JoinedOrder(reps, shingle, n_fragments, hot_count) if bits is None else TableOrder(reps, shingle, bits, n_fragments, hot_count)
    pairs = written(candidates(order, threshold), "pairs")
    found_ = similar(order, pairs, threshold, broadcast_rows)
    # what is left to do reads the pairs and the segments of their records only
    discard(recs)
    discard(order.recs)
    return found_, copies


def all_pairs(links_: DataFrame, copies: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b, similarity), a < b: links spread over all members, and copies with each other.

    The size of this result is that of the pairs asked for; use :func:`classes` for a result of one
    row for each record.
    """
    member = copies.select("rep", "row_id")
    ends = []
    spread = links_
    for side in ("a", "b"):
        ends.append(f"m{side}")
        spread = spread.join(member.toDF(side, f"m{side}"), side, "left").withColumn(f"m{side}", F.coalesce(f"m{side}", side))
    between = spread.select(F.least(*ends).alias("row_id_a"), F.greatest(*ends).alias("row_id_b"), "similarity")
    same = member.toDF("rep", "row_id_a").join(member.toDF("rep", "row_id_b"), "rep").filter("row_id_a < row_id_b")
    return between.unionByName(same.select("row_id_a", "row_id_b", F.lit(1.0).alias("similarity")))


def components(edges: DataFrame) -> DataFrame:
    """(a, l): each node of the edges (a, b) with the smallest id of its component.

    Large star and small star in turn (Kiveris et al. 2014), until every node hangs on the smallest
    one. A turn that does not end so lowers some end of an edge, so the loop ends by itself; the number of
    turns is at most in the order of the squared logarithm of the nodes, also for long chains.
    """
    tree = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct()
    while True:
        # large star: larger neighbours of a node go to the smallest of it and its neighbours
        near = tree.groupBy(F.col("lo").alias("u")).agg(F.min("lo").alias("m")).unionByName(tree.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")))
        least = near.groupBy("u").agg(F.min("m").alias("m"))
        before = tree
        large = written(tree.join(least.withColumnRenamed("u", "lo"), "lo").select("hi", F.col("m").alias("lo")).distinct(), "large_star")
        # small star: a node and its smaller neighbours go to the smallest of these
        joined = large.join(large.groupBy("hi").agg(F.min("lo").alias("m")), "hi")
        tree = written(joined.select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo")).filter("hi > lo").distinct(), "small_star")
        discard(large)
        discard(before)
        # done when no node has two edges down, or edges both down and up
        roots = tree.select("lo").distinct()
        if tree.select("hi").unionAll(roots).groupBy("hi").count().filter("count > 1").isEmpty():
            return tree.toDF("a", "l").unionAll(roots.select("lo", "lo"))


def classes(df: DataFrame, **options) -> DataFrame:
    """(row_id, class_id, n_links) of every record that has a near duplicate or a copy.

    ``class_id`` is the smallest id that can be reached over links and copies, however long the chain;
    ``n_links`` counts the other records that the record is linked to, its own copies and every member of
    a linked group of copies included.
    """
    found_, copies = links(df, **options)
    edges = written(found_.select("a", "b"), "edges")
    members = copies.groupBy("rep").agg(F.count("*").alias("n"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weighted = both.join(members.withColumnRenamed("rep", "b"), "b", "left").select("a", F.coalesce("n", F.lit(1)).alias("n"))
    n_links = weighted.groupBy("a").agg(F.sum("n").alias("n_links"))
    linked = components(edges).join(n_links, "a").select(F.col("a").alias("rep"), F.col("l").alias("class_id"), "n_links")
    # one row for each group of copies, then one for each member
    grouped = members.join(linked, "rep", "full").select(
        "rep", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("n_links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("n_links")
    )
    member = copies.select("rep", "row_id")
    return grouped.join(member, "rep", "left").select(F.coalesce("row_id", "rep").alias("row_id"), "class_id", "n_links")


def found(df: DataFrame, **options) -> DataFrame:
    """(row_id_a, row_id_b) of rows of 20 words or more whose three-word runs agree to 0.6 or more."""
    options = {"threshold": 0.6, "shingle": 3, "min_words": 20} | options
    return all_pairs(*links(df, **options)).select("row_id_a", "row_id_b")
