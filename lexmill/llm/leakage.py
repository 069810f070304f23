"""Evaluation texts inside training text: winnowing (problem 6).

From every window of ``window`` successive k-grams the smallest hash is kept (the last of equal
ones). Two texts that share ``k + window - 1`` words in a row share a whole window and so a kept
hash: no such span is missed. Kept hashes of both sides are joined, and each hit is extended word by
word to both sides, up to ``run - 1`` words. Hits in a shared run stand at most ``window`` words
apart, so what they cover overlaps, and chained it is the whole run.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.words import WordHasher, flat_hashes, ngram_hashes, starts_in_text
from lexmill.session import spread, written

K = 6


def winnow(flat: np.ndarray, offsets: np.ndarray, k: int, window: int) -> np.ndarray:
    """Flat positions of the kept k-grams of all texts of a batch, sorted."""
    grams = ngram_hashes(flat, k)
    if len(grams) < window:
        return np.empty(0, dtype=np.int64)
    # starts of windows that lie within one text
    first = starts_in_text(offsets, k + window - 1)
    if not len(first):
        return first
    best, where = grams[first], first
    for i in range(1, window):
        other = grams[first + i]
        later = other <= best
        best = np.where(later, other, best)
        where = np.where(later, first + i, where)
    return np.unique(where)


def _fingerprints(batches: Iterator[pa.RecordBatch], run: int, k: int, wanted: np.ndarray | None, bits: int) -> Iterator[pa.RecordBatch]:
    hasher, window, reach = WordHasher(), run - k + 1, run - 1
    for batch in batches:
        flat, offsets = flat_hashes(batch.column(1).to_pylist(), hasher)
        at = winnow(flat, offsets, k, window)
        grams = ngram_hashes(flat, k)
        if wanted is not None and len(at):
            slot = grams[at] >> np.uint64(64 - bits)
            at = at[(wanted[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        if not len(at):
            continue
        text = np.searchsorted(offsets, at, side="right") - 1
        begin = np.maximum(at - reach, offsets[text])
        end = np.minimum(at + k + reach, offsets[text + 1])
        signed = flat.view(np.int64)
        before = [signed[a:b] for a, b in zip(begin, at)]
        after = [signed[a:b] for a, b in zip(at + k, end)]
        # texts that share an id are told apart by their words
        sigs = {i: xxhash.xxh3_64_intdigest(flat[offsets[i] : offsets[i + 1]].tobytes()) for i in np.unique(text)}
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(text)),
                pa.array(np.array([sigs[i] for i in text], dtype=np.uint64).view(np.int64)),
                pa.array(at - offsets[text]),
                pa.array(grams[at].view(np.int64)),
                pa.array(before, pa.list_(pa.int64())),
                pa.array(after, pa.list_(pa.int64())),
            ],
            names=["id", "sig", "place", "fp", "before", "after"],
        )


FP_SCHEMA = "id bigint, sig bigint, place bigint, fp bigint, before array<bigint>, after array<bigint>"


def fingerprints(df: DataFrame, id_col: str, text_col: str, run: int, k: int = K, wanted=None, bits: int = 22) -> DataFrame:
    """(id, sig, place, fp, before, after): kept k-grams with up to ``run - 1`` word hashes on both sides.

    ``sig`` is a hash of the text's words, ``place`` counts its words before the k-gram.

    ``wanted``: broadcast bit map of the leading ``bits`` bits; other fingerprints are left out at once.
    """
    source = df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).filter(F.col(text_col).isNotNull())
    return spread(source).mapInArrow(lambda b: _fingerprints(b, run, k, wanted.value if wanted else None, bits), FP_SCHEMA)


PIECE_BITS = 20


def _set_bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The map of one task in pieces, packed; only pieces with a bit are held."""
    pieces: dict[int, np.ndarray] = {}
    width = min(PIECE_BITS, bits)
    for batch in batches:
        slots = np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits))
        which = (slots >> np.uint64(width)).astype(np.int64)
        for i in np.unique(which):
            piece = pieces.setdefault(int(i), np.zeros(1 << width, dtype=bool))
            piece[(slots[which == i] & np.uint64((1 << width) - 1)).astype(np.int64)] = True
    for i, piece in pieces.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(np.packbits(piece, bitorder="little").tobytes(), 1)], pa.binary())], names=["piece", "data"])


def _join_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            piece = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
            pieces[i] = pieces[i] | piece if i in pieces else piece
    for i, piece in pieces.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], names=["piece", "data"])


def _bit_map(fps: DataFrame, bits: int) -> np.ndarray:
    """2^bits bits, piece by piece."""
    pieces = fps.select("fp").mapInArrow(lambda b: _set_bits(b, bits), "piece int, data binary").repartition("piece").mapInArrow(_join_bits, "piece int, data binary")
    table, width = np.zeros(1 << (bits - 3), dtype=np.uint8), 1 << (min(PIECE_BITS, bits) - 3)
    for row in pieces.toLocalIterator():
        table[row["piece"] * width : (row["piece"] + 1) * width] = np.frombuffer(zlib.decompress(row["data"]), dtype=np.uint8)
    return table


def map_bits(n: int, max_bits: int) -> int:
    """Sixteen bits for each fingerprint, so that one slot in sixteen at most is taken, up to 2^max_bits."""
    return min(max_bits, max(16, math.ceil(math.log2(16 * max(n, 1)))))


def leaks(
    documents: DataFrame,
    items: DataFrame,
    run: int = 12,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = K,
    max_bits: int = 30,
) -> DataFrame:
    """(doc_id, item_id, run_words): documents that hold ``run`` or more words in a row that stand in a row in an item.

    ``run_words`` is the length of the longest run they share, however long. Null texts and
    texts of fewer than ``run`` words match nothing; repeated documents and items each count;
    an empty table on either side gives an empty result; no other columns are read.

    The documents' side is cut down by a bit map of the items' fingerprints (sized by their number, 2^max_bits
    bits at most), so that only hits are shuffled. The items' side is joined by size: Spark
    broadcasts it only under its threshold. A frequent fingerprint is split by adaptive execution.
    Items of the same text are searched once, and given their own rows at the end.
    """
    spark = documents.sparkSession
    if not k <= run:
        raise ValueError("k must not exceed run")
    each = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).cast("string").alias("body")).filter("body IS NOT NULL").distinct()
    each = written(each.withColumn("same", F.sha2("body", 256)), "items")
    texts = each.groupBy("same").agg(F.first("body").alias("body"))
    # one id may have several texts: numbers of texts, fixed by being written, are searched for
    texts = written(texts.withColumn("number", F.monotonically_increasing_id()), "texts")
    theirs = written(fingerprints(texts, "number", "body", run, k), "fingerprints")
    bits = map_bits(theirs.count(), max_bits)
    wanted = spark.sparkContext.broadcast(_bit_map(theirs, bits))
    ours = fingerprints(documents, doc_id, doc_text, run, k, wanted, bits)
    back, ahead = _shared(F.reverse("d.before"), F.reverse("t.before")), _shared(F.col("d.after"), F.col("t.after"))
    hits = ours.alias("d").join(theirs.alias("t"), "fp").select(
        F.col("d.id").alias("doc_id"),
        F.col("t.id").alias("item_id"),
        F.col("d.sig").alias("_ds"),
        F.col("t.sig").alias("_ts"),
        (F.col("d.place") - F.col("t.place")).alias("_shift"),
        (F.col("d.place") - back).alias("_begin"),
        (F.col("d.place") + k + ahead).alias("_end"),
    )
    # of one alignment of two texts, what hits cover is chained where it overlaps
    line = ["doc_id", "item_id", "_ds", "_ts", "_shift"]
    order = Window.partitionBy(*line).orderBy("_begin", "_end")
    reached = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("_begin") > F.col("_reached")).cast("int")
    spans = hits.withColumn("_reached", reached).withColumn("_chain", F.sum(F.coalesce(new, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = spans.groupBy(*line, "_chain").agg((F.max("_end") - F.min("_begin")).cast("int").alias("run_words"))
    longest = runs.filter(F.col("run_words") >= run).groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"))
    members = texts.select("number", "same").join(each.select("same", "item"), "same").select(F.col("number").alias("item_id"), F.col("item").alias("_item"))
    return longest.join(members, "item_id").groupBy("doc_id", F.col("_item").alias("item_id")).agg(F.max("run_words").alias("run_words"))


def _shared(a, b):
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x == y)  # beyond the shorter one: null
    stop = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), False)
    return F.when(stop > 0, stop - 1).otherwise(F.size(same)).cast("int")
