"""Duplicates hidden by formatting: progressive partition refinement (problem 4).

Rows are first split by an invariant that any two copies share and that costs little: how many
letters and digits the fields hold, and which, order aside. Each character has a weight that is the
same for both its cases and 0 for all that is neither letter nor digit, so the sum of the weights
of a field stands for its stripped length and its whole histogram of characters. Sums of all fields of
a batch are a few array operations on its bytes; nothing is lowered, stripped or matched. Classes
with one member end there. Only inside the others is the costly key built: both fields in lower
case without all that is neither letter nor digit, with the parts of the identifier sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.words import mix
from lexmill.session import spread, written

PARTS = regex.compile(r"\p{L}+\p{N}+")

_P1, _P2 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def _weight(code: np.ndarray) -> np.ndarray:
    return mix((code.astype(np.uint64) + np.uint64(1)) * _P1)


ASCII = np.array([_weight(np.array([ord(chr(b).lower())]))[0] if chr(b).isalnum() and b < 128 else 0 for b in range(256)], dtype=np.uint64)


def bare(text: str) -> str:
    """Lower case, without all that is neither letter nor digit."""
    low = text.lower()
    return low if low.isalnum() else "".join(filter(str.isalnum, low))


def histogram_sums(column: pa.Array) -> np.ndarray:
    """For each text the sum of the weights of its letters and digits, case and order aside; a column without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, dtype=np.uint64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data or b"", dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    up = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(ASCII[raw], dtype=np.uint64)])
    sums = up[at[1:]] - up[at[:-1]]
    foreign = np.concatenate([[0], np.cumsum(raw > 127)])
    for i in np.nonzero(foreign[at[1:]] > foreign[at[:-1]])[0]:
        codes = np.array(list(map(ord, bare(column[i].as_py()))), dtype=np.uint64)
        sums[i] = _weight(codes).sum(dtype=np.uint64) if len(codes) else 0
    return sums


def _classed(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = mix(histogram_sums(batch.column(1)) * _P2 + histogram_sums(batch.column(2)))
        columns = [batch.column(0), pa.array(key.view(np.int64))]
        yield pa.RecordBatch.from_arrays([*columns, batch.column(1), batch.column(2)] if keep else columns[1:], names=["entry_id", "k", "w", "p"] if keep else ["k"])


def sorted_parts(bare_id: str) -> str:
    """The identifier with its three letter-and-number parts sorted; left as it is if it isn't made of three such parts."""
    parts = PARTS.findall(bare_id)
    return "-".join(sorted(parts)) if len(parts) == 3 and sum(map(len, parts)) == len(bare_id) else bare_id


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = [bare(x) for x in batch.column(1).to_pylist()]
        p = [sorted_parts(bare(x)) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.string()), pa.array(p, pa.string())], names=["entry_id", "w", "p"])


def members(
    df: DataFrame,
    id_col: str = "entry_id",
    word_col: str = "word",
    passage_col: str = "passage_id",
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """(entry_id, entry_id_first, n_copies) of every row of a group with two or more members.

    Rows with a null word or passage id belong to no group. Fields without any letter or digit are
    equal to each other. Of equal ids in one group (repeated rows) each counts as a member.
    An empty table gives an empty result; no other column is read.

    A hot group costs no task more than its share: class sizes and group minima are summed before
    the shuffle, and a hot key in the joins back is split by adaptive execution, as the other side
    has one row for each key. The classes with several members are broadcast only up to ``broadcast_rows``
    of them, else joined by shuffle.
    """
    raw = df.select(F.col(id_col).cast("bigint").alias("entry_id"), F.col(word_col).cast("string").alias("w"), F.col(passage_col).cast("string").alias("p"))
    source = spread(raw.filter("w IS NOT NULL AND p IS NOT NULL"))
    sizes = source.mapInArrow(lambda b: _classed(b, False), "k bigint").groupBy("k").agg(F.count("*").alias("n"))
    classes = written(sizes.filter("n > 1").select("k"), "format_classes")
    few = classes.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = source.mapInArrow(lambda b: _classed(b, True), "entry_id bigint, k bigint, w string, p string")
    inside = rows.join(F.broadcast(classes) if few else classes, "k", "left_semi").select("entry_id", "w", "p")
    keyed = written(inside.mapInArrow(_keyed, "entry_id bigint, w string, p string"), "format_keys")
    groups = keyed.groupBy("w", "p").agg(F.min("entry_id").alias("entry_id_first"), F.count("*").alias("n_copies")).filter("n_copies > 1")
    return keyed.join(groups, ["w", "p"]).select("entry_id", "entry_id_first", "n_copies")


def found(df: DataFrame, id_col: str = "entry_id", word_col: str = "word", passage_col: str = "passage_id") -> DataFrame:
    """(entry_id_first, entry_id_copy): one row for each member of a group besides its first."""
    grouped = members(df, id_col, word_col, passage_col)
    return grouped.filter("entry_id > entry_id_first").select("entry_id_first", F.col("entry_id").alias("entry_id_copy"))


def collapse(df: DataFrame, id_col: str = "entry_id", word_col: str = "word", passage_col: str = "passage_id", broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row for each word and passage, with all its columns and the number of copies in ``n_copies``.

    Kept are the first row (smallest id) of each group and every row that has no copy; rows with a
    null word or passage id stay as they are with ``n_copies`` 1. Input columns named like the new
    one get it replaced. Ids are unique in the input.

    The rows themselves are shuffled only where more than ``broadcast_rows`` of them have copies.
    """
    grouped = members(df, id_col, word_col, passage_col, broadcast_rows).select(
        F.col("entry_id").alias("_id"), F.col("entry_id_first").alias("_first"), F.col("n_copies").alias("_copies")
    )
    grouped = written(grouped, "format_groups")
    few = grouped.limit(broadcast_rows + 1).count() <= broadcast_rows
    rest = df.drop("n_copies")
    joined = rest.join(F.broadcast(grouped) if few else grouped, rest[id_col].cast("bigint") == grouped["_id"], "left")
    kept = joined.filter("_first IS NULL OR _first = _id")
    return kept.select(*[rest[c] for c in rest.columns], F.coalesce("_copies", F.lit(1)).alias("n_copies"))
