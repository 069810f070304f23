"""Mixing sources to target weights: capped water-filling (problem 7).

Every source gets its share of the total size. A source that cannot reach it even when repeated as
often as allowed is clamped there; what it leaves is spread over the others by weight, and so on
until nothing more is clamped. Documents are then repeated whole as often as the share asks, and a
seeded fraction of them once more.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import spread, written

#: A rank file as described in the folder's README; the pattern belongs to it (fixed value).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict = {}


def _encoder(raw: bytes, pattern: str):
    import tiktoken

    key = (len(raw), hash(raw), pattern)
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def token_counts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokenizer_path: str = TOKENIZER,
    pattern: str = PATTERN,
) -> DataFrame:
    """(doc_id, source, n_tokens) of each row; a null or empty text has 0 tokens.

    The rank file (under 2 MB) is read by the driver and broadcast, so executors need no copy of it.
    """
    with open(tokenizer_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks.value, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    columns = [F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")]
    return spread(df.select(*columns)).mapInArrow(count, "doc_id bigint, source string, n_tokens bigint")


def shares_of(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, weight, max_repeats, n_docs, available, cap) of the sources in ``targets``, from the table of :func:`token_counts`.

    Targets with a null source or weight are left out, negative weights count as 0, a null
    ``max_repeats`` as 1 and a negative one as 0; where a source stands twice its weights are
    added and the larger ``max_repeats`` holds.
    """
    wanted = (
        targets.filter("source IS NOT NULL AND target_weight IS NOT NULL")
        .groupBy(F.col("source").cast("string").alias("source"))
        .agg(
            F.sum(F.greatest(F.col("target_weight").cast("double"), F.lit(0.0))).alias("weight"),
            F.max(F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0))).cast("long").alias("max_repeats"),
        )
    )
    there = sizes.filter("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("available"))
    joined = wanted.join(there, "source", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0))).withColumn("available", F.coalesce("available", F.lit(0)))
    return joined.select("source", "weight", "max_repeats", "n_docs", "available", (F.col("available") * F.col("max_repeats")).alias("cap"))


def water_level(shares: DataFrame, total: float) -> float:
    """Tokens for each unit of weight of the sources that are not clamped; infinite where all are.

    At each step the sources whose cap lies under their share are clamped, and what is left is
    spread over the others; the level only rises, so it ends with the step that clamps no more.
    """
    level, n_before = 0.0, -1
    while True:
        full = F.col("cap") < F.lit(level) * F.col("weight")
        rest = F.when(~full & (F.col("weight") > 0), F.col("weight"))
        n, taken, weight = shares.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(rest)).first()
        if not weight:
            return float("inf")
        if n == n_before:
            return level
        level, n_before = (total - (taken or 0)) / weight, n


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """One row for each source with a target: sizes, target, what it was allotted and whether it misses its target.

    ``total`` is the size of all documents of those sources unless given. Nothing but sums comes to the driver.
    """
    shares = written(shares_of(sizes, targets), "shares")
    weights, available = shares.agg(F.sum("weight"), F.sum("available")).first()
    whole = float(available or 0) if total is None else float(total)
    level = water_level(shares, whole)
    share = F.col("weight") / weights if weights else F.lit(0.0)
    allotted = F.col("cap").cast("double") if level == float("inf") else F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    out = shares.withColumn("target_tokens", share * whole).withColumn("allotted_tokens", F.when(F.col("weight") > 0, allotted).otherwise(0.0))
    epochs = F.when(F.col("available") > 0, F.col("allotted_tokens") / F.col("available")).otherwise(0.0)
    return out.select(
        "source", "n_docs", F.col("available").alias("available_tokens"), "max_repeats", share.alias("target_share"), "target_tokens", "allotted_tokens",
        epochs.alias("epochs"), (F.col("cap") < F.col("target_tokens")).alias("misses_target"),
    )


def n_repeats(id_col: Column, epochs: Column, seed: int) -> Column:
    """How often a document comes: ``floor(epochs)`` times, and once more where its seeded hash falls under the fraction."""
    draw = F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11) / F.lit(float(1 << 53))
    return (F.floor(epochs) + F.when(draw < epochs - F.floor(epochs), 1).otherwise(0)).cast("bigint")


def repeats(sizes: DataFrame, plan_: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, n_repeats) of the documents that come into the mix.

    The draw depends on the id and seed alone, so a lost task draws the same again.
    Repeated ids are drawn alike.
    """
    # plan_ has one row for each source with a target: Spark broadcasts it while it is under its threshold, and splits hot sources beyond
    joined = sizes.join(plan_.select("source", "epochs"), "source")
    times = n_repeats(F.col("doc_id"), F.col("epochs"), seed)
    return joined.withColumn("n_repeats", times).filter("n_repeats > 0").select("doc_id", "source", "n_tokens", "n_repeats")


def report(sizes: DataFrame, plan_: DataFrame, seed: int = 42) -> DataFrame:
    """The plan with the tokens and share that the mix really reaches."""
    got = repeats(sizes, plan_, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_repeats")).alias("mixed_tokens"))
    out = plan_.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    out = written(out, "report")
    all_ = out.agg(F.sum("mixed_tokens")).first()[0] or 0
    return out.withColumn("mixed_share", F.col("mixed_tokens") / F.lit(all_) if all_ else F.lit(0.0))


def sized(df: DataFrame, **columns: str) -> DataFrame:
    """The table of :func:`token_counts`, written once: texts are tokenised a single time."""
    return written(token_counts(df, **columns), "tokens")


def mix(df: DataFrame, targets: DataFrame, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", **columns: str) -> DataFrame:
    """The mixed collection: rows of ``df`` with ``copy_no`` from 1, each as often as it comes into the mix.

    Rows whose source is null or has no target stay out. A column named ``copy_no`` is replaced.
    How often a row comes follows from its source and id, so texts are not shuffled: the plan, of one row for
    each source, is joined by source. Repeated rows each come, all alike.
    """
    epochs = plan(sized(df, id_col=id_col, source_col=source_col, **columns), targets).select(F.col("source").alias("_source"), F.col("epochs").alias("_epochs"))
    rest = df.drop("copy_no")
    joined = rest.join(epochs, rest[source_col].cast("string") == epochs["_source"])
    times = n_repeats(rest[id_col].cast("bigint"), F.col("_epochs"), seed).cast("int")
    return joined.withColumn("_times", times).filter("_times > 0").select(*[rest[c] for c in rest.columns], F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("copy_no"))


def found(df: DataFrame, targets: DataFrame, **columns: str) -> DataFrame:
    """(source) that misses its target: clamped at the first step of the filling of the whole size."""
    return plan(sized(df, **columns), targets).filter("misses_target").select("source")
