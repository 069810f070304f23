"""Lexicon terms in texts, with their places.

The workers that tokenise a text look its tokens up in the lexicon, so that only matches leave them;
where the lexicon is too large to be sent to every worker, runs of tokens that pass a bit map of the
terms are joined with it by shuffle instead. Either way the work does not grow with the number of terms.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import fixed, text
from lexmill.session import spread, written

TOKEN = re.compile(r"\w+")
STOP = re.compile(r"[.!?;:]")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL"))


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, k, m[0], m.start(), m.end()) for i, body in enumerate(batch.column(1).to_pylist()) for k, m in enumerate(TOKEN.finditer(body))]
        i, k, token, start, end = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(i, pa.int64())), pa.array(k, pa.int32()), pa.array(token, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
            names=["id", "pos", "token", "start", "end"],
        )


def tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, token, start, end), one row for each token as written."""
    return _rows(df, id_col, text_col).mapInArrow(_one_by_one, "id bigint, pos int, token string, start int, end int")


def lowered(body: str) -> tuple[str, list[int] | None]:
    """Lower case, and the place in ``body`` of each of its characters where that differs: some capitals become two characters."""
    low = body.lower()
    if len(low) == len(body):
        return low, None
    parts = [c.lower() for c in body]
    return "".join(parts), [i for i, p in enumerate(parts) for _ in p]


class Finder:
    """Whole-word occurrences of terms in lower case, by their first token."""

    def __init__(self, terms: Iterable[str]):
        self.firsts: dict[str, list[str]] = {}
        for term in terms:
            self.firsts.setdefault(TOKEN.match(term)[0], []).append(term)

    def find(self, body: str) -> list[tuple[str, int, int]]:
        """(term, start, end), places in ``body`` from 0."""
        if not self.firsts:
            return []
        low, places = lowered(body)
        out, n = [], len(low)
        for m in TOKEN.finditer(low):
            for term in self.firsts.get(m[0], ()):
                a, b = m.start(), m.start() + len(term)
                if low.startswith(term, a) and (b >= n or not (low[b].isalnum() or low[b] == "_")):
                    out.append((term, a, b) if places is None else (term, places[a], places[b - 1] + 1))
        return out


def apart(found: list[tuple[str, int, int]], gap: int) -> list[tuple[str, int, int]]:
    """Greedy choice: longest term first, then by term and place; those whose start is nearer than ``gap`` to a kept one go."""
    starts: list[int] = []
    kept = []
    for hit in sorted(found, key=lambda h: (-len(h[0]), h)):
        i = bisect_left(starts, hit[1])
        if (i == 0 or hit[1] - starts[i - 1] >= gap) and (i == len(starts) or starts[i] - hit[1] >= gap):
            starts.insert(i, hit[1])
            kept.append(hit)
    return kept


def context(body: str, start: int, end: int) -> str:
    """Text between the full stops around [start, end)."""
    left = body.rfind(".", 0, start) + 1
    right = body.find(".", end)
    return body[left : right if right >= 0 else len(body)].strip()


def _terms(terms: DataFrame, term_col: str) -> DataFrame:
    t = F.lower(text.strip(F.col(term_col)))
    word = r"[\p{L}\p{N}_]"
    return terms.select(t.alias("term")).filter(F.col("term").rlike(f"^{word}") & F.col("term").rlike(f"{word}$")).distinct()


def bounded(table: DataFrame, limit: int) -> list | None:
    """The rows of a small table, or None where it has more than ``limit``."""
    rows = table.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


SPAN = "id bigint, term string, start int, end int"


def _spans(rows: list[tuple], ids: pa.Array, names: list[str]) -> pa.RecordBatch:
    types = {"term": pa.string(), "context": pa.string()}
    columns = list(zip(*rows)) or [()] * (len(names) + 1)
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, types.get(n, pa.int32())) for c, n in zip(columns[1:], names))], names=["id", *names]
    )


def hits(
    df: DataFrame,
    terms: DataFrame,
    id_col: str = "row_id",
    text_col: str = "content",
    term_col: str = "term",
    gap: int | None = None,
    with_context: bool = False,
    broadcast_terms: int = 200_000,
) -> DataFrame:
    """(id, term, start, end[, context]): every whole-word occurrence of every term, case aside; kept ``gap`` apart if that is given.

    Terms may have any number of words. Terms that begin or end with a mark never stand as whole
    words. Up to ``broadcast_terms`` terms are sent to the workers; more are joined by shuffle, with the same rows.
    """
    wanted = _terms(terms, term_col)
    rows = bounded(wanted, broadcast_terms)
    schema = SPAN + (", context string" if with_context else "")
    names = ["term", "start", "end"] + ["context"] * with_context
    if rows is None:
        found = _joined_hits(df, written(wanted, "terms"), id_col, text_col)
        found = kept_apart(found, gap) if gap is not None else found
        return add_context(found, df, id_col, text_col) if with_context else found
    shared = df.sparkSession.sparkContext.broadcast([r[0] for r in rows])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            out = []
            for i, body in enumerate(batch.column(1).to_pylist()):
                found = finder.find(body)
                for h in apart(found, gap) if gap is not None else found:
                    out.append((i, *h, context(body, h[1], h[2])) if with_context else (i, *h))
            yield _spans(out, batch.column(0), names)

    return _rows(df, id_col, text_col).mapInArrow(search, schema)


def _hash(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass"))


def _surfaces(batches: Iterator[pa.RecordBatch], lengths: list[int], wanted: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Runs of tokens whose hash is that of a term; ``lengths`` are the numbers of tokens of terms."""
    for batch in batches:
        out = []
        for i, body in enumerate(batch.column(1).to_pylist()):
            low, places = lowered(body)
            spots = [m.span() for m in TOKEN.finditer(low)]
            for n in lengths:
                for (a, _), (_, b) in zip(spots, spots[n - 1 :]):
                    slot = _hash(low[a:b]) >> (32 - bits)
                    if wanted[slot >> 3] >> (slot & 7) & 1:
                        out.append((i, low[a:b], a, b) if places is None else (i, low[a:b], places[a], places[b - 1] + 1))
        yield _spans(out, batch.column(0), ["term", "start", "end"])


def _joined_hits(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bits = min(30, max(16, (16 * wanted.count()).bit_length()))
    lengths = sorted(r[0] for r in wanted.select(F.size(F.regexp_extract_all("term", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("n")).distinct().collect())
    slots = wanted.select(F.shiftrightunsigned(F.crc32(F.encode("term", "utf-8")), 32 - bits).alias("s"))
    bytes_ = slots.groupBy(F.shiftright("s", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, CAST(s % 8 AS INT))")).alias("v")).toArrow()
    table = np.zeros(1 << (bits - 3), dtype=np.uint8)  # 128 MB at most
    table[bytes_.column("byte").to_numpy()] = bytes_.column("v").to_numpy().astype(np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(table)
    places = _rows(df, id_col, text_col).mapInArrow(lambda b: _surfaces(b, lengths, shared.value, bits), SPAN)
    return places.join(wanted, "term").select("id", "term", "start", "end")


def _fold_apart(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i, spans in enumerate(batch.column(1).to_pylist()):
            out += [(i, *h) for h in apart([(s["term"], s["start"], s["end"]) for s in spans], gap)]
        yield _spans(out, batch.column(0), ["term", "start", "end"])


def kept_apart(found: DataFrame, gap: int = 5) -> DataFrame:
    """(id, term, start, end): the greedy choice of :func:`apart` within each text.

    The matches of one text come into one row; their number is bounded by the text's length.
    """
    spans = found.groupBy("id").agg(F.collect_list(F.struct("term", "start", "end")).alias("s"))
    return spans.mapInArrow(lambda b: _fold_apart(b, gap), SPAN)


def add_context(found: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds the sentence around each span; joins the texts, so use ``with_context`` of :func:`hits` where it can be used."""
    t = texts.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("_text"))
    return found.join(t, "id").withColumn("context", text.sentence_context(F.col("_text"), F.col("start"), F.col("end"))).drop("_text")


def first_substrings(df: DataFrame, idioms: DataFrame, id_col: str, text_col: str, most: int = 50) -> DataFrame:
    """(id, term, start): first occurrence of each of the first ``most`` idioms, not bound to words.

    The list is bounded by ``most``, so it becomes a constant of the plan; only what is found is exploded.
    """
    terms = [r[0] for r in idioms.select(F.lower(text.strip(F.col(idioms.columns[0]))).alias("t")).filter("t <> ''").distinct().orderBy("t").limit(most).collect()]
    low = df.select(F.col(id_col).cast("bigint").alias("id"), F.lower(F.col(text_col)).alias("_l")).filter("_l IS NOT NULL")
    list_ = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    found = F.filter(F.transform(list_, lambda t: F.struct(t.alias("term"), (F.instr("_l", t) - 1).alias("start"))), lambda s: s["start"] >= 0)
    return spread(low).select("id", F.explode(found).alias("f")).select("id", "f.term", "f.start")


class Pairs:
    """Verbs with a particle up to ``max_gap`` tokens behind, no sentence mark between."""

    def __init__(self, pairs: Iterable[tuple[str, str]], max_gap: int):
        self.max_gap = max_gap
        self.particles: dict[str, set[str]] = {}
        for verb, particle in pairs:
            self.particles.setdefault(verb, set()).add(particle)

    def find(self, body: str) -> list[tuple[str, str, int, int, int, str]]:
        """(verb, particle, start, end, gap, pattern_type): each verb with the nearest of each of its particles."""
        if not self.particles:
            return []
        low, places = lowered(body)
        tokens_ = list(TOKEN.finditer(low))
        out = []
        for i, m in enumerate(tokens_):
            wanted = self.particles.get(m[0])
            if wanted is None:
                continue
            seen = set()
            for gap, other in enumerate(tokens_[i + 1 : i + 2 + self.max_gap]):
                if STOP.search(low, m.start(), other.start()):
                    break
                word = other[0]
                if word in wanted and word not in seen:
                    seen.add(word)
                    if gap == 0:
                        kind = "continuous"
                    elif gap == 1 and tokens_[i + 1][0] in fixed.GAP_PRONOUNS:
                        kind = "separated_pronoun"
                    else:
                        kind = "separated_long_noun" if gap >= 3 else "separated_noun"
                    a, b = m.start(), other.end()
                    out.append((m[0], word, a, b, gap, kind) if places is None else (m[0], word, places[a], places[b - 1] + 1, gap, kind))
        return out


def separable(df: DataFrame, idioms: DataFrame, id_col: str = "row_id", text_col: str = "content", max_gap: int = 6, broadcast_pairs: int = 200_000) -> DataFrame:
    """(id, verb, particle, start, end, gap, pattern_type): verb and its nearest particle, ``max_gap`` tokens between at most.

    No sentence mark may stand between them. The pairs are looked up where a text is tokenised, and only
    matches leave the workers; of more than ``broadcast_pairs`` pairs the words of each window are joined
    with them by shuffle, with the same rows.
    """
    pairs = idioms.select(F.lower(F.col("verb")).alias("verb"), F.lower(F.col("particle")).alias("particle")).filter("verb IS NOT NULL AND particle IS NOT NULL").distinct()
    rows = bounded(pairs, broadcast_pairs)
    schema = "id bigint, verb string, particle string, start int, end int, gap int, pattern_type string"

    def made(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 7
        types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], types))], names=["id", "verb", "particle", "start", "end", "gap", "pattern_type"]
        )

    source = _rows(df, id_col, text_col)
    if rows is None:

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for i, body in enumerate(batch.column(1).to_pylist()):
                    words = [m[0] for m in TOKEN.finditer(lowered(body)[0])]
                    every = {(w, p) for k, w in enumerate(words) for p in words[k + 1 : k + 2 + max_gap]}
                    out += [(i, *h) for h in Pairs(every, max_gap).find(body)]
                yield made(batch, out)

        return source.mapInArrow(windows, schema).join(pairs, ["verb", "particle"], "left_semi").select("id", "verb", "particle", "start", "end", "gap", "pattern_type")
    shared = df.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Pairs(shared.value, max_gap)
        for batch in batches:
            yield made(batch, [(i, *h) for i, body in enumerate(batch.column(1).to_pylist()) for h in finder.find(body)])

    return source.mapInArrow(search, schema)


def separable_table(analysis: DataFrame, json_col: str = "response") -> DataFrame:
    """(idiom, verb, particle, display_form, confidence, examples, reason) of two-word idioms found separable."""
    schema = "is_separable boolean, verb string, particle string, display_form string, examples array<string>, reason string, confidence double"
    parsed = analysis.withColumn("_a", F.from_json(text.fenced_json(F.col(json_col)), schema))
    words = F.split("idiom", " ")
    verb, particle = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    rows = parsed.filter(F.coalesce(F.col("_a.is_separable"), F.lit(False)) & (F.size(words) == 2))
    shown = F.coalesce(F.nullif(F.col("_a.display_form"), F.lit("")), F.concat_ws(" ~ ", verb, particle))
    return rows.select(
        "idiom", verb.alias("verb"), particle.alias("particle"), shown.alias("display_form"), F.coalesce("_a.confidence", F.lit(0.9)).alias("confidence"),
        F.coalesce("_a.examples", F.array().cast("array<string>")).alias("examples"), F.coalesce("_a.reason", F.lit("")).alias("reason"),
    )


def grammar_patterns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, display_form, original): grammar templates in each text; where the name asks for V-ing the last group ends in ing."""

    def found(regex: str, name: str) -> Column:
        whole = r"(?i)(?<![\p{L}\p{N}_])" + regex.replace(r"\w", r"[\p{L}\p{N}_]") + r"(?![\p{L}\p{N}_])"
        return F.transform(F.regexp_extract_all(F.col(text_col), F.lit(whole), F.lit(0)), lambda m: F.struct(F.lit(name).alias("display_form"), m.alias("original")))

    parts = [found(regex, name) for regex, name in fixed.GRAMMAR_PATTERNS]
    rows = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.explode(F.concat(*parts)).alias("m"))
    return rows.select("id", "m.*")


def known_phrases(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, original) of the known general idioms."""
    regex = r"(?i)(?<![\p{L}\p{N}_])(?:" + "|".join(p.replace(r"\w", r"[\p{L}\p{N}_]") for p in fixed.KNOWN_PHRASES) + r")(?![\p{L}\p{N}_])"
    return df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(regex), F.lit(0))).alias("original"))
