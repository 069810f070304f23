"""Vocabulary extraction: passages and a lexicon to the 22-column workbook."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import fixed, text
from lexmill.operators import difficulty, enrich, quality, rows, spans
from lexmill.session import spread, written

#: Columns of a passage that the workbook shows.
CARRIED = ("textbook_id", "book_title", "textbook_studio_passage_id", "studio_title", "textbook_unit_id")
MATCH_TYPES = {1: "separable", 2: "idiom_exact", 3: "word_exact", 4: "reference_idiom", 5: "difficult_word"}
CONFIDENCE = {1: 0.9, 2: 0.95, 3: 1.0, 4: 0.9, 5: 0.8}
#: How far apart the matches of a kind must start (None: as they are).
GAPS = {1: 6, 2: 5, 3: 3, 4: 10, 5: None}
MOST_REFERENCE, MOST_CANDIDATES, LEAST_LENGTH = 50, 10, 5


def _kind(lexicon: DataFrame, *kinds: str) -> DataFrame:
    return lexicon.filter(F.col("kind").isin(*kinds) & F.col("term").isNotNull() & ~F.col("term").startswith("#")).select("term")


def _low(terms: DataFrame) -> DataFrame:
    return terms.select(F.lower(text.strip(F.col("term"))).alias("term")).filter("term <> ''").distinct()


def separable_pairs(idioms: DataFrame) -> DataFrame:
    """(verb, particle, term) of two-word idioms that end in a particle: the offline stand-in for the analysis."""
    t = F.lower(text.strip(F.col("term")))
    parts = F.split(t, " ")
    verb, particle = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    two = idioms.filter((F.size(parts) == 2) & particle.isin(*fixed.PARTICLES))
    return two.select(verb.alias("verb"), particle.alias("particle"), t.alias("term")).distinct()


class Matcher:
    """All matches of one passage: separable idioms, other idioms and words of the user; on demand reference idioms and difficult words."""

    def __init__(self, pairs: list[tuple[str, str]], idioms: list[str], words: list[str], reference: list[str], easy: frozenset[str] | None, max_gap: int):
        self.pairs, self.idioms, self.words = spans.Pairs(pairs, max_gap), spans.Finder(idioms), spans.Finder(words)
        self.reference, self.easy = reference, easy

    def find(self, body: str) -> list[tuple[int, int, int, str, bool]]:
        """(kind, start, end, base form, separated), in the order of the workbook."""
        out = []
        for term, a, b in spans.apart([(f"{v} {p}", a, b) for v, p, a, b, _, _ in self.pairs.find(body)], GAPS[1]):
            # longer than the idiom itself: something stands between
            separated = b - a > len(term)
            out.append((1, a, b, term.replace(" ", " ~ ") if separated else term, separated))
        for kind, finder in ((2, self.idioms), (3, self.words)):
            out += [(kind, a, b, term, False) for term, a, b in spans.apart(finder.find(body), GAPS[kind])]
        if self.reference:
            low, places = spans.lowered(body)
            firsts = [(t, a, a + len(t)) for t in self.reference if (a := low.find(t)) >= 0]
            out += [(4, a, b, t, False) for t, a, b in spans.apart([(t, places[a], places[b - 1] + 1) if places else (t, a, b) for t, a, b in firsts], GAPS[4])]
        if self.easy is not None:
            n = 0
            for m in spans.TOKEN.finditer(body):
                token = m[0]
                if n == MOST_CANDIDATES:
                    break
                if len(token) > 2 and token.isalpha() and not token[0].isupper() and token.lower() not in self.easy:
                    n += 1
                    if len(token) >= LEAST_LENGTH:
                        out.append((5, m.start(), m.end(), token.lower(), False))
        return sorted(out)


def _in_workers(usable: DataFrame, lists: dict[str, list], full: bool, max_gap: int) -> DataFrame:
    """One pass over the passages: matches with their sentence, number and the passage's columns; nothing is shuffled."""
    shared = usable.sparkSession.sparkContext.broadcast(lists)
    fields = [(f.name, f.dataType.simpleString()) for f in usable.schema if f.name != "content"]
    made = ["kind", "seq", "start", "end", "base_form", "is_separated", "original", "context", "preview"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        matcher = Matcher(v["pairs"], v["idioms"], v["words"], v["reference"] if full else [], frozenset(v["easy"]) if full else None, max_gap)
        for batch in batches:
            at, out = [], []
            for i, body in enumerate(batch.column(batch.schema.get_field_index("content")).to_pylist()):
                shown = body if len(body) <= 100 else body[:100] + "..."
                for n, (kind, a, b, base, separated) in enumerate(matcher.find(body), 1):
                    at.append(i)
                    out.append((kind, n, a, b, base, separated, body[a:b], spans.context(body, a, b), shown))
            index = pa.array(at, pa.int64())
            columns = list(zip(*out)) or [()] * len(made)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)).take(index) for n, _ in fields), *(pa.array(c, t) for c, t in zip(columns, types))], names=[*(n for n, _ in fields), *made]
            )

    schema = ", ".join([*(f"{n} {t}" for n, t in fields), "kind int, seq bigint, start int, end int, base_form string, is_separated boolean, original string, context string, preview string"])
    return spread(usable).mapInArrow(search, schema)


def _by_joins(usable: DataFrame, lexicon: DataFrame, full: bool, max_gap: int) -> DataFrame:
    """The same for a lexicon that is too large for the workers: each kind is found by joins and joined with its passage."""

    def shaped(found: DataFrame, kind: int, base: Column, separated: Column) -> DataFrame:
        return found.select("id", F.lit(kind).alias("kind"), "start", "end", base.alias("base_form"), separated.alias("is_separated"))

    idioms, no = _kind(lexicon, "user_idiom"), F.lit(False)
    pairs = separable_pairs(idioms)
    sep = spans.separable(usable, pairs, "row_id", "content", max_gap, broadcast_pairs=0)
    sep = spans.kept_apart(sep.select("id", F.concat_ws(" ", "verb", "particle").alias("term"), "start", "end"), GAPS[1])
    between = (F.col("end") - F.col("start")) > F.length("term")
    found = shaped(sep, 1, F.when(between, F.replace("term", F.lit(" "), F.lit(" ~ "))).otherwise(F.col("term")), between)
    plain = _low(idioms).join(pairs.select("term"), "term", "left_anti")
    for kind, terms in ((2, plain), (3, _kind(lexicon, "user_word"))):
        found = found.unionByName(shaped(spans.hits(usable, terms, gap=GAPS[kind], broadcast_terms=0), kind, F.col("term"), no))
    if full:
        reference = spans.first_substrings(usable, _kind(lexicon, "reference_idiom"), "row_id", "content", MOST_REFERENCE)
        reference = spans.kept_apart(reference.withColumn("end", F.col("start") + F.length("term")), GAPS[4])
        found = found.unionByName(shaped(reference, 4, F.col("term"), no))
        hard = difficulty.first_candidates(spans.tokens(usable, "row_id", "content"), _kind(lexicon, "easy"), MOST_CANDIDATES, LEAST_LENGTH)
        found = found.unionByName(shaped(hard, 5, F.col("word"), no))
    seq = F.row_number().over(Window.partitionBy("id").orderBy("kind", "start", "end", "base_form")).cast("bigint")
    joined = found.withColumn("seq", seq).withColumnRenamed("id", "row_id").join(usable, "row_id")
    original = F.substring(F.col("content"), F.col("start") + 1, F.col("end") - F.col("start"))
    context = text.sentence_context(F.col("content"), F.col("start"), F.col("end"))
    return joined.withColumn("original", original).withColumn("context", context).withColumn("preview", text.preview(F.col("content"))).drop("content")


def matches(passages: DataFrame, lexicon: DataFrame, full: bool = False, max_gap: int = 6, broadcast_terms: int = 200_000) -> DataFrame:
    """Matches of all kinds with row_id, the passage's columns, kind, seq, start, end, base_form, is_separated, original, context and preview."""
    usable = passages.filter(F.length(text.strip(F.col("content"))) >= 10).select(F.col("row_id").cast("bigint").alias("row_id"), "content", *CARRIED)
    idioms, words, easy = _kind(lexicon, "user_idiom"), _kind(lexicon, "user_word"), _kind(lexicon, "easy")
    pairs = separable_pairs(idioms)
    tables = {
        "pairs": pairs.select("verb", "particle").distinct(),
        "idioms": spans._terms(_low(idioms).join(pairs.select("term"), "term", "left_anti"), "term"),
        "words": spans._terms(words, "term"),
        "easy": _low(easy),
    }
    lists = {name: spans.bounded(t, broadcast_terms) for name, t in tables.items()}
    if any(v is None for v in lists.values()):
        return _by_joins(usable, lexicon, full, max_gap)
    flat = {name: [tuple(r) if name == "pairs" else r[0] for r in rows_] for name, rows_ in lists.items()}
    flat["reference"] = [r[0] for r in _low(_kind(lexicon, "reference_idiom")).orderBy("term").limit(MOST_REFERENCE).collect()]
    return _in_workers(usable, flat, full, max_gap)


def workbook(passages: DataFrame, lexicon: DataFrame, profile: str = "lexicon", meanings: DataFrame | None = None, check: bool = True, **options) -> DataFrame:
    """The workbook of a passage table (row_id, content and metadata), checked and repaired unless ``check`` is false.

    Profile ``lexicon`` finds the user's words and idioms; ``full`` adds reference idioms and difficult
    words. Meanings come from ``meanings`` (key, response), else the generic one stands. Of a word that
    a passage has several times the entry with the longest sentence stays, of equal ones the first by
    place; passages without a studio id are no group, so all their entries stay.
    """
    made = matches(passages, lexicon, profile == "full", **options)
    kind: Column = F.lit("")
    confidence: Column = F.lit(None).cast("double")
    for k, name in MATCH_TYPES.items():
        kind = F.when(F.col("kind") == k, name).otherwise(kind)
        confidence = F.when(F.col("kind") == k, CONFIDENCE[k]).otherwise(confidence)
    out = rows.workbook_rows(made.withColumn("match_type", kind).withColumn("confidence", confidence))
    if meanings is not None:
        out = enrich.with_answers(out.drop("meaning_ko"), meanings, "base_form", "meaning_ko", enrich.generic_meaning(F.col("word")))
    # the repairs read the rows several times: the matches are made once
    out = quality.repair(written(out, "workbook"), order=("row_id", "seq")) if check else out
    return out.select("row_id", *fixed.WORKBOOK_NAMES)
