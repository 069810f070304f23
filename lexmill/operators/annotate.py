"""Annotators: lemma, part of speech, names and stop words by rule, and a dictionary given as a table.

The dictionary table has (word, pos, sense_no, gloss, examples ARRAY, synonyms ARRAY, antonyms ARRAY) with
one row for each sense; it is empty unless one is supplied, and everything here works without it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import rules

DICTIONARY = "word string, pos string, sense_no int, gloss string, examples array<string>, synonyms array<string>, antonyms array<string>"

SCORES_AT_ONCE = 1 << 18

# fixed values: irregular forms that suffix rules would miss
IRREGULAR_LEMMAS = {
    "was": "be", "were": "be", "been": "be", "is": "be", "are": "be", "am": "be", "has": "have", "had": "have", "does": "do", "did": "do", "done": "do",
    "went": "go", "gone": "go", "took": "take", "taken": "take", "gave": "give", "given": "give", "made": "make", "said": "say", "got": "get",
    "came": "come", "saw": "see", "seen": "see", "knew": "know", "known": "know", "thought": "think", "told": "tell", "men": "man", "women": "woman",
    "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse", "better": "good", "best": "good", "worse": "bad", "worst": "bad",
}


def empty_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DICTIONARY)


def lemma(word: Column) -> Column:
    """Irregular form, else by the usual endings of plurals and verbs; doubled consonants are undone."""
    low = F.lower(word)
    out = F.when(F.lit(False), F.lit(""))
    for form, base in IRREGULAR_LEMMAS.items():
        out = out.when(low == form, base)

    def cut(n: int, new: str = "") -> Column:
        return F.concat(F.substring(low, F.lit(1), F.length(low) - n), F.lit(new))

    def undouble(c: Column) -> Column:
        return F.regexp_replace(c, r"([bdgmnprt])\1$", "$1")

    return (
        out.when(low.rlike("[^aeiou]ies$"), cut(3, "y"))
        .when(low.rlike("(s|x|z|ch|sh)es$"), cut(2))
        .when(low.rlike("[^su]s$") & (F.length(low) > 3), cut(1))
        .when(low.rlike("[^aeiou]ied$"), cut(3, "y"))
        .when(low.rlike("[aeiouy][^aeiou]+ed$") & (F.length(low) > 4), undouble(cut(2)))
        .when(low.rlike("[aeiouy][^aeiou]*ing$") & (F.length(low) > 5), undouble(cut(3)))
        .otherwise(low)
    )


def is_name(token: Column, is_first: Column) -> Column:
    """Capitalised and not the first token of its sentence."""
    return token.rlike(r"^\p{Lu}\p{L}+") & ~is_first


def annotated(tokens: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Adds lemma, pos, is_stop and is_name to (id, pos, token, ...); ``tag`` is the part of speech."""
    stop = stopwords.select(F.lower(F.trim(F.col(stopwords.columns[0]))).alias("_s")).filter("_s IS NOT NULL").distinct().withColumn("is_stop", F.lit(True))
    low = F.lower("token")
    rows = tokens.withColumn("lemma", lemma(F.col("token"))).withColumn("tag", rules.pos_tag(low)).withColumn("_low", low)
    out = rows.join(stop, rows["_low"] == stop["_s"], "left").withColumn("is_stop", F.coalesce("is_stop", F.lit(False)))
    return out.withColumn("is_name", is_name(F.col("token"), F.col("pos") == 0)).drop("_low", "_s")


def letter_of_tag(tag: Column) -> Column:
    """Dictionary letter of a Penn tag: J a, V v, N n, R r, else null."""
    first = F.substring(tag, 1, 1)
    return F.when(first == "J", "a").when(first == "V", "v").when(first == "N", "n").when(first == "R", "r")


def sense_counts(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, n_senses) of each word, 0 where the dictionary has none."""
    n = dictionary.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("_n"))
    return words.join(n, "word", "left").withColumn("n_senses", F.coalesce("_n", F.lit(0))).drop("_n")


def info(words: DataFrame, dictionary: DataFrame, most: int = 5) -> DataFrame:
    """(word, gloss, synonyms, antonyms): first gloss, and up to ``most`` of each list over all senses, in order, without the word itself."""
    senses = dictionary.groupBy(F.lower("word").alias("word")).agg(F.array_sort(F.collect_list(F.struct("sense_no", "gloss", "synonyms", "antonyms"))).alias("_s"))

    def all_of(field: str) -> Column:
        flat = F.flatten(F.transform("_s", lambda s: F.coalesce(s[field], F.array().cast("array<string>"))))
        clean = F.array_distinct(F.transform(flat, lambda w: F.replace(w, F.lit("_"), F.lit(" "))))
        return F.slice(F.filter(clean, lambda w: F.lower(w) != F.col("word")), 1, most)

    rows = words.join(senses, "word", "left")
    none = F.array().cast("array<string>")
    return rows.select("word", F.coalesce(F.get("_s", F.lit(0))["gloss"], F.lit("")).alias("gloss"), F.coalesce(all_of("synonyms"), none).alias("synonyms"), F.coalesce(all_of("antonyms"), none).alias("antonyms"))


class _Asked:
    """The meanings of one word, or part of them, with the two best senses of each so far."""

    def __init__(self, rows: pa.RecordBatch):
        self.rows = rows
        tokens = rows.column("tokens")
        encoded = tokens.flatten().dictionary_encode()
        self.vocabulary, self.codes = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.row = np.repeat(np.arange(rows.num_rows), np.diff(self.bounds))
        self.best = np.full((rows.num_rows, 2), -1)  # in halves; -1 where there is no sense yet
        self.numbers = pa.nulls(2 * rows.num_rows, rows.schema.field("sense_no").type)

    def _postings(self, senses: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Places of the senses that have each word asked, word after word, and how many each has: a word of the gloss twice, one of the examples once."""
        codes, places = [], []
        for column, halves in (("tokens", 1), ("gloss", 2)):
            lists = senses.column(column)
            found = pc.index_in(lists.flatten(), value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.repeat(np.arange(senses.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            codes += [found[found >= 0]] * halves
            places += [at[found >= 0]] * halves
        flat = np.concatenate(codes)
        return np.concatenate(places)[np.argsort(flat, kind="stable")], np.bincount(flat, minlength=len(self.vocabulary))

    def meet(self, senses: pa.RecordBatch) -> None:
        """Senses that follow, by number, those met so far."""
        n, asked = senses.num_rows, self.rows.num_rows
        posted, counts = self._postings(senses)
        firsts = np.cumsum(counts) - counts
        shared = counts[self.codes]
        cost = np.cumsum(n + np.diff(np.concatenate([[0], np.cumsum(shared)])[self.bounds]))
        score, place = np.full((asked, 2), -1), np.zeros((asked, 2), np.int64)
        cuts = np.unique(np.concatenate([[0], np.searchsorted(cost, np.arange(SCORES_AT_ONCE, cost[-1], SCORES_AT_ONCE)), [asked]]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = slice(self.bounds[a], self.bounds[b])
            many = shared[part]
            into = np.repeat(firsts[self.codes[part]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            hits = np.repeat((self.row[part] - a) * n, many) + posted[into]
            scores, every = np.bincount(hits, minlength=(b - a) * n).reshape(b - a, n), np.arange(b - a)
            for k in range(min(2, n)):
                # the first of equal ones has the smallest number
                place[a:b, k] = scores.argmax(1)
                score[a:b, k] = scores[every, place[a:b, k]]
                scores[every, place[a:b, k]] = -1
        scores, places = np.hstack([self.best, score]), np.hstack([np.arange(2 * asked).reshape(asked, 2), 2 * asked + place])
        order = np.argsort(-scores, axis=1, kind="stable")[:, :2]
        self.best = np.take_along_axis(scores, order, 1)
        self.numbers = pa.concat_arrays([self.numbers, senses.column("sense_no")]).take(pa.array(np.take_along_axis(places, order, 1).ravel()))

    def answer(self) -> pa.RecordBatch:
        empty = self.rows.column("empty").to_numpy(zero_copy_only=False).astype(bool)
        keep = self.best >= np.column_stack([np.zeros(len(empty)), np.where(empty, 0, 1)])
        at = pa.array(np.nonzero(keep)[0])
        columns = [self.rows.column("word").take(at), self.rows.column("meaning").take(at), self.numbers.filter(pa.array(keep.ravel())), pa.array(self.best[keep] / 2)]
        return pa.RecordBatch.from_arrays(columns, names=["word", "meaning", "sense_no", "score"])


def _best_of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by cell, in each the meanings before the senses, which come by number."""
    key, waiting, asked = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        same = [pc.equal(batch.column(c).slice(1), batch.column(c).slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False).astype(bool) for c in ("word", "cell", "is_sense")]
        starts = [0, *(np.nonzero(~(same[0] & same[1] & same[2]))[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:]):
            rows = batch.slice(a, b - a)
            now = (rows.column("word")[0].as_py(), rows.column("cell")[0].as_py())
            if now != key:
                if asked:
                    yield asked.answer()
                key, waiting, asked = now, [], None
            if not rows.column("is_sense")[0].as_py():
                waiting.append(rows)
            elif asked or waiting:
                asked, waiting = asked or _Asked(pa.concat_batches(waiting)), []
                asked.meet(rows)
    if asked:
        yield asked.answer()


def best_senses(rows: DataFrame, dictionary: DataFrame, meaning_col: str = "meaning", cell_rows: int = 16_384) -> DataFrame:
    """(word, meaning, sense_no, score): the two senses whose gloss and examples share most words with the meaning.

    Shared words of the gloss count 1, of the examples 0.5; only scores above 0.1, else the first sense;
    without a meaning the first two.

    There is no row for each pair of a meaning and a sense: about ``cell_rows`` meanings of a word are held in a worker, its senses pass
    by number, and shared words are counted by postings. A word with more meanings is dealt to several workers, each of which gets all its senses.
    """
    spark = rows.sparkSession
    senses = dictionary.select(F.lower("word").alias("word"), "sense_no", "gloss", F.array_join(F.coalesce("examples", F.array().cast("array<string>")), " ").alias("text"))
    asked = rows.select("word", F.col(meaning_col).alias("meaning")).join(senses.select("word").distinct(), "word", "left_semi").distinct()
    # few words, as each has at least so many meanings
    hot = asked.groupBy("word").agg(F.count("*").alias("_n")).filter(F.col("_n") > cell_rows).select("word", F.ceil(F.col("_n") / cell_rows).cast("int").alias("cells"))
    cells = F.coalesce("cells", F.lit(1))
    of_asked = asked.join(F.broadcast(hot), "word", "left").select("word", F.pmod(F.xxhash64("meaning"), cells).cast("int").alias("cell"), F.lit(False).alias("is_sense"), "meaning", F.lit(None).cast(dictionary.schema["sense_no"].dataType).alias("sense_no"), F.lit(None).cast("string").alias("gloss"), F.coalesce("meaning", F.lit("")).alias("text"))
    of_senses = senses.join(F.broadcast(hot), "word", "left").select("word", F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"), F.lit(True).alias("is_sense"), F.lit(None).cast(asked.schema["meaning"].dataType).alias("meaning"), "sense_no", "gloss", "text")
    # the number is given, as the work of a partition is not told by its size
    dealt = of_asked.unionByName(of_senses.filter("word IS NOT NULL")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word", "cell").sortWithinPartitions("word", "cell", "is_sense", "sense_no")

    def words(c: Column) -> Column:
        return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\W+")), lambda w: F.length(w) > 0)

    ready = dealt.select("word", "cell", "is_sense", "meaning", "sense_no", (F.length(F.trim("text")) == 0).alias("empty"), words(F.col("gloss")).alias("gloss"), words(F.col("text")).alias("tokens"))
    schema = T.StructType([T.StructField(c, ready.schema[c].dataType) for c in ("word", "meaning", "sense_no")] + [T.StructField("score", T.DoubleType())])
    return ready.mapInArrow(_best_of_cells, schema).withColumnRenamed("meaning", meaning_col)


def single_lemmas(candidates: Column, word: Column) -> Column:
    """Single alphabetic words of 3 to 12 letters other than the word."""
    return F.filter(candidates, lambda c: c.rlike(r"^\p{L}{3,12}$") & (F.lower(c) != F.lower(word)))


def filter_by_pos(candidates: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, candidate, pos) rows whose candidate the dictionary has with that part of speech; rows without one pass, and all do if the dictionary is empty."""
    if dictionary.isEmpty():
        return candidates
    known = dictionary.select(F.lower("word").alias("_w"), F.col("pos").alias("_p")).distinct()
    has = candidates.filter("pos IS NOT NULL").join(known, (F.lower("candidate") == F.col("_w")) & (F.col("pos") == F.col("_p")), "left_semi")
    return has.unionByName(candidates.filter("pos IS NULL"))
