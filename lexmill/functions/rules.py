"""Scoring and decision rules as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import fixed


def _any(c: Column, parts, test: Callable[[Column, str], Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | test(c, p)
    return out


def contains_any(c: Column, parts) -> Column:
    return _any(c, parts, lambda x, p: x.contains(p))


def educational_score(pattern: Column, frequency: Column, n: Column) -> Column:
    """(frequency + 1.5 if it holds a preposition) times the weight of its length, plus the first bonus that applies."""
    has_preposition = F.arrays_overlap(F.split(pattern, " "), F.array(*[F.lit(p) for p in fixed.PREPOSITIONS]))
    weight = F.lit(None).cast("double")
    for length, w in fixed.LENGTH_WEIGHTS.items():
        weight = F.when(n == length, w).otherwise(weight)
    bonus = F.when(F.lit(False), 0.0)
    padded = F.concat(F.lit(" "), pattern, F.lit(" "))
    for regex, value in fixed.PATTERN_BONUSES:
        phrase = regex.removeprefix("(^| )").removesuffix("( |$)")
        # a fixed phrase needs no regex
        bonus = bonus.when(pattern.rlike(regex) if "[" in phrase else padded.contains(f" {phrase} "), value)
    return (frequency + F.when(has_preposition, 1.5).otherwise(0.0)) * F.coalesce(weight, F.lit(1.0)) + bonus.otherwise(0.0)


def category(pattern: Column) -> Column:
    """Six ordered rules on letters, then the rest."""
    p = F.lower(pattern)
    starts = _any(p, fixed.CATEGORY_PREPOSITION[1], lambda x, w: x.startswith(w))
    two = F.size(F.split(p, " ")) == 2
    return (
        F.when(contains_any(p, fixed.CATEGORY_LINK[1]), fixed.CATEGORY_LINK[0])
        .when(starts, fixed.CATEGORY_PREPOSITION[0])
        .when(contains_any(p, fixed.CATEGORY_TIME[1]), fixed.CATEGORY_TIME[0])
        .when(contains_any(p, fixed.CATEGORY_CONDITION[1]), fixed.CATEGORY_CONDITION[0])
        .when(two & contains_any(p, fixed.CATEGORY_VERB[1]), fixed.CATEGORY_VERB[0])
        .when(contains_any(p, fixed.CATEGORY_ACADEMIC[1]), fixed.CATEGORY_ACADEMIC[0])
        .otherwise(fixed.CATEGORY_OTHER)
    )


def pos_tag(word: Column) -> Column:
    """Tag by a fixed lexicon, then by suffix, else NOUN."""
    out = F.when(F.lit(False), F.lit(""))
    for tag, words in fixed.TAGGED_WORDS:
        out = out.when(word.isin(*words), tag)
    for tag, suffixes in fixed.POS_OF_SUFFIX:
        out = out.when((F.length(word) > 4) & _any(word, suffixes, lambda x, s: x.endswith(s)), tag)
    return out.otherwise("NOUN")


def important_pos(tags: Column) -> Column:
    """Equals or begins with one of the sequences worth keeping."""
    out = F.lit(False)
    for seq in fixed.POS_SEQUENCES:
        out = out | (F.slice(tags, 1, len(seq)) == F.array(*[F.lit(t) for t in seq]))
    return out


def phonetic_complexity(word: Column) -> Column:
    """0.5 for each pair of neighbouring consonants, 0.3 for each of the rare pairs of letters it holds."""
    low = F.lower(word)
    clusters = F.regexp_replace(low, "[bcdfghjklmnpqrstvwxyz]", "c")
    runs = F.regexp_extract_all(clusters, F.lit("(c+)"), F.lit(1))
    pairs = F.aggregate(runs, F.lit(0), lambda a, r: a + F.length(r) - 1)
    rare = sum((F.when(low.contains(d), 1).otherwise(0) for d in fixed.DIGRAPHS), F.lit(0))
    return pairs * 0.5 + rare * 0.3


def difficulty_score(morphology: Column, n_senses: Column, word: Column) -> Column:
    return morphology * 0.4 + n_senses * 0.1 * 0.3 + phonetic_complexity(word) * 0.3


def word_difficulty(word: Column) -> Column:
    """elementary, intermediate or advanced by length, affixes and roots."""
    n = F.length(word)
    score = (
        F.when(n <= 4, 1).when(n <= 6, 2).when(n <= 8, 3).otherwise(4)
        + F.when(_any(word, fixed.HARD_SUFFIXES, lambda x, s: x.endswith(s)), 2).otherwise(0)
        + F.when(_any(word, fixed.HARD_PREFIXES, lambda x, s: x.startswith(s)), 1).otherwise(0)
        + F.when(contains_any(word, fixed.HARD_ROOTS), 1).otherwise(0)
    )
    level = F.when(score <= 2, "elementary").when(score <= 4, "intermediate").otherwise("advanced")
    return F.when(word.isNull() | (n == 0), "elementary").otherwise(level)


def complex_word(word: Column) -> Column:
    affix = _any(word, fixed.HARD_SUFFIXES, lambda x, s: x.endswith(s)) | _any(word, fixed.HARD_PREFIXES, lambda x, s: x.startswith(s))
    return affix | (F.length(word) > 8)


def too_easy(word: Column, tag: Column, external: Column, child: Column) -> Column:
    """Basic, in an external list, in the child vocabulary, two letters at most, or a word of grammar."""
    low = F.lower(word)
    return low.isin(*fixed.BASIC_WORDS) | external | child | (F.length(low) <= 2) | tag.isin(*fixed.EASY_TAGS)


def suitability(word: Column, user: Column, external: Column, min_length: int = 4) -> Column:
    """STRUCT<ok, reason> of the cascade: user word, basic word, external list, length."""
    low = F.lower(word)

    def said(ok: bool, reason: str) -> Column:
        return F.struct(F.lit(ok).alias("ok"), F.lit(reason).alias("reason"))

    return (
        F.when(user, said(True, "사용자DB"))
        .when(low.isin(*fixed.BASIC_WORDS), said(False, "기본어휘제외"))
        .when(external, said(False, "외부DB제외"))
        .when(F.length(low) < min_length, said(False, "길이부족"))
        .otherwise(said(True, "적합"))
    )


def difficulty_decision(known: Column, basic: Column, score: Column, recommendation: Column, least: float = 7.0) -> Column:
    """STRUCT<ok, reason> from an analysis: missing, basic, too low, recommended or not."""
    s = F.coalesce(score, F.lit(5.0))

    def said(ok: bool, reason: str) -> Column:
        return F.struct(F.lit(ok).alias("ok"), F.lit(reason).alias("reason"))

    return (
        F.when(~F.coalesce(known, F.lit(False)), said(False, "분석실패"))
        .when(F.coalesce(basic, F.lit(False)), said(False, "기본어휘제외"))
        .when(s < least, said(False, "난이도부족"))
        .when(F.coalesce(recommendation, F.lit("exclude")) == "include", said(True, "고난이도확인"))
        .otherwise(said(False, "GPT제외추천"))
    )


def is_difficult(word: Column, easy: Column, child: Column, n_senses: Column, morphology: Column, above: float = 0.6) -> Column:
    """Four letters or more, not easy, and unknown to the dictionary or scored above the limit."""
    plain = (F.length(word) >= 4) & word.rlike(r"^\p{L}+$") & ~easy & ~child
    return F.coalesce(plain & ((n_senses == 0) | (difficulty_score(morphology, n_senses, word) > above)), F.lit(False))


def too_similar(a: Column, b: Column) -> Column:
    close = F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)) < 0.3
    return F.when(F.abs(F.length(a) - F.length(b)) > 3, F.lit(False)).otherwise(close)


def compound_word(word: Column) -> Column:
    return (F.length(word) >= 4) & word.rlike(r"[\p{L}\p{N}_](\s+|-)[\p{L}\p{N}_]|[\p{L}\p{N}]_[\p{L}\p{N}]")


def _stripped(low: Column, suffixes, least: int) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for s in suffixes:
        out = out.when(low.endswith(s) & (F.length(low) > len(s) + 2) & (F.length(low) - len(s) >= least), F.substring(low, F.lit(1), F.length(low) - len(s)))
    return out.otherwise(low)


def word_root(word: Column, irregular: dict[str, str] = fixed.MORE_IRREGULAR_ROOTS, suffixes=fixed.ROOT_SUFFIXES, least: int = 3) -> Column:
    """Irregular root, else the first suffix that fits taken away."""
    low = F.lower(word)
    out = F.when(F.lit(False), F.lit(""))
    for form, root in irregular.items():
        out = out.when(low == form, root)
    return out.otherwise(_stripped(low, suffixes, least))


def short_root(word: Column) -> Column:
    return word_root(word, fixed.IRREGULAR_ROOTS, fixed.SHORT_ROOT_SUFFIXES, 0)


def same_root(a: Column, b: Column) -> Column:
    ra, rb = word_root(a), word_root(b)
    return (ra == rb) | ((F.length(ra) >= 4) & (F.length(rb) >= 4) & (ra.contains(rb) | rb.contains(ra)))


def valid_candidate(candidate: Column, word: Column, basic: bool) -> Column:
    """One word of 3 to 12 letters or apostrophes other than the word itself; ``basic``: nor a very common one, else nor in capitals."""
    c, low = candidate, F.lower(candidate)
    ok = c.rlike("^[a-zA-Z']+$") & F.length(c).between(3, 12) & (low != F.lower(F.coalesce(word, F.lit(""))))
    return ok & (~low.isin(*fixed.COMMON_SYNONYMS) if basic else ~((F.upper(c) == c) & c.rlike("[A-Z]")))


def high_quality(candidate: Column, word: Column) -> Column:
    c, w = F.lower(candidate), F.lower(word)
    return candidate.rlike("^[a-zA-Z]{3,10}$") & ~w.contains(c) & ~c.contains(w) & c.isin(*fixed.QUALITY_SYNONYMS)


def meaning_problem(meaning: Column, compat_nan: bool = False) -> Column:
    """What is wrong with a Korean meaning, by the first rule that applies, or null.

    A null is missing; with ``compat_nan`` it reads as the text nan, which holds ASCII letters.
    """
    m = F.coalesce(F.regexp_replace(meaning, r"(?U)^\s+|\s+$", ""), F.lit("nan" if compat_nan else ""))
    return (
        F.when(m.endswith("의미"), "generic_meaning_pattern")
        .when(m.rlike("[a-zA-Z]"), "contains_english")
        .when(F.length(m) < 2, "missing_or_too_short")
        .when(F.length(m) > 30, "too_long")
    )


def vocabulary_level(average_length: Column, complex_share: Column) -> Column:
    return (
        F.when((average_length > 7) & (complex_share > 0.3), "advanced")
        .when((average_length > 5.5) & (complex_share > 0.15), "intermediate")
        .otherwise("elementary")
    )


def phrasal_class(verb: Column, particle: Column, distance: Column) -> Column:
    """STRUCT<pattern_type, base_form, display_form, is_separated> of a verb and a particle ``distance`` tokens apart."""
    base = F.concat_ws(" ", verb, particle)
    apart = F.concat_ws(" ~ ", verb, particle)
    must = F.lit(False)
    for v, particles in fixed.MANDATORY_SEPARABLE.items():
        must = must | ((verb == v) & particle.isin(*particles))

    def made(kind: str, shown: Column, separated: bool) -> Column:
        return F.struct(F.lit(kind).alias("pattern_type"), base.alias("base_form"), shown.alias("display_form"), F.lit(separated).alias("is_separated"))

    return (
        F.when(base.isin(*fixed.OPTIONAL_SEPARABLE), made("optional_separable", base, False))
        .when(must, made("mandatory_separable", apart, True))
        .when(F.abs(distance) > 1, made("actually_separated", apart, True))
        .otherwise(made("continuous", base, False))
    )


# --- folds over candidate lists ---------------------------------------------------------------


def root_dedup(candidates: Column, word: Column, root: Callable[[Column], Column] = word_root, most: int | None = None) -> Column:
    """Candidates in order, each with a root of its own that is not the word's."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array(root(word)).alias("seen"))

    def step(acc: Column, c: Column) -> Column:
        r = root(c)
        full = (F.size(acc["kept"]) >= most) if most is not None else F.lit(False)
        skip = c.isNull() | (F.length(c) == 0) | F.array_contains(acc["seen"], r) | full
        grown = F.struct(F.concat(acc["kept"], F.array(c)).alias("kept"), F.concat(acc["seen"], F.array(r)).alias("seen"))
        return F.when(skip, acc).otherwise(grown)

    return F.aggregate(F.coalesce(candidates, F.array().cast("array<string>")), start, step, lambda acc: acc["kept"])


def keep_apart(spans: Column, gap: int, inclusive: bool = False) -> Column:
    """Spans in the given order, each whose start lies ``gap`` or more from all kept before (more than ``gap`` if inclusive)."""

    def near(a: Column, b: Column) -> Column:
        d = F.abs(a["start"] - b["start"])
        return d <= gap if inclusive else d < gap

    return F.aggregate(spans, F.filter(spans, lambda _: F.lit(False)), lambda acc, s: F.when(F.exists(acc, lambda a: near(a, s)), acc).otherwise(F.concat(acc, F.array(s))))


def database_filter(word: Column, user: Column, cached: Column, decided: Column) -> Column:
    """STRUCT<ok, reason>: a user word, a word with a space, hyphen or tilde, what the cache says, else the decision."""
    pattern = word.rlike("[ ~-]")
    return (
        F.when(user, F.struct(F.lit(True).alias("ok"), F.lit("사용자DB").alias("reason")))
        .when(pattern, F.struct(F.lit(True).alias("ok"), F.lit("숙어패턴").alias("reason")))
        .otherwise(F.coalesce(cached, decided))
    )


def valid_result(result: Column) -> Column:
    """Whether a JSON result is an object with the keys original and meaning."""
    keys = F.coalesce(F.json_object_keys(result), F.array().cast("array<string>"))
    return F.array_contains(keys, "original") & F.array_contains(keys, "meaning")
