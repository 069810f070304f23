"""Text functions as Spark columns: cleaning, tokens, n-grams, contexts, meanings, coercions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import fixed

SPACE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without outer white space of any kind (trim takes spaces only)."""
    return F.regexp_replace(c, SPACE, "")


def clean_text(c: Column) -> Column:
    """Lower case; what is no letter, digit, underscore, apostrophe, hyphen or space becomes a space; null becomes ''."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_\s'-]", " ")
    return F.trim(F.lower(F.regexp_replace(spaced, r"\s+", " ")))


def tokens(c: Column) -> Column:
    """Words of two or more letters, contractions split as in the Treebank rules; n-grams bridge what is dropped."""
    t = F.concat(F.lit(" "), clean_text(c), F.lit(" "))
    t = F.regexp_replace(t, "--+", " ")
    t = F.regexp_replace(t, r" cannot ", " can not ")
    t = F.regexp_replace(t, r"n't ", " ")
    t = F.regexp_replace(t, r"'(s|m|d|ll|re|ve)? ", " ")
    return F.filter(F.split(t, r"\s+"), lambda w: w.rlike(r"^\p{L}{2,}$"))


def ngrams(toks: Column, n: int) -> Column:
    """All runs of n tokens, joined by a space."""
    count = F.size(toks) - (n - 1)
    joined = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(toks, i, n), " "))
    return F.when(count >= 1, joined).otherwise(F.array().cast("array<string>"))


def sentence_context(text: Column, start: Column, end: Column) -> Column:
    """Text between the full stops around [start, end), counted from 0."""
    left = F.substring_index(F.substring(text, 1, start), ".", -1)
    right = F.substring_index(F.substring(text, end + 1, F.length(text)), ".", 1)
    return strip(F.concat(left, F.substring(text, start + 1, end - start), right))


def preview(c: Column, n: int = 100) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def clean_definition(word: Column, text: Column) -> Column:
    """Quotes away; for single words also all runs of three or more ASCII letters."""
    bare = strip(F.regexp_replace(text, "[\"']", ""))
    return F.when(F.contains(word, F.lit(" ")), bare).otherwise(strip(F.regexp_replace(bare, "[a-zA-Z]{3,}", "")))


def clean_meaning(word: Column, text: Column) -> Column:
    """A usable Korean meaning, or the generic one."""
    t = text
    for label in fixed.MEANING_LABELS:
        t = strip(F.replace(t, F.lit(label), F.lit("")))
    t = F.regexp_replace(t, "^[\"']+|[\"']+$", "")
    bad = t.rlike("[a-zA-Z]") | (F.length(t) > 20) | (F.length(t) < 1)
    return F.when(bad, F.concat(word, F.lit(fixed.GENERIC_MEANING))).otherwise(t)


def whitelist_clean(c: Column) -> Column:
    """Letters, digits, underscore, space and common marks only, white space collapsed."""
    kept = F.regexp_replace(c, r"[^\p{L}\p{N}_\s.,!?;:'\"()-]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def simple_pos(c: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for tag, label in fixed.SIMPLE_POS.items():
        out = out.when(c == tag, label)
    return out.otherwise(fixed.OTHER_POS)


def pos_letter(c: Column) -> Column:
    """n, v, a or r of a label in any case, Korean labels too; other labels stay, in lower case."""
    low = F.lower(strip(c))
    out = F.when(F.lit(False), F.lit(""))
    for letter, labels in fixed.POS_LETTERS.items():
        out = out.when(low.isin(*labels.split()), letter)
    return out.otherwise(low)


def missing(c: Column) -> Column:
    """Null, blank, or a text that stands for null."""
    return F.coalesce(F.lower(strip(c)).isin(*fixed.MISSING_TEXTS), F.lit(True))


def to_bool(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(*fixed.TRUE_TEXTS), F.lit(False))


def to_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(F.floor(strip(c.cast("string")).try_cast("double")).try_cast("bigint"), F.lit(default))


def to_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(strip(c.cast("string")).try_cast("double"), F.lit(default))


def to_list(c: Column) -> Column:
    """Comma text to a list without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda w: F.length(w) > 0)


def in_list(c: Column, values) -> Column:
    return c.isin(*values)


def fenced_json(c: Column) -> Column:
    """What stands in a fenced json block, else the text itself."""
    inside = strip(F.regexp_extract(c, r"(?s)```json(.*?)```", 1))
    return F.when(F.length(inside) > 0, inside).otherwise(strip(c))


def cache_key(word: Column, context: Column, pos: Column | None = None, n: int = 50) -> Column:
    """word:context[:n]:pos, nulls as blanks."""
    parts = [word, F.substring(F.coalesce(context, F.lit("")), 1, n)] + ([F.coalesce(pos, F.lit(""))] if pos is not None else [])
    return F.concat_ws(":", *parts)


def parse_json(c: Column, fields: dict[str, str]) -> Column:
    """STRUCT of the fields (name to type) of a JSON answer, fenced or not; if it is broken, simple fields are read one by one."""
    body = fenced_json(c)
    parsed = F.from_json(body, ", ".join(f"{k} {t}" for k, t in fields.items()))

    def salvaged(name: str, kind: str) -> Column:
        if kind == "string":
            found = F.regexp_extract(body, rf'"{name}"\s*:\s*"([^"]*)"', 1)
        elif kind.startswith("array"):
            inside = F.regexp_extract(body, rf'"{name}"\s*:\s*\[([^\]]*)\]', 1)
            return F.filter(F.transform(F.split(inside, ","), lambda w: strip(F.regexp_replace(w, '"', ""))), lambda w: F.length(w) > 0)
        else:
            found = F.regexp_extract(body, rf'"{name}"\s*:\s*([-\w.]+)', 1)
        return F.nullif(found, F.lit("")).try_cast(kind)

    return F.struct(*[F.coalesce(parsed[k], salvaged(k, t)).alias(k) for k, t in fields.items()])


def clean_list(c: Column, most: int = 3) -> Column:
    """Comma text to comma text: values of two characters or more, the first ``most``, joined by a comma and a space."""
    return F.array_join(F.slice(F.filter(to_list(c), lambda w: F.length(w) > 1), 1, most), ", ")


def labelled_lists(c: Column) -> Column:
    """STRUCT<synonyms, antonyms> of an answer in lines such as ``동의어: a, b`` or ``Antonyms: c``, without spaces; the last of several lines holds."""

    def of(labels: str) -> Column:
        found = F.regexp_extract_all(c, F.lit(rf"(?m)^\s*(?:{labels}):(.*)$"), F.lit(1))
        return F.regexp_replace(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")), r"\s+", "")

    return F.struct(of("동의어|Synonyms").alias("synonyms"), of("반의어|Antonyms").alias("antonyms"))


def text_lists(c: Column) -> Column:
    """STRUCT<synonyms, antonyms> of any answer with lines that name them before a colon; cleaned, the last of several lines holds."""

    def of(name: str) -> Column:
        found = F.regexp_extract_all(c, F.lit(rf"(?mi)^(?=.*{name})[^:\n]*:(.*)$"), F.lit(1))
        last = strip(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")))
        return clean_list(F.regexp_replace(last, '^"+|"+$', ""))

    return F.struct(of("synonyms").alias("synonyms"), of("antonyms").alias("antonyms"))


def md5_suffix(c: Column, n: int = 8) -> Column:
    """The first ``n`` hexadecimal digits of the md5, as in the names of cache files."""
    return F.substring(F.md5(c.cast("binary")), 1, n)
