"""Several values packed in one field: dictionary-guided segmentation (problem 2).

A field is cut at every possible divider into atoms. A multi-pattern automaton finds the known whole
values in it, and dynamic programming picks the best cover of the field by values: an atom by
itself, something quoted, or a known value that spans several atoms and so keeps its dividers.

The dictionary is learned from the collection: values that stand in quotes somewhere, or as elements
of lists, are whole values with a support; what a known value gains over its atoms is the
log-likelihood of the one against the others under the supports of the collection.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import spread, written

#: What divides values (fixed values); a dash does so between spaces only.
DIVIDER = re.compile(r"[,;|/\t\r\n·、，；／｜•]|(?<=\s)[-–—](?=\s)")
MAY_DIVIDE = re.compile(r"[,;|/\t\r\n·、，；／｜•\[(]|\s[-–—]\s|\b1[.)]\s")
NUMBER = re.compile(r"(?:(?<=\s)|^)(?:\((\d{1,4})\)|(\d{1,4})[.)])(?=\s)")
PAIRS = {"[": "]", "(": ")", "{": "}", "<": ">", "「": "」", '"': '"', "'": "'", "“": "”", "‘": "’"}
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}
AFTER_QUOTE = re.compile(rf"\s*(?:$|{DIVIDER.pattern})")
SPACES = re.compile(r"\s\s|[^\S ]")
#: What a value of a given table, without supports, gains over its atoms.
GIVEN_GAIN = 1.0

#: Of the atoms of a field, the spans (first, last) that are known values, with their gains.
Known = dict[tuple[int, int], float]


def folded(text: str) -> tuple[str, list[int] | range]:
    """Lower case with single spaces, and for each character its place in ``text``; some capitals become two characters."""
    low = text.lower()
    if len(low) == len(text) and not SPACES.search(text):
        return low, range(len(text))
    out: list[str] = []
    at: list[int] = []
    space = False
    for i, c in enumerate(text):
        if c.isspace():
            if not space:
                out.append(" ")
                at.append(i)
        else:
            new = c.lower()
            out.append(new)
            at += [i] * len(new)
        space = c.isspace()
    return "".join(out), at


def fold(value: str) -> str:
    return folded(value.strip())[0]


def automaton(known: dict[str, float] | list[str]) -> ahocorasick.Automaton | None:
    """Of known whole values, folded; those without a divider can't change a cover and are left out."""
    found = ahocorasick.Automaton()
    for value in known:
        low = fold(value)
        if low and DIVIDER.search(low):
            found.add_word(low, (len(low), known[value] if isinstance(known, dict) else GIVEN_GAIN))
    if not len(found):
        return None
    found.make_automaton()
    return found


def _closing(text: str, at: int) -> int:
    """Place of the quote that closes the one at ``at``, or -1; it must stand before a divider or the end."""
    close = QUOTES[text[at]]
    i = at + 1
    while (i := text.find(close, i)) >= 0:
        if close == '"' and text[i + 1 : i + 2] == '"':
            i += 2  # a doubled quote stands for one
            continue
        if AFTER_QUOTE.match(text, i + 1):
            return i
        i += 1
    return -1


def _bare(piece: str) -> str:
    """Without outer spaces, one pair of enclosing brackets and one of quotes."""
    piece = piece.strip()
    for _ in range(2):
        if len(piece) > 1 and PAIRS.get(piece[0]) == piece[-1]:
            inner = piece[1:-1]
            # "(a) and (b)" is not enclosed
            if piece[0] in QUOTES or (piece[0] not in inner and piece[-1] not in inner):
                piece = (inner.replace('""', '"') if piece[0] == '"' else inner).strip()
    return piece


def _atoms(text: str) -> list[tuple[int, int, bool]]:
    """(begin, end, quoted) of the pieces between dividers."""
    atoms, at, n = [], 0, len(text)
    while at <= n:
        begin = at
        while begin < n and text[begin].isspace() and not DIVIDER.match(text, begin):
            begin += 1
        close = _closing(text, begin) if begin < n and text[begin] in QUOTES else -1
        if close >= 0:
            m = DIVIDER.search(text, close + 1)
            atoms.append((begin, close + 1, True))
        else:
            m = DIVIDER.search(text, at)
            atoms.append((at, m.start() if m else n, False))
        if not m:
            break
        at = m.end()
    return atoms


def _trimmed(text: str, begin: int, end: int) -> tuple[int, int]:
    piece = text[begin:end]
    return begin + len(piece) - len(piece.lstrip()), end - len(piece) + len(piece.rstrip())


def by_automaton(words: ahocorasick.Automaton | None) -> Callable[[str, list[tuple[int, int, bool]]], Known]:
    """Finds known values in a piece of a field, given its atoms; those must begin and end where atoms do."""

    def find(text: str, atoms: list[tuple[int, int, bool]]) -> Known:
        if words is None or len(atoms) == 1:
            return {}
        low, place = folded(text)
        begins = {_trimmed(text, a, b)[0]: i for i, (a, b, quoted) in enumerate(atoms) if not quoted}
        ends = {_trimmed(text, a, b)[1]: i for i, (a, b, quoted) in enumerate(atoms) if not quoted}
        found: Known = {}
        for last, (length, gain) in words.iter(low):
            i, j = begins.get(place[last + 1 - length]), ends.get(place[last] + 1)
            if i is not None and j is not None and i < j:
                found[i, j] = gain
        return found

    return find


def _cover(text: str, find: Callable[[str, list[tuple[int, int, bool]]], Known]) -> list[str]:
    """The cover of most gain; of equal ones that of most values."""
    atoms = _atoms(text)
    known = find(text, atoms)
    if not known:
        return [text[a:b] for a, b, _ in atoms]
    quoted = [0]
    for _, _, q in atoms:
        quoted.append(quoted[-1] + q)
    into: dict[int, list[tuple[int, float]]] = {}
    for (i, j), gain in known.items():
        if quoted[i] == quoted[j + 1]:  # never across something quoted
            into.setdefault(j, []).append((i, gain))
    best: list[tuple[float, int]] = [(0.0, 0)]
    for j in range(len(atoms)):
        options = [(best[j][0], j)] + [(best[i][0] + gain, i) for i, gain in into.get(j, ())]
        best.append(max(options))
    out, j = [], len(atoms)
    while j:
        i = best[j][1]
        out.append(text[atoms[i][0] : atoms[j - 1][1]])
        j = i
    return out[::-1]


def pieces_of(field: str) -> list[str]:
    """The parts of a field that are cut on their own: all of it, or what stands between list numbers."""
    text = field.strip()
    if text[:1] in "[({" and text and PAIRS[text[0]] == text[-1] and text[0] not in text[1:] and text[-1] not in text[:-1]:
        text = text[1:-1].strip()
    numbers = list(NUMBER.finditer(text))
    if numbers and numbers[0].start() == 0 and [int(m[1] or m[2]) for m in numbers] == list(range(1, len(numbers) + 1)):
        ends = [m.start() for m in numbers[1:]] + [len(text)]
        return [text[m.end() : e].strip() for m, e in zip(numbers, ends)]
    return [text]


def split_values(field: str | None, known: ahocorasick.Automaton | None = None, find: Callable | None = None) -> list[str]:
    """The values of one field, in order, without empty ones."""
    if field is None:
        return []
    if not MAY_DIVIDE.search(field.strip()):
        return [v] if (v := _bare(field)) else []
    find = find or by_automaton(known)
    return [v for piece in pieces_of(field) for part in _cover(piece, find) if (v := _bare(part))]


# --- the dictionary --------------------------------------------------------------------------


def _whole_values(batches: Iterator[pa.RecordBatch], flush_at: int) -> Iterator[pa.RecordBatch]:
    """Counts of the values of fields as their quotes and dividers give them; those with a divider come with their atoms."""
    counts: Counter[str] = Counter()
    atoms: dict[str, list[str]] = {}

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([atoms.get(v) for v in counts], pa.list_(pa.string()))],
            names=["value", "support", "atoms"],
        )

    for batch in batches:
        for column in batch.columns:
            for field, n in Counter(column.to_pylist()).items():
                for value in split_values(field) if isinstance(field, str) else ():
                    low = fold(value)
                    counts[low] += n
                    if low not in atoms and DIVIDER.search(low):
                        atoms[low] = [fold(low[a:b]) for a, b, _ in _atoms(low) if low[a:b].strip()]
            if len(counts) >= flush_at:
                yield flush()
                counts.clear()
                atoms.clear()
    if counts:
        yield flush()


def _list_values(lists: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    every = lists.select(F.explode(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns])).alias("value"))
    return every.filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))


def _as_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fold(v) for v in batch.column(0).to_pylist()]
        atoms = [[fold(v[a:b]) for a, b, _ in _atoms(v) if v[a:b].strip()] if DIVIDER.search(v) else None for v in values]
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), batch.column(1), pa.array(atoms, pa.list_(pa.string()))], names=["value", "support", "atoms"])


VALUES = "value string, support bigint, atoms array<string>"


def learned(df: DataFrame, fields: tuple[str, ...] = ("synonyms", "antonyms"), lists: DataFrame | None = None, flush_at: int = 200_000) -> DataFrame:
    """(value, support, gain) of the values with a divider that are whole somewhere: in quotes, or as an element of a list of ``lists``.

    ``gain`` is how much likelier the whole value is than its atoms side by side, as a difference of logarithms
    under the supports of all values of the collection; values whose atoms are likelier are left out.
    Nulls count nowhere; repeated rows each count; an empty table teaches nothing.
    """
    partial = spread(df.select(*[F.col(f).cast("string") for f in fields])).mapInArrow(lambda b: _whole_values(b, flush_at), VALUES)
    if lists is not None:
        partial = partial.unionByName(_list_values(lists, fields).mapInArrow(_as_whole, VALUES))
    values = written(partial.groupBy("value").agg(F.sum("support").alias("support"), F.first("atoms", ignorenulls=True).alias("atoms")), "values")
    total = float(values.agg(F.sum("support")).first()[0] or 1)
    whole = values.filter("atoms IS NOT NULL")
    one = whole.select("value", F.posexplode("atoms").alias("i", "atom"))
    stored = values.select(F.col("value").alias("atom"), F.col("support").alias("n"))
    apart = one.join(stored, "atom", "left").groupBy("value").agg(F.sum(F.log(F.lit(total) / (F.coalesce("n", F.lit(0)) + 0.5))).alias("cost"))
    gain = F.col("cost") - F.log(F.lit(total) / F.col("support"))
    return written(whole.select("value", "support").join(apart, "value").select("value", "support", gain.alias("gain")).filter("gain > 0"), "known")


def given(known: DataFrame) -> DataFrame:
    """A one-column table of whole values as a dictionary; null and blank ones are passed over."""
    value = F.col(known.columns[0]).cast("string")
    return known.select(value.alias("value"), F.lit(1).cast("bigint").alias("support"), F.lit(GIVEN_GAIN).alias("gain")).filter("length(trim(value)) > 0")


def _spans(batches: Iterator[pa.RecordBatch], widest: int) -> Iterator[pa.RecordBatch]:
    """Of each distinct field the runs of up to ``widest`` atoms, folded."""
    for batch in batches:
        rows: list[tuple[str, int, int, int, str]] = []
        for field in batch.column(0).to_pylist():
            for k, piece in enumerate(pieces_of(field)):
                atoms = _atoms(piece)
                for i in range(len(atoms)):
                    for j in range(i + 1, min(len(atoms), i + widest)):
                        rows.append((field, k, i, j, fold(piece[atoms[i][0] : atoms[j][1]])))
        columns = list(zip(*rows)) or [()] * 5
        types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["field", "piece", "first", "last", "span"])


OUT = "entry_id bigint, field_name string, item_no int, item string"


def unpack(
    df: DataFrame,
    fields: tuple[str, ...] = ("synonyms", "antonyms"),
    id_col: str = "entry_id",
    known: DataFrame | None = None,
    lists: DataFrame | None = None,
    min_values: int = 2,
    broadcast_known: int = 500_000,
) -> DataFrame:
    """(entry_id, field_name, item_no, item): one row for each value of fields that hold ``min_values`` or more.

    ``known``: a dictionary as :func:`learned` or :func:`given` makes it; without one it is learned from ``df`` and
    ``lists``. Null, blank and single-valued fields give no row, empty pieces are skipped and don't count,
    repeated values and repeated rows stay, very long fields are read whole, an empty table gives an
    empty result, and no other columns are read.

    Up to ``broadcast_known`` dictionary values with a divider become an automaton in each worker. Of more,
    the runs of atoms of each distinct field are joined with the dictionary by shuffle; the rows are the same.
    """
    spark = df.sparkSession
    dictionary = known if known is not None else learned(df, fields, lists)
    held = dictionary.filter(F.col("value").rlike(r"[,;|/\t\r\n·、，；／｜•]|\s[-–—]\s"))
    rows = held.select("value", "gain").limit(broadcast_known + 1).collect() if broadcast_known else held.limit(1).collect()
    source = df.select(F.col(id_col).cast("bigint").alias("entry_id"), *[F.col(f).cast("string").alias(f) for f in fields])
    if len(rows) <= broadcast_known:
        shared = spark.sparkContext.broadcast({r["value"]: r["gain"] for r in rows})

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = by_automaton(automaton(shared.value))
            split = lru_cache(maxsize=50_000)(lambda text: tuple(split_values(text, find=find)))
            for batch in batches:
                row, name, no, item = [], [], [], []
                for f, field in enumerate(fields):
                    for i, text in enumerate(batch.column(1 + f).to_pylist()):
                        if not text:
                            continue
                        found = split(text) if len(text) < 200 else split_values(text, find=find)
                        if len(found) >= min_values:
                            row += [i] * len(found)
                            name += [field] * len(found)
                            no += range(1, len(found) + 1)
                            item += found
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(name, pa.string()), pa.array(no, pa.int32()), pa.array(item, pa.string())],
                    names=["entry_id", "field_name", "item_no", "item"],
                )

        return spread(source).mapInArrow(cut, OUT)
    return _unpack_by_join(source, fields, held, min_values)


def _unpack_by_join(source: DataFrame, fields: tuple[str, ...], held: DataFrame, min_values: int) -> DataFrame:
    # what a worker folds is what stands in the dictionary
    folds = held.select("value", "gain").mapInArrow(
        lambda bs: (pa.RecordBatch.from_arrays([pa.array([fold(v) for v in b.column(0).to_pylist()], pa.string()), b.column(1)], names=["span", "gain"]) for b in bs), "span string, gain double"
    )
    values = written(folds.groupBy("span").agg(F.max("gain").alias("gain")), "known")
    n_dividers = F.length("span") - F.length(F.regexp_replace("span", r"[,;|/\t\r\n·、，；／｜•\-–—]", ""))
    widest = (values.agg(F.max(n_dividers)).first()[0] or 0) + 1
    stacked = source.select("entry_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields))).alias("field_name", "field"))
    stacked = stacked.filter("field IS NOT NULL AND field <> ''")
    spans = stacked.select("field").distinct().mapInArrow(lambda b: _spans(b, widest), "field string, piece int, first int, last int, span string")
    # the matches of one field are bounded by its length
    matched = spans.join(values, "span").groupBy("field").agg(F.collect_list(F.struct("piece", "first", "last", "gain")).alias("matches"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, no, item = [], [], []
            for i, (text, matches) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                by_piece: dict[int, Known] = {}
                for m in matches or ():
                    by_piece.setdefault(m["piece"], {})[m["first"], m["last"]] = m["gain"]
                if MAY_DIVIDE.search(text.strip()):
                    found = [v for k, piece in enumerate(pieces_of(text)) for part in _cover(piece, lambda *_: by_piece.get(k, {})) if (v := _bare(part))]
                else:
                    found = split_values(text)
                if len(found) >= min_values:
                    row += [i] * len(found)
                    no += range(1, len(found) + 1)
                    item += found
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(no, pa.int32()), pa.array(item, pa.string())], names=["entry_id", "field_name", "item_no", "item"])

    return stacked.join(matched, "field", "left").select("entry_id", "field_name", "field", "matches").mapInArrow(cut, OUT)
