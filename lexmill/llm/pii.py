"""Personal information inside free text: offset-preserving deobfuscation (problem 8).

A chain of small transducers rewrites a text into a plainer one: look-alike letters and full-width
digits, invisible characters, digits spelled as words, and the disguises of at and dot. Each rewrite
keeps, for every character of its output, the place it came from. Identifiers are found in the plain
text, and their spans are mapped back to the characters of the source. Names are told by a model of
names (:mod:`lexmill.llm.names`) that is fitted to the collection itself.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import names
from lexmill.session import spread

KINDS = ("email", "phone", "id_number", "address", "name")
#: Also found and masked, but asked for by no kind above: payment cards and bank accounts, told by their check digits.
ACCOUNTS = ("card", "iban")
#: Of overlapping finds the first stays.
RANK = {k: i for i, k in enumerate(("email", "iban", "card", "phone", "id_number", "address", "name"))}


# --- transducers -----------------------------------------------------------------------------

#: Characters that look like ASCII ones (fixed values).
LOOK_ALIKE = str.maketrans(
    "АВЕКМНОРСТХаеорсухіΑΒΕΖΗΙΚΜΝΟΡΤΥΧο‐‑‒–—−＠．（）［］＋－，：；／   　",
    "ABEKMHOPCTXaeopcyxiABEZHIKMNOPTYXo------@.()[]+-,:;/    ",
) | {0xFF10 + i: str(i) for i in range(10)} | {0xFF21 + i: chr(65 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
INVISIBLE = re.compile("[­​-‏⁠﻿]+")

DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGIT = "(?:" + "|".join(DIGITS) + ")"
#: Four or more digit words in a row, with at most a separator between them.
SPELLED = re.compile(rf"\b{_DIGIT}(?:[ ,.-]{{1,2}}{_DIGIT}){{3,}}\b", re.I)
_DIGIT_RE = re.compile(_DIGIT, re.I)

_OPEN, _CLOSE = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_AT = rf"(?:\s?@\s?|{_OPEN}at{_CLOSE}|\s+at\s+)"
_DOT = rf"(?:\.|{_OPEN}dot{_CLOSE}|\s+dot\s+)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
AT = re.compile(_AT, re.I)
DISGUISE = re.compile(r"[\[({<]\s*(?:at|dot)\s*[\])}>]|\sdot\s")
DOMAIN = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})+", re.I)
_DOT_RE = re.compile(rf"{_OPEN}dot{_CLOSE}|\s+dot\s+", re.I)


class Plain(NamedTuple):
    """A rewritten text in pieces: piece i begins at ``starts[i]`` and comes from ``sources[i]`` on.

    ``stops[i]`` is -1 for a piece taken over as it was; a piece put in stands for the source up to there.
    """

    text: str
    starts: list[int]
    sources: list[int]
    stops: list[int]

    def begin(self, place: int) -> int:
        i = bisect_right(self.starts, place) - 1
        return self.sources[i] if self.stops[i] >= 0 else self.sources[i] + place - self.starts[i]

    def end(self, place: int) -> int:
        """Where the character before ``place`` ends in the source."""
        i = bisect_right(self.starts, place - 1) - 1
        return self.stops[i] if self.stops[i] >= 0 else self.sources[i] + place - self.starts[i]


def _rewrite(plain: Plain, edits: list[tuple[int, int, str]]) -> Plain:
    """Apply edits (begin, end, new text), sorted and apart, and carry the places along."""
    if not edits:
        return plain
    out, starts, sources, stops = [], [], [], []
    length = at = 0

    def put(piece: str, source: int, stop: int) -> None:
        nonlocal length
        starts.append(length)
        sources.append(source)
        stops.append(stop)
        out.append(piece)
        length += len(piece)

    def keep(begin: int, end: int) -> None:
        while begin < end:
            i = bisect_right(plain.starts, begin) - 1
            stop = min(end, plain.starts[i + 1] if i + 1 < len(plain.starts) else end)
            put(plain.text[begin:stop], plain.begin(begin), plain.stops[i])
            begin = stop

    for begin, end, new in edits:
        keep(at, begin)
        if new:
            put(new, plain.begin(begin), plain.end(end))
        at = end
    keep(at, len(plain.text))
    return Plain("".join(out), starts or [0], sources or [0], stops or [-1])


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits: list[tuple[int, int, str]] = []
    for m in SPELLED.finditer(text):
        found = [(m.start() + d.start(), m.start() + d.end(), DIGITS[d[0].lower()]) for d in _DIGIT_RE.finditer(m[0])]
        # separators between spelled digits go, or a number would stay in pieces
        edits += [(a, found[i + 1][0] if i + 1 < len(found) else b, new) for i, (a, b, new) in enumerate(found)]
    return edits


def _local_start(text: str, at: int, floor: int) -> int:
    """Where the local part of an address that ends at ``at`` begins, however long, or -1."""
    i = at
    while i > floor and (text[i - 1].isalnum() or text[i - 1] in "_+%-."):
        i -= 1
    if text[i:at].endswith("."):
        return -1
    i = max(i, text.rfind("..", i, at) + 2) if ".." in text[i:at] else i
    i += text[i:at].startswith(".")
    return i if i < at else -1


def _disguised(text: str, low: str) -> list[tuple[int, int, str]]:
    # implied by the patterns: what holds none of these holds no edit
    if not ("@" in text or DISGUISE.search(low)):
        return []
    edits: list[tuple[int, int, str]] = []
    done = 0
    for m in AT.finditer(text):
        domain = DOMAIN.match(text, m.end())
        if m.start() < done or not domain or _local_start(text, m.start(), done) < 0:
            continue
        dots = [(m.end() + d.start(), m.end() + d.end(), ".") for d in _DOT_RE.finditer(domain[0])]
        if not dots and m[0].strip().lower() == "at":
            continue  # "at school.test" in running text
        if m[0] != "@":
            edits.append((m.start(), m.end(), "@"))
        edits += dots
        done = domain.end()
    return edits


def plain(text: str) -> Plain:
    """The text without disguises, with the way back to its characters."""
    p = Plain(text if text.isascii() else text.translate(LOOK_ALIKE), [0], [0], [-1])
    if not text.isascii():
        p = _rewrite(p, [(m.start(), m.end(), "") for m in INVISIBLE.finditer(p.text)])
    low = _lower(p.text)
    # four digit words can only stand where four of them are
    if sum(map(low.count, ("zero", "oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"))) > 3:
        p = _rewrite(p, _spelled(p.text))
        low = _lower(p.text)
    return _rewrite(p, _disguised(p.text, low))


# --- detection -------------------------------------------------------------------------------

HOST = re.compile(rf"{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,}}(?![\w@])")

_N = r"(?<![\w.:/@-])(?<!\d[ .-])"
_E = r"(?![\w@]|[.:/-]\d)"
PHONE = re.compile(
    rf"{_N}(?:"
    r"\+\d{1,3}[ .-]?(?:\(0?\d{0,3}\)[ .-]?\d{0,3}|\d{1,3})(?:[ .-]?\d{3,4}){2}"  # international
    r"|\(0?\d{2,3}\) ?\d{3,4}[ .-]\d{4}"  # area in brackets
    r"|01[016789](?P<a>[ .-]?)\d{3,4}(?P=a)\d{4}"  # mobile
    r"|0\d{1,2}(?P<b>[ .-])\d{3,4}(?P=b)\d{4}"  # area, national prefix
    r"|(?:1[ .-])?[2-9]\d{2}(?P<c>[ .-])\d{3}(?P=c)\d{4}"  # area, seven digits, perhaps after the country's 1
    rf"){_E}"
)
_MONTH_DAY = r"(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"
ID_NUMBER = re.compile(
    rf"{_N}(?:"
    rf"\d{{2}}{_MONTH_DAY}(?: ?- ?)?\d{{7}}"  # birth date and seven digits
    r"|\d{3}(?P<d>[ -])\d{2}(?P=d)\d{4}"  # three, two, four
    r"|[A-Z]\d{8}"  # passport
    rf"){_E}"
)
_SUFFIX = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Drive|Dr|Boulevard|Blvd|Place|Pl|Square|Way|Terrace|Close)"
ADDRESS = re.compile(
    rf"(?<![\w.:/-])(?:(?:Flat|Apt|Apartment|Unit|FLAT|APT|UNIT)\.? ?\d{{1,4}}[A-Z]?, ?)?\d{{1,5}}[A-Z]? "
    rf"(?:(?:[A-Z][a-z]+ ){{1,3}}{_SUFFIX}|(?:[A-Z]+ ){{1,3}}{_SUFFIX.upper()})\b\.?"
    rf"(?:, ?(?:Apt|Flat|Unit|APT|FLAT|UNIT)\.? ?\d{{1,4}}[A-Z]?)?(?:(?:, ?|\n)[A-Z][A-Za-z]+(?: \d{{5}}\b)?)?"
)
ADDRESS_KO = re.compile(r"(?<!\w)(?:[가-힣]{1,12}(?:시|도) )(?:[가-힣]{1,12}(?:시|군|구) )?(?:[가-힣]{1,12}(?:읍|면|동) )?[가-힣0-9]{1,20}(?:로|길) ?\d{1,5}(?:-\d{1,4})?(?!\d)")

class Hit(NamedTuple):
    kind: str
    start: int  # from 0, in the source
    end: int


#: Streets whose number comes last.
ADDRESS_EU = re.compile(
    r"(?<![\w.:/-])(?:[A-ZÄÖÜ][a-zäöüß]*(?:straße|strasse|str\.|weg|platz|allee|gasse|damm|ufer) \d{1,4}[a-z]?"
    r"|(?:[A-ZÄÖÜ][a-zäöüß]+[ -]){1,3}(?:Straße|Strasse|Str\.|Weg|Platz|Allee|Gasse) \d{1,4}[a-z]?"
    r"|(?:Via|Viale|Calle|Avenida|Plaza|Rua) (?:d[aeo]l? )?[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)*,? \d{1,4})(?!\w)"
    r"(?:, (?:\d{4,5} )?[A-ZÄÖÜ][a-zäöüß]+)?"
)
ADDRESS_FR = re.compile(r"\d{1,4}(?:bis|ter)?,? (?:rue|avenue|boulevard|place|quai) (?:d[eu]s? )?(?:la )?(?:l['’])?[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)*")
CARD = re.compile(r"(?<![\w.:/-])(?<!\d[ .-])(?:[3-6]\d{3}(?P<s>[ -]?)\d{4}(?P=s)\d{4}(?P=s)\d{4}(?:(?P=s)\d{1,3})?|3[0-9]\d{2}(?P<t>[ -]?)\d{6}(?P=t)\d{4,5})(?![\w@]|[ .:/-]\d)")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")


def _capitalised_before(text: str, at: int, floor: int) -> int:
    """Where the capitalised words (and da, del and the like between them) before ``at`` begin."""
    begin = end = at - 1
    while end > floor:
        i = max(text.rfind(" ", floor, end) + 1, floor)
        i = max(i, text.rfind("\n", i, end) + 1)
        word = text[i:end]
        if word[:1].isupper():
            begin = i
        elif word not in ("do", "da", "dal", "del", "dol"):
            break
        if i == 0 or text[i - 1] == "\n":
            break
        end = i - 1
    return begin if begin < at - 1 else at


def luhn(number: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def mod97(account: str) -> bool:
    """Whether the two check digits of a bank account number are right."""
    plain_ = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain_[4:] + plain_[:4])) % 97 == 1


DIGIT_RUN = re.compile(r"\d+")
UNIT_BEFORE = re.compile(r"(?<!\w)(?:Flat|Apt|Apartment|Unit|FLAT|APT|UNIT)\.? ?$")


def _numbers(p: Plain) -> list[tuple[int, int, str]]:
    text = p.text
    spans: list[tuple[int, int, str]] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        host, local = HOST.match(text, at + 1), _local_start(text, at, floor)
        if host and local >= 0:
            spans.append((local, host.end(), "email"))
        at, floor = text.find("@", at + 1), at + 1
    # all the others hold digits: looked for only where digits are
    if "로" in text or "길" in text:
        spans += [(m.start(), m.end(), "address") for m in ADDRESS_KO.finditer(text)]
    done = {"id_number": 0, "phone": 0, "address": 0}
    for run in DIGIT_RUN.finditer(text):
        i, long = run.start(), run.end() - run.start() > 1
        tries: list[tuple[str, re.Pattern, int]] = []
        before = text[i - 1 : i]
        mark = before != "" and before in "+("
        if long:
            tries.append(("id_number", ID_NUMBER, i - 1 if before.isalpha() else i))
        if long or mark or run[0] == "1":
            tries.append(("phone", PHONE, i - 1 if mark else i))
        unit = UNIT_BEFORE.search(text, max(0, i - 12), i)  # matches 11 characters at most, and one is looked at before
        tries.append(("address", ADDRESS, unit.start() if unit else i))
        if before == " " and text[i - 2 : i - 1].isalpha() or text[i - 2 : i] == ". ":
            begin = _capitalised_before(text, i, done["address"])
            if begin < i and (m := ADDRESS_EU.search(text, begin)) and m.start() < i < m.end():
                spans.append((m.start(), m.end(), "address"))
                done["address"] = m.end()
        if (m := ADDRESS_FR.match(text, i)) and i >= done["address"]:
            spans.append((m.start(), m.end(), "address"))
            done["address"] = m.end()
        if run.end() - i >= 4 and (m := CARD.match(text, i)) and luhn(m[0]):
            spans.append((m.start(), m.end(), "card"))
        if run.end() - i == 2 and i > 1 and text[i - 2 : i].isupper() and (m := IBAN.match(text, i - 2)) and mod97(m[0]):
            spans.append((m.start(), m.end(), "iban"))
        for kind, pattern, begin in tries:
            if begin >= done[kind] and (m := pattern.match(text, begin)):
                spans.append((m.start(), m.end(), kind))
                done[kind] = m.end()
    return spans


def detect(text: str, model: names.NameModel = names.EMPTY) -> list[Hit]:
    """Everything found in one text, by place; of overlapping finds the first kind of :data:`RANK` stays."""
    p = plain(text)
    spans = _numbers(p)
    spans += [(a, b, "name") for a, b in names.find(p.text, model, [(a, b) for a, b, _ in spans])]
    spans.sort(key=lambda s: (RANK[s[2]], s[0], -s[1]))
    begins: list[int] = []  # of the spans taken, which lie apart, in order
    taken: list[tuple[int, int, str]] = []
    for begin, end, kind in spans:
        i = bisect_right(begins, begin)
        if (i and taken[i - 1][1] > begin) or (i < len(taken) and begins[i] < end):
            continue
        begins.insert(i, begin)
        taken.insert(i, (begin, end, kind))
    return [Hit(kind, p.begin(a), p.end(b)) for a, b, kind in taken]


PLACEHOLDER = {k: f"[{k.upper()}]" for k in RANK}


def redact(text: str, hits: list[Hit]) -> str:
    """The text with a typed placeholder in the place of each find."""
    out, at = [], 0
    for h in hits:
        out += [text[at : h.start], PLACEHOLDER[h.kind]]
        at = h.end
    return "".join([*out, text[at:]])


def _find(batches: Iterator[pa.RecordBatch], model: names.NameModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, kind, start, length = [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            for h in detect(text, model) if text else ():
                at.append(i)
                kind.append(h.kind)
                start.append(h.start + 1)
                length.append(h.end - h.start)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int64())), pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(length, pa.int32())],
            names=["doc_id", "kind", "start_pos", "n_chars"],
        )


def occurrences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: names.NameModel | None = None) -> DataFrame:
    """(doc_id, kind, start_pos, n_chars): one row for each find, places counted in characters from 1.

    The model of names is fitted to ``df`` itself unless one is given. Null and empty texts hold nothing;
    repeated rows each give their rows; texts are read whole, however long, each by itself, so
    nothing but word counts of the fit is shuffled; no other columns are read. An empty table gives an empty result.
    """
    source = df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).filter(F.col(text_col).isNotNull())
    shared = df.sparkSession.sparkContext.broadcast(model or names.fit(df, text_col))
    return spread(source).mapInArrow(lambda b: _find(b, shared.value), "doc_id bigint, kind string, start_pos int, n_chars int")


def _mask(batches: Iterator[pa.RecordBatch], model: names.NameModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for text in batch.column(1).to_pylist():
            hits = detect(text, model) if text else []
            texts.append(redact(text, hits) if hits else text)
            counts.append(len(hits))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "n_found"])


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: names.NameModel | None = None) -> DataFrame:
    """(doc_id, text, n_found): every row, its text with placeholders such as [EMAIL]; a null text stays null."""
    source = df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    shared = df.sparkSession.sparkContext.broadcast(model or names.fit(df, text_col))
    return spread(source).mapInArrow(lambda b: _mask(b, shared.value), "doc_id bigint, text string, n_found int")


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: names.NameModel | None = None) -> DataFrame:
    """(doc_id, kind, start_pos) of each find of the kinds of :data:`KINDS`."""
    return occurrences(df, id_col, text_col, model).filter(F.col("kind").isin(*KINDS)).select("doc_id", "kind", "start_pos")
