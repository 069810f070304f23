"""A model of personal names, fitted to a collection without labels (part of problem 8).

Names are looked for by their form: two or three capitalised words or initials in a row, a family
name with a given name after a comma, or a Hangul word of two to five syllables. Whether such a
candidate is a name is a sum of evidence, none of it tied to a sentence frame:

* how often each of its words stands in candidates at all, over the whole collection (ordinary
  words, places and sentence openers mostly stand elsewhere);
* letter n-grams of words that follow a title (Mr., Dr., 학생, ...) or mostly stand in candidates, against
  those of ordinary words;
* a title, an identifier right beside it, a preposition of place before it, words of organisations.

All statistics are sums over all documents; what is sent to the workers is bounded by its
definition: words that make up at least ``LEAST_SHARE`` of all words (so at most 1 / LEAST_SHARE)
and a table of ``2^GRAM_BITS`` weights.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import spread, written

GRAM_BITS = 15
LEAST_SHARE = 1e-6

#: Titles (fixed values); those in Hangul stand before or after a name.
TITLES = frozenset("Mr Mrs Ms Miss Mx Dr Prof Sir Teacher Coach Professor Doctor Tutor Principal Captain Judge President Director Nurse".split())
TITLE_BEFORE = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof)\. ?$")
TITLE_MAX = 7  # longest text that TITLE_BEFORE can match
KO_TITLES = ("학생", "교사", "선생님", "선생", "교수", "박사", "강사", "원장", "코치")
KO_TITLE_BEFORE = re.compile(rf"(?<![가-힣])(?:{'|'.join(KO_TITLES)})[ :]{{1,2}}$")
KO_TITLE_AFTER = re.compile(rf" ?(?:씨|님|{'|'.join(KO_TITLES)})(?![가-힣])")
KO_TITLE_MAX = 5
#: Common Korean family names (fixed values).
KO_FAMILY = frozenset("김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허남심노하곽성차주우구민유나진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국은편용예경봉사부")
#: Labels of forms (fixed values).
KO_LABELS = frozenset("전화 전화번호 주소 연락처 이름 성명 담당 담당자 번호 학번 이메일 메일 휴대폰 주민등록번호 보호자 문의".split())
KO_ENDINGS = tuple("은는을를에의로고서다도면며니까게지만들란")

#: Words that open a sentence, a salutation or a request, and are no part of a name (fixed values).
OPENERS = frozenset(
    "the a an in on at of for from to by with and or but if when while as after before since because although though however so then than that this these those "
    "there here he she it we they you i my his her our their its your no not nor yet once what which who whom whose why how where do does did is are was were be "
    "can could would shall should might must have has had dear hi hello hey thanks thank ring call contact ask tell email mail write see meet signed regards "
    "sincerely yours best cheers let please yes every each many most some any all both few several such reviewer editor author".split()
)
#: Words of places, schools, publishers and books (fixed values): what holds or precedes one of them is no person.
NO_PERSON = frozenset(
    "press school library street road avenue lane court drive boulevard blvd square terrace park reading set unit room section level volume book books edition "
    "publisher publishing academy college university institute center centre club society house hall hospital church museum company corporation inc ltd bank "
    "river lake mountain island county city town village region province question questions read choose answer answers grade class part chapter lesson exam test "
    "number item page figure table track slide address tel phone call contact send return mail lost follow monday tuesday wednesday thursday friday saturday "
    "sunday january february march april june july august september october november december".split()
)
#: Those of them that may as well open the next sentence.
REQUESTS = frozenset("read answer answers choose call contact send return mail lost follow".split())
PLACE_BEFORE = re.compile(r"(?<!\w)(?:in|at|near|around|across|outside|inside|toward|towards|visit|visited)\s$", re.I)
PLACE_MAX = 9

_W = r"\p{Lu}\p{Ll}+(?:['’](?!s\b)\p{Lu}?\p{Ll}+)?"
ELEMENT = regex.compile(rf"(?<![\w@.-])(?:{_W}(?:-{_W})*|\p{{Lu}}['’]{_W}(?:-{_W})*|\p{{Lu}}{{2,}}(?:-\p{{Lu}}{{2,}})*|\p{{Lu}}\.(?: ?\p{{Lu}}\.)*)(?![\w-])")
COMMA_NAME = regex.compile(r", \p{Lu}\p{Ll}+(?! \p{Lu})")
HANGUL = re.compile(r"(?<![\w@.-])[가-힣]{2,5}(?![\w-])")
WORD = re.compile(r"[^\W\d_]+")

# Log-odds of the evidence (fixed values).
SHAPE, TITLED, BESIDE, PLACE, ORGANISATION = 1.0, 3.0, 1.0, -1.5, -6.0
COMMON_FAMILY, COMMON_GIVEN, GRAM_LEAST, GRAM_MOST = -3.0, -1.0, -0.8, 2.5
KO_SHAPE, KO_ALONE, KO_KNOWN_FAMILY, KO_ENDING, KO_SHORT = -2.0, 2.5, 1.0, -1.5, -1.5


@dataclass
class NameModel:
    """What the collection says: words that are no part of names, openers of runs, weights of letter n-grams."""

    common: frozenset[str] = frozenset()
    openers: frozenset[str] = frozenset()
    weights: np.ndarray | None = None
    cache: dict[str, float] = field(default_factory=dict)

    def gram_score(self, word: str) -> float:
        if self.weights is None:
            return 0.0
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            at = self.weights[grams_of(word)]
            got = self.cache[word] = float(at.mean()) if len(at) else 0.0
        return got

    def is_common(self, word: str) -> bool:
        return word in self.common or word in OPENERS


def grams_of(word: str) -> np.ndarray:
    """Slots of the letter n-grams of a word; a Hangul word is told by its first syllable and the rest."""
    if "가" <= word[0] <= "힣":
        parts = ["^" + word[0], word[1:] + "$", word[-1] + "$"]
    else:
        w = f"^{word}$"
        parts = [w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1)]
    return np.array([xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass")) >> (32 - GRAM_BITS) for p in parts], dtype=np.int64)


EMPTY = NameModel()


@dataclass
class Candidate:
    start: int
    end: int
    family: list[str]  # in lower case
    given: list[str]
    titled: bool
    hangul: bool = False


def _parts(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def _capital(piece: str) -> bool | None:
    """Whether a word is in capitals; None for initials."""
    return None if piece.endswith(".") else len(piece) > 1 and piece.isupper()


def _runs(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """Capitalised words and initials with one space between them; an opener, a title or another kind of capitals begins a new run."""
    run: list[tuple[int, int, str]] = []
    for m in ELEMENT.finditer(text):
        piece = m[0]
        if run:
            apart = m.start() - run[-1][1] != 1 or text[run[-1][1]] != " " or piece in TITLES or piece.lower() in OPENERS
            if not apart:
                a, b = _capital(run[-1][2]), _capital(piece)
                apart = a is not None and b is not None and a != b
            if apart:
                yield run
                run = []
        run.append((m.start(), m.end(), piece))
    if run:
        yield run


def _initial(piece: str) -> bool:
    return piece.endswith(".")


def candidates(text: str, model: NameModel = EMPTY) -> list[Candidate]:
    """All spans of the form of a name; words that the model knows to be common are cut off at both ends of a run."""
    out: list[Candidate] = []
    pending: tuple[int, int, str, bool] | None = None  # a single word that a comma may join to the next
    for run in _runs(text):
        full = len(run)
        first = run[0]
        titled = "." in text[max(0, first[0] - 2) : first[0]] and bool(TITLE_BEFORE.search(text, max(0, first[0] - TITLE_MAX), first[0]))
        if full == 1 and not titled and not (pending and text[pending[1] : first[0]] == ", "):
            pending = None if _initial(first[2]) or first[2] in TITLES or first[2].lower() in OPENERS else (*first, False)
            continue
        while run and run[0][2] in TITLES:
            run, titled = run[1:], True
        opened = False
        while run and not _initial(run[0][2]) and (run[0][2].lower() in OPENERS or (len(run) > 2 and run[0][2].lower() in model.openers)):
            run, titled, opened = run[1:], False, True
        while len(run) > 1 and (_initial(run[-1][2]) or all(map(model.is_common, _parts(run[-1][2])))) and not (len(run) == 2 and not pending):
            run = run[:-1]
        while len(run) > 2 and not _initial(run[0][2]) and all(map(model.is_common, _parts(run[0][2]))) and len([r for r in run if not _initial(r[2])]) > 2:
            run, opened = run[1:], True
        if len(run) > 1 and not _initial(run[0][2]) and all(model.is_common(w) and model.gram_score(w) < -1 for w in _parts(run[0][2])):
            # "Yesterday M. Tolland", "Yesterday Tolland, Mary"
            if _initial(run[1][2]) or (len(run) == 2 and COMMA_NAME.match(text, run[-1][1])):
                run, opened, first = run[1:], False, run[1]
        if not run or all(_initial(r[2]) for r in run):
            pending = None
            continue
        words = [r for r in run if not _initial(r[2])]
        capitals = {len(r[2]) > 1 and r[2].isupper() for r in words}
        comma = pending and not opened and run[0][0] == first[0] and text[pending[1] : run[0][0]] == ", "
        if comma and len(words) == 1 and capitals == {pending[2].isupper()}:
            out.append(Candidate(pending[0], words[0][1], _parts(pending[2]), _parts(words[0][2]), pending[3]))
            pending = None
            continue
        pending = None
        if len(words) == 1 and len(run) == 1:
            if titled:
                out.append(Candidate(run[0][0], run[0][1], _parts(run[0][2]), [], True))
            pending = (*run[0], titled)
            continue
        if len(words) > 3 or len(capitals) > 1 or _initial(run[-1][2]):
            continue
        if capitals == {True} and full > len(run) + 1 and any(map(model.is_common, [p for r in words for p in _parts(r[2])])):
            continue  # a stretch of text in capitals
        out.append(Candidate(run[0][0], run[-1][1], _parts(words[-1][2]), [p for r in words[:-1] for p in _parts(r[2])], titled))
    if not text.isascii():
        for m in HANGUL.finditer(text):
            titled = bool(KO_TITLE_BEFORE.search(text, max(0, m.start() - KO_TITLE_MAX), m.start()) or KO_TITLE_AFTER.match(text, m.end()) or TITLE_BEFORE.search(text, max(0, m.start() - TITLE_MAX), m.start()))
            out.append(Candidate(m.start(), m.end(), [m[0]], [], titled, True))
    return out


def _alone(text: str, start: int, end: int) -> bool:
    """No Hangul word beside it on the same line."""
    i = start - 1
    while i >= 0 and text[i] in " ,.;:([|)]":
        i -= 1
    j = end
    while j < len(text) and text[j] in " ,.;:([|)]":
        j += 1
    return not (i >= 0 and "가" <= text[i] <= "힣") and not (j < len(text) and "가" <= text[j] <= "힣")


#: What may be an address of mail or a file name: its words say nothing about how names are written.
JOINED = re.compile(r"@|[^\W\d][._+]\w")
#: A Hangul word that occurs this often, and hardly ever with a title, is no name.
KO_OFTEN, KO_TITLED_SHARE = 20, 0.02
NEXT_WORD = re.compile(r" ?([^\W\d_]+)")


def score(text: str, c: Candidate, model: NameModel, beside: bool) -> float:
    total = (TITLED if c.titled else 0.0) + (BESIDE if beside else 0.0)
    parts = c.family + c.given
    grams = sum(map(model.gram_score, parts)) / len(parts)
    total += max(-GRAM_MOST if c.hangul else GRAM_LEAST, min(GRAM_MOST, grams))
    if c.hangul:
        word = c.family[0]
        if word in KO_TITLES or word in KO_LABELS:
            return -9.0
        total += KO_SHAPE + (KO_ALONE if _alone(text, c.start, c.end) else 0.0) + (KO_KNOWN_FAMILY if word[0] in KO_FAMILY and len(word) == 3 else 0.0)
        total += KO_SHORT if len(word) == 2 else 0.0
        total += KO_ENDING if word.endswith(KO_ENDINGS) else 0.0
        return total + (COMMON_FAMILY if word in model.common else 0.0)
    after = NEXT_WORD.match(text, c.end)
    if any(p in NO_PERSON for p in parts) or (after and after[1].lower() in NO_PERSON - REQUESTS):
        total += ORGANISATION
    total += SHAPE
    total += COMMON_FAMILY if any(map(model.is_common, c.family)) else 0.0
    total += COMMON_GIVEN if c.given and all(map(model.is_common, c.given)) else 0.0
    if c.start and text[c.start - 1].isspace() and PLACE_BEFORE.search(text, max(0, c.start - PLACE_MAX), c.start):
        total += PLACE
    return total


def find(text: str, model: NameModel, near: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the names of one text; ``near``: spans of identifiers."""
    begins = {a for a, _ in near}
    stops = {b for _, b in near}

    def beside(c: Candidate) -> bool:
        i = c.end
        while i < len(text) and text[i] in " ,|[(/;-\n" and i - c.end < 4:
            i += 1
        j = c.start
        while j > 0 and text[j - 1] in " ,|])/;-\n" and c.start - j < 4:
            j -= 1
        return i in begins or j in stops

    return [(c.start, c.end) for c in candidates(text, model) if score(text, c, model, beside(c)) > 0]


# --- fitting ---------------------------------------------------------------------------------

COUNTS = "word string, n_all bigint, n_candidate bigint, n_titled bigint, n_opening bigint"


def _count(batches: Iterator[pa.RecordBatch], flush_at: int) -> Iterator[pa.RecordBatch]:
    table: dict[str, list[int]] = {}
    chunks: Counter[str] = Counter()  # what stands between spaces; cut into words once for each distinct one

    def add(word: str, at: int, n: int = 1) -> None:
        got = table.get(word)
        if got is None:
            got = table[word] = [0, 0, 0, 0]
        got[at] += n

    def flush() -> pa.RecordBatch:
        for chunk, n in chunks.items():
            if not JOINED.search(chunk):
                for word in WORD.findall(chunk):
                    add(word, 0, n)
        columns = list(zip(*table.values())) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["word", "n_all", "n_candidate", "n_titled", "n_opening"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            chunks.update(text.lower().split())
            for c in candidates(text):
                parts = c.family + c.given
                if any(p in NO_PERSON for p in parts):
                    continue
                after = NEXT_WORD.match(text, c.end)
                if not c.hangul and after and after[1][0].isupper() and after[1].lower() in NO_PERSON - REQUESTS:
                    continue
                for p in parts:
                    if not c.hangul:
                        add(p, 1)
                    if c.titled:
                        add(p, 2)
            for run in _runs(text):
                if len(run) > 2:
                    add(run[0][2].lower(), 3)
            if len(table) + len(chunks) >= flush_at:
                yield flush()
                table.clear()
                chunks.clear()
    if table or chunks:
        yield flush()


def word_counts(df: DataFrame, text_col: str, flush_at: int = 300_000) -> DataFrame:
    """Of each distinct word: occurrences, those in candidates, after titles, and as first of three capitalised words."""
    partial = spread(df.select(F.col(text_col).cast("string"))).mapInArrow(lambda b: _count(b, flush_at), COUNTS)
    return partial.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n_all", "n_candidate", "n_titled", "n_opening")])


def _gram_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, 1 << GRAM_BITS), dtype=np.int64)
    for batch in batches:
        for word, titled in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if word:
                np.add.at(sums[0 if titled else 1], grams_of(word), 1)
    at = np.nonzero(sums.any(axis=0))[0]
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["slot", "p", "n"])


def fit(df: DataFrame, text_col: str = "text") -> NameModel:
    """The model of a collection: one pass over the texts, one aggregation by word, one of 2^15 slots.

    Null and empty texts say nothing; of an empty collection the model knows nothing.
    """
    counts = written(word_counts(df, text_col), "name_words")
    total = counts.agg(F.sum("n_all")).first()[0] or 0
    least = max(2.0, LEAST_SHARE * total)
    known = counts.filter(F.col("n_all") >= least)
    hangul = F.col("word").rlike("^[가-힣]")
    often = (F.col("n_all") >= KO_OFTEN) & (F.col("n_titled") < KO_TITLED_SHARE * F.col("n_all"))
    elsewhere = F.col("n_candidate") * 2 < F.col("n_all")
    # at most 1 / LEAST_SHARE words reach the share
    common = [r[0] for r in known.filter(F.when(hangul, often).otherwise(elsewhere)).select("word").toLocalIterator()]
    openers = [r[0] for r in known.filter(F.col("n_opening") * 2 > F.col("n_all")).select("word").toLocalIterator()]
    weights = np.zeros(1 << GRAM_BITS, dtype=np.float32)
    # a rare Hangul word may be a name that has no title anywhere, so it is no example of an ordinary word
    titled = F.col("n_titled") > 0
    for script, like_names, ordinary in ((hangul, titled, often), (~hangul, titled | ~elsewhere, elsewhere)):
        # one row for each distinct word: rare words count as much as frequent ones
        sides = counts.filter(script & (like_names | ordinary)).select("word", like_names.alias("like_names"))
        sums = sides.mapInArrow(_gram_sums, "slot int, p bigint, n bigint").groupBy("slot").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).toArrow()
        if not sums.num_rows:
            continue
        slot, p, n = (sums.column(c).to_numpy() for c in ("slot", "p", "n"))
        base = p.sum() / (p.sum() + n.sum())
        if 0 < base < 1:
            weights[slot] += np.log((p + base) / (n + 1 - base)) - np.log(base / (1 - base))
    return NameModel(frozenset(common), frozenset(openers), weights)
