"""The suffix stripping algorithm of M. F. Porter (Program 14(3), 1980)."""

from __future__ import annotations

_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = "ement ance ence able ible ment ant ent ion ism ate iti ous ive ize al er ic ou".split()


def _m(stem_: str) -> int:
    """How many vowel-consonant sequences the stem has."""
    kinds = []
    for i, ch in enumerate(stem_):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and kinds[-1] == "c")
        kind = "v" if vowel else "c"
        if not kinds or kinds[-1] != kind:
            kinds.append(kind)
    return "".join(kinds).count("vc")


def _vowel(stem_: str) -> bool:
    before = ""
    for i, ch in enumerate(stem_):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and before == "c")
        if vowel:
            return True
        before = "c"
    return False


def _ends_cvc(stem_: str) -> bool:
    if len(stem_) < 3:
        return False
    a, b, c = stem_[-3:]
    consonant = [x not in "aeiou" and not (x == "y" and i and stem_[i - 1] not in "aeiou") for i, x in ((len(stem_) - 3, a), (len(stem_) - 2, b), (len(stem_) - 1, c))]
    return consonant[0] and not consonant[1] and consonant[2] and c not in "wxy"


def _replace(word: str, rules) -> str:
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + new if _m(base) > 0 else word
    return word


def stem(word: str) -> str:
    """The stem of a word in lower case; words of two letters or fewer stay."""
    w = word
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                    w = w[:-1]
                elif _m(w) == 1 and _ends_cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _STEP2), _STEP3)
    for suffix in _STEP4:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _m(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _m(base) > 1 or (_m(base) == 1 and not _ends_cvc(base)):
            w = base
    if w.endswith("ll") and _m(w) > 1:
        w = w[:-1]
    return w
