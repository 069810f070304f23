"""The word splitting of :mod:`lexmill.functions.text` for Python workers.

N-grams are made in workers: Spark's functions on arrays are interpreted element by element, which
took several times as long.
"""

from __future__ import annotations

import re

NO_WORD = re.compile(r"[^\w\s'-]")
SPACES = re.compile(r"\s+")
STEPS = ((re.compile("--+"), " "), (re.compile(" cannot "), " can not "), (re.compile("n't "), " "), (re.compile(r"'(?:s|m|d|ll|re|ve)? "), " "))


def clean_text(body: str) -> str:
    return SPACES.sub(" ", NO_WORD.sub(" ", body)).lower().strip(" ")


def split_clean(clean: str) -> list[str]:
    t = f" {clean} "
    if "'" in t or "--" in t or "cannot" in t:
        for pattern, new in STEPS:
            t = pattern.sub(new, t)
    return [w for w in t.split() if len(w) > 1 and w.isalpha()]
