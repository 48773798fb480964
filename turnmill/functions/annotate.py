"""Sentences and tagged words: where a language model of the caller's is applied, and rules in its place."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from turnmill.functions.entities import NUMBER, TAGGED
from turnmill.functions.tweets import rule_tokens

_end = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+(?=[\"'“‘(\[]*[A-Z0-9À-Þ])")
_short = re.compile(r"\b(?:[Mm]r|[Mm]rs|[Mm]s|[Dd]r|[Ss]r|[Jj]r|[Ss]t|e\.g|i\.e|[A-Z])\.$")


def sentences(text: str) -> list[str]:
    """Sentences by end marks, blanks and capitals; known abbreviations don't end one."""
    out: list[str] = []
    at = 0
    for m in _end.finditer(text):
        if not _short.search(text[: m.start()].rstrip("\"'”’)]")):
            out.append(text[at : m.end()].strip())
            at = m.end()
    out.append(text[at:].strip())
    return [x for x in out if x]


def tagged(text: str) -> list[tuple[int, str, str, str, str]]:
    """(index, term, lemma, pos, ner) by rule: placeholders and numbers are known; lemmas are lower-case terms; there is no part of speech."""
    known = {"@url$": "URL", "<url>": "URL", "reddituser": "PERSON", "<person>": "PERSON"}
    return [(i, t, t.lower(), "", known.get(t.lower(), "NUMBER" if re.match(NUMBER, t) else "")) for i, t in enumerate(rule_tokens(text))]


def sentences_udf(fn: Callable[[str], list[str]] = sentences):
    """Column function: text to array<string>; fn may be a model's."""

    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else fn(t))

    return run


def tagged_udf(fn: Callable[[str], list[tuple]] = tagged):
    """Column function: text to tagged words; fn may be a model's."""
    names = ["index", "term", "lemma", "pos", "ner"]

    @F.pandas_udf(TAGGED)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else [dict(zip(names, w, strict=True)) for w in fn(t)])

    return run
