"""Fixtures with the awkward cases that every operator has to take."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from pathlib import Path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ["_text", "_id", "_row", "_doc", "digest", "score", "items", "spans", "_fp", "_h", "_d", "_f", "fp", "root", "start", "length", "_n", "_s", "y", "at"]


def prose(rng: random.Random, n: int, words: list[str] | None = None) -> str:
    words = words or [a + b for a in ("ka", "lo", "mi", "re", "su", "ta", "vo", "ne") for b in ("rin", "dal", "mos", "pek", "tuv", "hal")]
    return " ".join(rng.choice(words) for _ in range(n))


def documents(spark, texts: list[str | None], ids: list[int | None] | None = None, langs: list[str | None] | None = None):
    ids = ids or list(range(len(texts)))
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, g, "s", None if t is None else len(t)) for i, t, g in zip(ids, texts, langs, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """df with further columns whose names operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASH})


def save(df, folder: Path, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def contaminated(docs: list[tuple[int, str | None]], tests: list[tuple[int, str | None]], window: int = 10) -> list[tuple]:
    """The rows of op1's contract, by comparing every window with every position."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for i, t in tests:
        w = split(t)
        for j in range(len(w) - window + 1) if len(w) >= window else range(bool(w)):
            windows[tuple(w[j : j + window])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, items = split(t), set(), set()
        for x, ids in windows.items():
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit |= set(range(j, j + len(x)))
                    items |= ids
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(items)))
    return out
