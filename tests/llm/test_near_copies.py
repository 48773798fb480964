"""Near copies against all pairs of shingle sets."""

import random

import pytest

import corpus_pipeline as C
from tests.llm.helpers import clashing, documents, prose
from turnmill.llm import near_copies as N


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_firsts(texts):
    """The least id of each component, by trying all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {root(i) for i in sets}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"changed{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("bucket", "block", "bar"), [(1, 7, N.SKETCH_BAR), (3, 4096, N.SKETCH_BAR), (48, 20, N.SKETCH_BAR), (2, 4096, 0)])
def test_stage_against_all_pairs(spark, bucket, block, bar):
    """Edits on both sides of 0.8, a chain, a large group, short and empty texts; buckets small and large."""
    rng = random.Random(bucket)
    texts = [None, "", " \t", "one two", "One  TWO", "one two three four", "a b c d e", "a b c d e f"]
    for _ in range(12):
        base = prose(rng, rng.randint(30, 400))
        texts += [base, base.upper(), *(edited(rng, base, rng.randint(1, 1 + len(base.split()) // 40)) for _ in range(5)), base + " end"]
    chain = prose(rng, 200)
    for _ in range(15):
        texts.append(chain := edited(rng, chain, 2))
    group = prose(rng, 300)
    texts += [edited(rng, group, 2) for _ in range(60)]
    for _ in range(30):  # pairs off the centre
        far = edited(rng, group, 9)
        texts += [far, edited(rng, far, 1)]
    rng.shuffle(texts)
    ids = rng.sample(range(1000), len(texts))
    docs = clashing(documents(spark, texts, ids))
    got = N.keep_first(docs, bucket=bucket, block=block, sketch_bar=bar)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(slow_firsts(dict(zip(ids, texts, strict=True))))


def test_pipeline_stage_drops_near_copies(spark):
    """Two changed words of 300: similar by 0.93, and mostly more than two bits of a SimHash apart."""
    rng = random.Random(3)
    base = [prose(rng, 300) for _ in range(10)]
    docs = documents(spark, [*base, *(edited(rng, t, 2) for t in base), *(edited(rng, t, 40) for t in base)])
    assert sorted(r.doc_id for r in C.near_dedup(spark, docs, "").collect()) == [*range(10), *range(20, 30)]


def test_rows(spark):
    a, b = prose(random.Random(4), 50), prose(random.Random(5), 50)
    assert N.keep_first(documents(spark, [a, a, b], [1, 1, 2])).count() == 2
    assert sorted(r.doc_id for r in N.keep_first(documents(spark, [a, a + " x", b, None, None], [7, None, 3, 9, 8]), broadcast_rows=-1).collect()) == [3, 7, 8]
    assert N.keep_first(documents(spark, [])).count() == 0


def test_candidates_by_simhash(spark, monkeypatch):
    """Pairs within two bits are found by the blocks of SimHash alone, without a band in common; what isn't similar is dropped by the exact check."""
    import numpy as np

    from turnmill.llm import simhash as S

    rng = random.Random(8)
    base = [prose(rng, 400) for _ in range(40)]
    texts = [*base, *(t + " end" for t in base)]
    near = {(k, k + 40) for k in range(40) if bin(S.fingerprint_of(texts[k].encode(), 5) ^ S.fingerprint_of(texts[k + 40].encode(), 5)).count("1") <= 2}
    assert len(near) > 20
    monkeypatch.setattr(N, "bands_of", lambda h: np.array([h.sum()], np.uint64))  # no two of these texts share a band
    left = {r.doc_id for r in N.keep_first(documents(spark, texts)).collect()}
    assert left == set(range(80)) - {b for _, b in near}
