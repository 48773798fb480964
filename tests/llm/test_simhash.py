import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tests.llm.helpers import clashing, documents, prose, save
from turnmill.llm import simhash as S


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hs = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps):
    """Smallest id reachable, by trying all pairs."""
    up = {i: i for i in fps}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_fingerprints():
    rng = random.Random(1)
    for t in ["", " \t", "One", "one TWO", "a b c", "a  b\n\tc d", "a b c d", "é É x y z", prose(rng, 9000), "x y z " * 3000, "\x1cA b c"]:
        assert S.fingerprint_of(t.encode()) == slow_fingerprint(t), t[:20]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    base = [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    texts = [None, "", *base, *base[:10]]
    for t in base[:25]:
        w = t.split()
        for _ in range(4):
            w = [*w]
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    ids = rng.sample(range(1000), len(texts))
    save(clashing(documents(spark, texts, ids)), tmp_path, "documents")
    got = {r.doc_id: r for r in S.op9_simhash(spark, str(tmp_path)).collect()}
    fps = {i: slow_fingerprint(t) for i, t in zip(ids, texts, strict=True)}
    want = slow_components(fps)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


@pytest.mark.parametrize("bucket", [1, 3, 48])
def test_components_of_made_fingerprints(spark, bucket):
    """Chains, stars and clusters, with buckets small and large: both ways lose no link."""
    rng = random.Random(bucket)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:12]:
        for _ in range(25):
            for _ in range(rng.randint(1, 2)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps |= {0, 1, (1 << 64) - 1, 1 << 63}
    fps |= {0xABCD << 40 | x for x in range(0, 1 << 12, 3)}  # agree in 52 bits: a bucket that splits to the last level
    signed = {f: int(np.uint64(f).view(np.int64)) for f in fps}
    df = spark.createDataFrame([(x,) for x in signed.values()], "fp bigint")
    found = {r.node: r.root for r in S.components(S.links(df, bucket=bucket)).collect()}
    want = slow_components({signed[f]: f for f in fps})
    groups = {}
    for x, r in want.items():
        groups.setdefault(r, set()).add(x)
    for members in groups.values():
        roots = {found.get(x, x) for x in members}
        assert len(roots) == 1 and roots == {min(members)}


def test_keep_first(spark):
    rng = random.Random(8)
    a, b = prose(rng, 300), prose(rng, 200)
    texts = [b, a, a, a + " end", b, None, "", b, a]
    ids = [9, 4, 7, 5, 9, 20, 21, 3, None]
    docs = clashing(documents(spark, texts, ids))
    got = S.keep_first(docs)
    assert got.columns == docs.columns
    near = slow_components({i: slow_fingerprint(t) for i, t in [(3, b), (4, a), (5, a + " end"), (20, "")]})
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(near.values()))
    assert S.keep_first(docs.limit(0)).count() == 0
    # repeated rows: one stays
    assert S.keep_first(documents(spark, [a, a, b], [1, 1, 2])).count() == 2
    # without broadcasts
    assert S.keep_first(docs, broadcast_rows=-1).count() == len(set(near.values()))


def test_empty(spark, tmp_path):
    save(documents(spark, []), tmp_path, "documents")
    assert S.op9_simhash(spark, str(tmp_path)).count() == 0
