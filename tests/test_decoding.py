"""Beam decoding against a search sample by sample."""

import math
import random

import pytest

from turnmill.operators import decoding as D


def slow_next(texts):
    counts = {}
    for t in texts:
        w = (t or "").split()
        for a, b in zip(w, [*w[1:], D.END], strict=False):
            counts.setdefault(a, {})
            counts[a][b] = counts[a].get(b, 0) + 1
    return {a: {b: math.log(n / sum(x.values())) for b, n in x.items()} for a, x in counts.items()}


def slow_beams(start, following, width, length, penalty):
    score = lambda b: b[1] / (((5 + len(b[0])) / 6) ** penalty)
    beams = [((), 0.0, False)]
    for _ in range(length):
        grown = []
        for words, lp, over in beams:
            after = following.get(words[-1] if words else start, {})
            if over or not after:
                grown.append((words, lp, True))
            else:
                grown += [((*words, b), lp + p, b == D.END) for b, p in after.items()]
        beams = sorted(grown, key=lambda b: (-round(score(b), 9), b[0]))[:width]
        if all(b[2] for b in beams):
            break
    return [(list(w), lp) for w, lp, _ in beams]


@pytest.mark.parametrize(("width", "length", "penalty", "broadcast_rows"), [(1, 6, 0.0, 10**6), (3, 5, 0.0, 0), (4, 7, 1.0, 10**6)])
def test_beams(spark, width, length, penalty, broadcast_rows):
    rng = random.Random(width)
    texts = [" ".join(rng.choice("abcde") + rng.choice("xyz") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["", None]
    following = slow_next(texts)
    found = D.next_words(spark.createDataFrame([(t,) for t in texts], "text string"))
    table = {(r.word, r.next): r.log_prob for r in found.collect()}
    assert table.keys() == {(a, b) for a, x in following.items() for b in x}
    assert all(abs(v - following[a][b]) < 1e-12 for (a, b), v in table.items())
    starts = {k: w for k, w in enumerate([*sorted(following)[:12], "unknown", "ax", "ax"])}
    got = D.beam_search(spark.createDataFrame(list(starts.items()), "k bigint, w string"), found, key="k", start="w", width=width, max_length=length, penalty=penalty, broadcast_rows=broadcast_rows)
    rows = {}
    for r in got.orderBy("k", "rank").collect():
        rows.setdefault(r.k, []).append((r.words, r.log_prob))
    assert rows.keys() == starts.keys()
    for k, w in starts.items():
        want = slow_beams(w, following, width, length, penalty)
        assert [x for _, x in rows[k]] == pytest.approx([x for _, x in want], abs=1e-9), w
        same = sorted(x for x, _ in want) == sorted(x for x, _ in rows[k])
        assert same or len({round(x, 9) for _, x in want}) < len(want)  # sequences of one probability may change places


def test_beams_turned_where_they_are(spark, tmp_path):
    """Halves of floats round as the SQL's, rows that share an id stay apart, a missing id leaves the text null."""
    import duckdb

    from turnmill.plans.catalogue import QUERIES, SQL

    rows = [(1, [0.1515, 0.2, 0.3, 0.4]), (1, [0.5, 0.6, 0.7, 0.8]), (2, None), (3, [0.1, None, 0.3, 0.4]), (4, [k / 1000 + 0.0005 for k in (7, 33, 101, 250)])]
    rows += [(5 + k, [k / 1000 + 0.0005, k / 997, -k / 1000 - 0.0005, k / 1009]) for k in range(500)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(map(repr, c.sql(f"SELECT vec_id, beam, ids FROM ({SQL['beam_order']})").fetchall()))
    assert sorted(repr((r.vec_id, r.beam, r.ids)) for r in QUERIES["beam_order"](spark, str(tmp_path)).collect()) == want
    import turnmill.operators.evaluate as V

    ragged = spark.createDataFrame([(7, [[1, 2], [3], [4, 5]]), (8, []), (9, None)], "k int, steps array<array<int>>")
    assert sorted((r.k, r.beam, r.ids) for r in V.beam_major(ragged, "k").collect()) == [(7, 0, [1, 3, 4]), (7, 1, [2, 5])]
