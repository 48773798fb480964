import glob
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import clashing, documents, prose, save
from tests.llm.test_packing import ODD
from turnmill.llm import id_files as I, mixing_coder as M
from turnmill.llm.packing import tokenizer, tokenizer_path
from turnmill.llm.word_batches import Batches

APOSTROPHES = ["'", "a'", "'re've'llx'dy 'r 'l'm", "İ's ' s ' s", "12'345's", "''s", "!'t", "x's\ny't"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def batches():
    return Batches(tokenizer(tokenizer_path()))


def same(blocks):
    payloads = M.encode(blocks)
    back = M.decode(payloads, [len(b) for b in blocks])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))
    return payloads


def test_coder_round_trips():
    rng = np.random.default_rng(3)
    b = M.BLOCK
    blocks = [rng.integers(0, 1 << k, n, np.uint32) for k in (1, 4, 9, 16, 32) for n in (1, 2, 15, 16, 17, 49, 1009, b)]
    blocks += [np.zeros(b, np.uint32), np.arange(b, dtype=np.uint32), np.full(5, 0xFFFFFFFF, np.uint32), np.tile(np.arange(100, dtype=np.uint32), 20), np.repeat(np.arange(64, dtype=np.uint32), 32)]
    same(blocks)
    same([x.astype(np.uint16) for x in blocks if x.max() < 1 << 16])
    assert M.encode([]) == [] and M.decode([], []) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=400), min_size=1, max_size=5))
def test_coder_round_trips_small(rows):
    same([np.array(r, np.uint16) for r in rows])


def test_blocks_are_independent_and_small():
    rng = np.random.default_rng(4)
    blocks = [np.repeat(rng.choice(50, M.BLOCK // 4, p=np.arange(50) / 1225), 4).astype(np.uint16) for _ in range(6)]
    payloads = same(blocks)
    assert [M.encode([b])[0] for b in blocks] == payloads
    entropy = -sum(p * np.log2(p) for p in np.arange(1, 50) / 1225) / 4  # of what isn't repeated
    assert sum(map(len, payloads)) * 8 < 2 * entropy * 6 * M.BLOCK
    order2 = np.tile(rng.integers(0, 60000, 300), 7)[: M.BLOCK].astype(np.uint16)  # predicted once it has been seen
    assert len(M.encode([order2])[0]) < 2 * 300 + 900


def test_batches_as_the_library(library, batches):
    texts = [*ODD, *APOSTROPHES, "", *ODD]
    ids, sizes = batches.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert batches.encode([])[1].tolist() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("'srevml d1!\n"), st.characters(max_codepoint=0x2FF, exclude_categories=("Cs",))), max_size=30), max_size=4))
def test_any_batches_as_the_library(library, batches, texts):
    ids, sizes = batches.encode(texts)
    assert ids.tolist() == [i for x in texts for i in library.encode(x, add_special_tokens=False).ids]
    assert len(sizes) == len(texts)


def expected(rows, library):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def by_start(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_query(spark, tmp_path, library):
    rng = random.Random(8)
    texts = [None, "", *ODD, *APOSTROPHES, *[prose(rng, rng.randint(1, 900)) for _ in range(80)], prose(rng, 20000), "same", "same"]
    ids = [*range(len(texts) - 1), len(texts) - 2]
    rng.shuffle(ids)
    ids[5] = None
    rows = list(zip(ids, texts, strict=True))
    save(clashing(documents(spark, texts, ids)).withColumns({"segment": F.lit("x"), "n_tokens": F.lit("x"), "content": F.lit("x")}).repartition(3), tmp_path, "documents")
    got = by_start(I.op11_id_files(spark, str(tmp_path)))
    want = expected(rows, library)
    # equal document ids may lie in any order of their rows
    assert sorted(map(str, got)) == sorted(map(str, want)) or [g[0] for g in got] == [w[0] for w in want]
    assert [r[1] for r in got] == np.append(0, np.cumsum([r[2] for r in got])[:-1]).tolist()
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted(((r[0], r[2], r[3]) for r in want), key=str)


def test_small_segments_ids_and_one_hot_id(spark, tmp_path, library):
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(60)]
    ids = [7] * 40 + list(range(20))
    I.write_ids(documents(spark, texts, ids).repartition(3), f"{tmp_path}/ids", size=300)
    assert len(glob.glob(f"{tmp_path}/ids/part-*")) >= 4  # the rows of one id are in several partitions
    got = I.read_ids(spark, f"{tmp_path}/ids", ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(ids)
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((i, [*library.encode(t, add_special_tokens=False).ids, 2]) for i, t in zip(ids, texts, strict=True))
    assert sum(r.n_tokens for r in got[:-1]) == got[-1].start


def test_empty_table(spark, tmp_path):
    I.write_ids(documents(spark, ["x"]).limit(0), f"{tmp_path}/ids")
    assert I.read_ids(spark, f"{tmp_path}/ids").collect() == []


def test_damage_is_found(library):
    import pyarrow as pa

    ids = np.array(library.encode(prose(random.Random(1), 900), add_special_tokens=False).ids, np.uint32)
    whole = I.segment(3, 1, pa.array([5, None], pa.int64()), np.array([10, len(ids) - 10]), ids) + b"\n"
    part, number, nulls, docs, sizes, back = next(I.segments(whole))
    assert (part, number, nulls.tolist(), docs.tolist(), sizes.tolist()) == (3, 1, [0, 1], [5, 0], [10, len(ids) - 10]) and np.array_equal(back, ids)
    for at in (0, 30, 40, 100, len(whole) // 2, len(whole) - 2, len(whole) - 1):
        with pytest.raises(ValueError):
            list(I.segments(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :]))
    with pytest.raises(ValueError):
        list(I.segments(whole[:-9]))
