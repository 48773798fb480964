import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import clashing, documents, prose, save
from turnmill.llm import packing as P


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.tokenizer_path())


ODD = ["", " \n", "İstanbul ǅ ß 12² ½ a\x1cb\x85c don't 's!!'s", "ΑΣ σας", "x<|endoftext|>y <|startoftext|>", "A" * 30000, "naïve café é", "日本語 123", "ª º µ ŉ's", "a\0b", "😀 ok", "it's IT'S ''s"]


def test_ids_of_odd_texts(library):
    t = P.tokenizer(P.tokenizer_path())
    for x in ODD:
        assert t.encode(x) == library.encode(x, add_special_tokens=False).ids, repr(x[:30])


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FF, exclude_categories=("Cs",)), max_size=60))
def test_ids_as_the_library(x):
    library = P.tokenizer(P.tokenizer_path()).whole
    assert P.tokenizer(P.tokenizer_path()).encode(x) == library.encode(x, add_special_tokens=False).ids


def test_first_fit_decreasing():
    rng = random.Random(2)
    for _ in range(30):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 60))]
        where, offset = P.first_fit_decreasing(np.array(sizes), 50)
        room: list[int] = []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):  # every bin in turn
            k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            if k == len(room):
                room.append(50)
            assert (where[i], offset[i]) == (k, 50 - room[k])
            room[k] -= sizes[i]


def test_pieces_and_sequences(spark, tmp_path, library):
    rng = random.Random(4)
    texts = [None, "", *ODD, *[prose(rng, rng.randint(1, 900)) for _ in range(150)], prose(rng, 20000), "same", "same"]
    ids = [*range(len(texts) - 1), len(texts) - 2]
    docs = clashing(documents(spark, texts, ids))
    save(docs.drop("start", "length"), tmp_path, "documents")
    got = P.op2_pack(spark, str(tmp_path)).collect()
    want = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        want[i].append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for i, rows in pieces.items():
        whole = want[i][0]
        rows = sorted(rows, key=lambda r: r.start)[:: len(want[i])]  # repeated rows are equal here
        assert [r.start for r in rows] == list(range(0, len(whole), 4096)) and all(r.doc_tokens == len(whole) for r in rows)
        for r in rows:
            part = np.array(whole[r.start : r.start + 4096], "<u4")
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(part.tobytes()))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    full = sum(r.length for r in got)
    assert full / 4096 / len(sequences) > 0.9


def test_small_groups_and_empty(spark):
    rng = random.Random(6)
    docs = documents(spark, [prose(rng, rng.randint(1, 300)) for _ in range(100)])
    got = P.pack_documents(docs, length=64, group=8)
    used = defaultdict(int)
    for r in got.collect():
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 64
    assert P.pack_documents(docs.limit(0)).count() == 0
    row = P.pieces(documents(spark, ["hello there"]), ids=True).first()
    assert row.ids[-1] == 2 and row.length == len(row.ids)
