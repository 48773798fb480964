"""Token ids of many texts at once, for the tokenizer of packing.WordTokenizer.

Texts that its fast way takes are cut into words together, as arrays of characters; each distinct word is encoded once, and its ids are kept for later batches. Other texts go to it one by
one. The ids are the same."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from turnmill.llm.packing import PLAIN, WordTokenizer, char_class

#: Words whose ids are kept, at most.
KEPT = 1 << 20
SPACE, LETTER, DIGIT, OTHER = range(4)
# Fixed value: what the split pattern takes after an apostrophe that stands by itself.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def kinds() -> np.ndarray:
    """The kind of each character that can come out of lower-casing those below PLAIN."""
    most = max(ord(c) for x in range(PLAIN) for c in chr(x).lower()) + 1
    out = np.full(most, OTHER, np.uint8)
    for kind, found in ((LETTER, char_class("L")), (DIGIT, char_class("N"))):
        out[[ord(c) for c in re.findall(r"\\?(.)", found, re.S)]] = kind
    out[[*range(9, 14), 32, 0x85, 0xA0]] = SPACE
    return out


class Batches:
    def __init__(self, tokenizer: WordTokenizer):
        self.tokenizer = tokenizer
        self.kinds = kinds()
        if tokenizer.quick:
            encoding = tokenizer.quick
            self.ends = np.zeros(encoding.n_vocab + 1, bool)  # ids of pieces that end a word
            for i in range(encoding.n_vocab):
                try:
                    self.ends[i] = encoding.decode_single_token_bytes(i).endswith(b"\0")
                except KeyError:
                    pass  # a special token
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.begin, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def words(self, text: str) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The words of a text of plain characters in lower case, and where each begins."""
        c = np.frombuffer(text.encode("utf-16-le"), np.uint16)
        kind = self.kinds[c]
        kept = kind != SPACE
        begins = kept.copy()
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        lone = np.flatnonzero((c == ord("'")) & begins)
        lone = lone[lone + 1 < len(c)]
        for k in lone[kind[lone + 1] == LETTER].tolist():  # an apostrophe that is a run by itself takes an ending with it
            for e in ENDINGS:
                if text.startswith(e, k + 1):
                    begins[k + 1] = False
                    after = k + 1 + len(e)
                    if after < len(c) and kind[after] != SPACE:
                        begins[after] = True
                    break
        size = kept.view(np.uint8) << (c >= 0x80).view(np.uint8)  # bytes in UTF-8: all plain characters are below U+0800
        upto = np.cumsum(size, dtype=np.int64)
        at = np.flatnonzero(begins)
        offsets = np.append(upto[at] - size[at], upto[-1] if len(upto) else 0)
        data = c[kept].tobytes().decode("utf-16-le").encode()
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)), at

    def learn(self, words: list[str]) -> None:
        """Encode new words and keep their ids."""
        ids = np.array(self.tokenizer.quick.encode_ordinary("\0".join(words) + "\0"), np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        assert len(ends) == len(words)
        self.begin = np.append(self.begin, len(self.pool) + np.append(0, ends[:-1]))
        self.size = np.append(self.size, np.diff(ends, prepend=0))
        self.pool = np.append(self.pool, ids)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text by text, and how many each text has."""
        t = self.tokenizer
        whole = "\n".join(texts)
        c = np.frombuffer(whole.encode("utf-16-le", "surrogatepass"), np.uint16)
        if t.quick and (not len(c) or c.min() > 0 and c.max() < PLAIN) and not any(s in whole for s in t.special):
            plain = [True] * len(texts)
        else:
            plain = [bool(t.quick) and not t.unusual.search(x) and not any(s in x for s in t.special) for x in texts]
        lows = [x.lower() for x, p in zip(texts, plain, strict=True) if p]
        found, at = self.words("\n".join([*lows, ""]))
        coded = found.dictionary_encode()
        listed = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(listed) > KEPT:
            self.clear()
        if new := [w for w in listed if w not in self.known]:
            self.learn(new)
        word = np.fromiter(map(self.known.__getitem__, listed), np.int64, len(listed))[coded.indices.to_numpy()]
        size = self.size[word]
        upto = np.cumsum(size)
        ids = self.pool[np.repeat(self.begin[word] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
        last = np.searchsorted(at, np.cumsum([len(x) + 1 for x in lows]))  # words up to the end of each text
        sizes = np.diff(np.append(0, upto)[last], prepend=0)
        if all(plain):
            return ids, sizes
        rest = iter(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else [])
        parts = [next(rest) if p else np.array(t.encode(x), np.uint32) for x, p in zip(texts, plain, strict=True)]
        return np.concatenate([*parts, np.zeros(0, np.uint32)]).astype(np.uint32), np.array([len(p) for p in parts], np.int64)
