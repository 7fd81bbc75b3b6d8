"""Whole texts to token ids with the tokenizers library, each distinct word of a batch encoded once."""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa

from kinmatch.llm.common import ragged

#: Byte-level alphabet: these byte ranges stand for themselves, the rest follow from code point 256 on.
PRINTABLE = ((33, 126), (161, 172), (174, 255))

#: Kinds of bytes. An apostrophe is OTHER, as it may begin a contraction.
OTHER, BLANK, LETTER, POINT, HIGH = range(5)
KIND = np.array([HIGH if b > 127 else BLANK if b == 32 or 9 <= b <= 13 else LETTER if chr(b).isalpha() else POINT if 32 < b < 127 and not chr(b).isalnum() and b != 39 else OTHER for b in range(256)], np.uint8)

_encoders: dict[tuple[str, int], "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def encoder(path: str, cache_words: int = 400_000) -> "Encoder":
    """One encoder for each worker process."""
    key = (path, cache_words)
    if key not in _encoders:
        _encoders[key] = Encoder(path, cache_words)
    return _encoders[key]


class Encoder:
    """Ids exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    A byte-level pre-tokenizer always starts a piece at a single space between two other characters, between an ASCII letter and
    ASCII punctuation, and around a single line feed, so text is cut there, and the ids of a piece don't depend on its neighbours.
    A text that holds the string of an added token, which the library takes out before it cuts, goes to the library whole, as does
    every text where the tokenizer is of another kind.
    """

    def __init__(self, path: str, cache_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.width = max(1, (self.whole.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or []]
        self.most, self.cache = cache_words, {}
        if self.by_word:
            self.bare = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "decoder": None, "added_tokens": []}))
            kept = {b for low, high in PRINTABLE for b in range(low, high + 1)}
            rest = iter(range(256, 512))
            self.alphabet = {b: b if b in kept else next(rest) for b in range(256)}

    def _encode_new(self, words: list[str]) -> list[bytes]:
        """One letter run, with or without a space before it, is one piece for the pre-tokenizer: the bare model takes it."""
        out: list[bytes] = [b""] * len(words)
        runs = [i for i, w in enumerate(words) if (w[1:] if w[:1] == " " else w).isalpha()]
        taken = set(runs)
        rest = [i for i in range(len(words)) if i not in taken]
        mapped = [words[i].encode().decode("latin-1").translate(self.alphabet) for i in runs]
        for part, model, texts in ((runs, self.bare, mapped), (rest, self.whole, [words[i] for i in rest])):
            for i, e in zip(part, model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                out[i] = array("I", e.ids).tobytes()
        return out

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and n + 1 offsets of n texts to all ids (uint32) and the number of ids of each text."""
        n = len(at) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        if not self.by_word:
            return self._library(data, at)
        raw = data.tobytes()
        if not any(t in raw for t in self.added):
            return self._words(data, at)
        # runs of texts with and without such a string, in order
        marked = np.array([any(t in raw[a:b] for t in self.added) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], bool)
        edges = [0, *(np.flatnonzero(marked[1:] != marked[:-1]) + 1).tolist(), n]
        parts = [(self._library if marked[a] else self._words)(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _library(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole texts by the library, one after another."""
        got = [np.array(self.whole.encode(data[a:b].tobytes().decode(), add_special_tokens=False).ids, np.uint32) for a, b in zip(at[:-1], at[1:], strict=True)]
        return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(ids) for ids in got], np.int64)

    def _words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts without an added token, piece by piece."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        kind = KIND[data]
        starts = data == 32
        before, own, after = kind[:-2], kind[1:-1], kind[2:]
        starts[1:-1] &= (before != BLANK) & (after != BLANK) & ((before < HIGH) | (after < HIGH))  # two beyond ASCII may both be white space
        starts[:1] = starts[-1:] = False
        # a letter next to punctuation (an apostrophe may belong to a contraction), and a single line feed
        starts[1:] |= ((kind[:-1] == LETTER) & (kind[1:] == POINT)) | ((kind[:-1] == POINT) & (kind[1:] == LETTER))
        line = np.flatnonzero((data[1:-1] == 10) & (before != BLANK) & (before < HIGH) & (after != BLANK) & (after < HIGH)) + 1
        starts[line] = True
        starts[line + 1] = True
        starts[at[:-1][at[:-1] < at[1:]]] = True
        first = np.flatnonzero(starts)
        bounds = np.append(first, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        words, index = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        got = [self.cache.get(w) for w in words]
        missing = [i for i, x in enumerate(got) if x is None]
        new = [words[i] for i in missing]
        for i, w, ids in zip(missing, new, self._encode_new(new), strict=True):
            got[i] = ids
            if len(self.cache) < self.most:
                self.cache[w] = ids
        flat = np.frombuffer(b"".join(got), np.uint32)
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        begins = np.cumsum(sizes) - sizes
        lengths = sizes[index]
        ids = flat[ragged(begins[index], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        piece_of = np.searchsorted(first, at)  # the first piece at or after each text's start
        return ids, np.diff(ends[piece_of])
