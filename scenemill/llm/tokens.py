"""Token ids from public tokenizer files, by the tokenizers library with its results kept per word.

Both splitting patterns only ever cut a text into words before merging, so a text can be cut at white
space first, each distinct piece put through the library's merges once, and the ids looked up from then
on. Pieces of ASCII and Latin-1 letters go straight to the library's model, whose normalising and
splitting are plain for them; any other piece, and any text with unusual white space, is encoded by the
library as a whole. For a tokenizer that keeps white space the cuts are made between kinds of bytes, for
many texts at once, and each distinct piece of these is looked up once.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as little-endian uint32")

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

#: Distinct words and parts of words kept by a worker (about 200 bytes each). Full memories keep what they have, and start
#: afresh once a share of RENEW of a group's pieces is unknown to them.
KEPT_WORDS, KEPT_PARTS = 450_000, 250_000
RENEW = 0.3

#: Characters of text in work at a time, and if pieces are looked up once for all of them.
_GROUP_CHARS, _SPACED_CHARS = 1 << 20, 1 << 22

#: White space that the libraries may not agree on, or that the cuts below do not handle.
_UNUSUAL = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    　﻿]")
_ENDINGS = frozenset(".,;:!?")
_PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9]+|[^A-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_PIECE = re.compile(" ?(?:[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9]+|[!-&(-/:-@[-`{-~]+)")
_SPLIT_DIGIT = re.compile(_SPLIT.pattern.replace("[0-9]+", "[0-9]"))


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer: ``name`` itself if it is a path."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: The byte-level alphabet: bytes that print stand for themselves, the others for the characters from 256 on.
_PRINTING = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTING]
_BYTE_CHARS = {b: chr(b) for b in _PRINTING} | {b: chr(256 + i) for i, b in enumerate(_OTHERS)}
_SPACE = _BYTE_CHARS[32]

#: Kinds of bytes; cuts are made between them. Words with an odd byte, or an apostrophe, which may begin a contraction, stay whole.
_WHITE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_KINDS = np.full(256, _ODD, np.uint8)
_KINDS[0x21:0x7F] = _SIGN
_KINDS[list(b" \t\n\r")] = _WHITE
_KINDS[list(b"0123456789")] = _DIGIT
_KINDS[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
_KINDS[ord("'")] = _ODD
_KINDS[0xC3] = _LETTER  # begins the Latin-1 letters, and two signs


def _cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of non-empty texts begin; their UTF-8 stands in ``raw`` one after the other, from ``starts`` on."""
    kind = _KINDS[raw]
    high = np.flatnonzero(raw >= 0x80)
    second = high[(raw[high] < 0xC0) & (raw[high - 1] == 0xC3)]
    kind[second[(raw[second] != 0x97) & (raw[second] != 0xB7)]] = _LETTER
    white = kind == _WHITE
    first = np.zeros(len(raw) + 1, bool)
    first[starts] = first[-1] = True
    # A run of white space is cut from the word before it; its last character from the rest, if a word follows in the
    # same text, and from that word unless it is a space.
    word = first[:-1] | (white & np.append(~white[1:], False) & ~first[1:])
    word[1:] |= (white[1:] & ~white[:-1]) | (~white[1:] & white[:-1] & (raw[:-1] != 0x20))
    cut = word.copy()
    cut[1:] |= (kind[1:] != kind[:-1]) & ~white[1:] & ~white[:-1]
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        begins = np.append(np.flatnonzero(word), len(raw))
        k = np.unique(np.searchsorted(begins, odd, "right") - 1)
        step = np.zeros(len(raw) + 1, np.int8)
        step[begins[k]] += 1
        step[begins[k + 1]] -= 1
        cut &= word | (np.cumsum(step[:-1], dtype=np.int8) == 0)
    return np.flatnonzero(cut)


class _Memory(dict):
    """What is known by key; the rest is worked out, and kept while there is room."""

    def __init__(self, work_out, most: int):
        super().__init__()
        self.work_out, self.most, self.missed = work_out, most, 0

    def __missing__(self, key: str) -> bytes:
        found = self.work_out(key)
        self.missed += 1
        if len(self) < self.most:
            self[key] = found
        return found


class WordEncoder:
    """Encodes texts with a tokenizer file; ids come as little-endian uint32 bytes."""

    def __init__(self, path: str, kept_words: int = KEPT_WORDS, kept_parts: int = KEPT_PARTS):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        # Added tokens are cut out of a text before all else: a text that may hold one goes through the library whole.
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.added = [t.content for t in added]
        self.folded = any(t.normalized for t in added)
        # A tokenizer without a normalizer keeps white space: a word's leading space belongs to it.
        self.spaced = self.tokenizer.normalizer is None
        self.model = self.tokenizer.model
        self.whole = _Memory(self._piece if self.spaced else self._word, kept_words)  # pieces as cut from texts
        self.parts = _Memory(self._part, kept_parts)  # pieces of these as cut by the pattern

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _may_hold_added(self, text: str) -> bool:
        if self.folded:
            return any(a.lower() in text.lower() for a in self.added)
        return any(a in text for a in self.added)

    def _part(self, piece: str) -> bytes:
        """The ids of one piece under the pattern, of ASCII and Latin-1 letters after at most a space."""
        if not piece.isascii():
            piece = "".join([_BYTE_CHARS[b] for b in piece.encode()])
        elif piece[0] == " ":
            piece = _SPACE + piece[1:]
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        body = word[1:] if self.spaced and word[:1] == " " else word
        if body.isascii() and body[:-1].isalpha() and body[-1] in _ENDINGS:  # the common case, split by hand
            if not self.spaced:
                word = word.lower()
            return self.parts[word[:-1]] + self.parts[word[-1]]
        if not _PLAIN.fullmatch(body):
            return self._library(word)
        if not self.spaced:
            pieces = _SPLIT_DIGIT.findall(body.lower())
        else:
            pieces = _SPLIT.findall(body)
            if body is not word:
                if pieces[0][0] == "'" and pieces[0][1:].isalpha():
                    return self._library(word)  # after a space the apostrophe stands alone
                pieces[0] = " " + pieces[0]
        return b"".join(map(self.parts.__getitem__, pieces))

    def _piece(self, piece: str) -> bytes:
        return self._part(piece) if _PIECE.fullmatch(piece) else self._word(piece)

    def _group(self, texts: list[str]) -> list[bytes]:
        out, n = [], 0
        self.whole.missed = 0
        get = self.whole.__getitem__
        for text in texts:
            if _UNUSUAL.search(text) or self._may_hold_added(text):
                out.append(self._library(text))
                continue
            words = text.split()
            n += len(words)
            out.append(b"".join(map(get, words)))
        for memory in (self.whole, self.parts):
            if len(memory) >= memory.most and self.whole.missed > RENEW * n:
                memory.clear()
        return out

    def _spaced_group(self, texts: list[str]) -> list[bytes]:
        """As ``_group``, for a tokenizer that keeps white space."""
        plain = [bool(t) and not _UNUSUAL.search(t) and not self._may_hold_added(t) for t in texts]
        encoded = [t.encode() for t, p in zip(texts, plain) if p]
        if not encoded:
            return [self._library(t) for t in texts]
        data, bounds = b"".join(encoded), np.cumsum([0, *map(len, encoded)])
        begins = np.append(_cuts(np.frombuffer(data, np.uint8), bounds[:-1]), len(data))
        pieces = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(data)).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        for memory in (self.whole, self.parts):
            if len(memory) >= memory.most:
                unknown = np.array([p not in self.whole for p in distinct])
                if unknown[pieces.indices.to_numpy()].mean() > RENEW:
                    memory.clear()
        ids = pa.array([self.whole[p] for p in distinct], pa.large_binary()).take(pieces.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(begins, bounds)].tolist()
        found = memoryview(ids.buffers()[2])
        own = iter([bytes(found[a:b]) for a, b in zip(ends, ends[1:])])
        return [next(own) if p else self._library(t) for t, p in zip(texts, plain)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without special tokens."""
        work, most = (self._spaced_group, _SPACED_CHARS) if self.spaced else (self._group, _GROUP_CHARS)
        out: list[bytes] = []
        group: list[str] = []
        chars = 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars >= most:
                out += work(group)
                group, chars = [], 0
        return out + work(group) if group else out


@lru_cache(maxsize=4)
def encoder(path: str, kept_words: int = KEPT_WORDS, kept_parts: int = KEPT_PARTS) -> WordEncoder:
    """One encoder per worker and file, so that what it has learned serves all tasks of the worker."""
    return WordEncoder(path, kept_words, kept_parts)
