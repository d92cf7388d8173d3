"""Whole texts to token ids, with the `tokenizers` library and a public vocabulary.

The byte-level pre-tokeniser begins a token at every space that a non-space follows, and between letters
and what is none (but for an apostrophe or a run of white space before a letter), so a text may be cut
there without changing its ids. A block of texts is cut in numpy, Arrow names its distinct pieces, the
library encodes those that the worker has not met, and the ids are gathered by piece. A worker keeps
KEPT_PIECES pieces at most, as Arrow bytes and one array of ids (about 40 bytes each). The vocabulary file must exist on every executor; it is a parameter.

Pieces of Latin letters alone are one word to the pre-tokeniser; they go to the library as words that are
split already, in the byte alphabet of the vocabulary, which takes half the time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kmerlake.llm.textkit import blocks

END = 2
KEPT_PIECES = 300_000
BLOCK_TEXT = 1 << 21
AT_ONCE = 10_000  # pieces to a call of the library

# What may begin white space: ASCII's, and the lead bytes of Unicode's. A cut less is always right.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ASCII_OTHER = ~_ASCII_LETTER
_ASCII_OTHER[128:] = False
_LINE = np.zeros(256, bool)
_LINE[0x09:0x0E] = True
_BEFORE_LETTER = _ASCII_OTHER & ~_MAYBE_SPACE
_BEFORE_LETTER[0x27] = False
_NO_SPACE = ~_MAYBE_SPACE
_NO_SPACE[128:] = False
# Second bytes of the letters C3 80 to C3 BF.
_LATIN = np.zeros(256, bool)
_LATIN[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _byte_alphabet() -> dict[int, str]:
    """A character for each byte: printable ones stand for themselves, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)}


_ALPHABET = _byte_alphabet()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.splitter = self.tokenizer.pre_tokenizer
        vocabulary = self.tokenizer.get_vocab()
        # a byte-level token has a character for each byte of text
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._forget()

    def _forget(self) -> None:
        self.pieces = pa.array([], pa.large_binary())
        self.ids, self.first, self.seen = np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.uint8)

    def _whole(self, text: str | list[str]) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], is_pretokenized=isinstance(text, list), add_special_tokens=False)[0].ids, np.uint32)

    def _each(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def _cut(self, ids: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row, cut where the bytes of the tokens reach the pieces' ends."""
        reached = np.cumsum(self.sizes[ids])
        wanted = np.cumsum([len(p) for p in pieces])
        ends = np.searchsorted(reached, wanted) + 1
        if ends[-1] != len(ids) or (reached[ends - 1] != wanted).any():
            return self._each(pieces)
        return ids, np.diff(ends, prepend=0)

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each piece has)."""
        # 0: a word in ASCII, 1: a word, 2: begins a token wherever it stands, 3: others
        kind = np.array([1 - p.isascii() if _WORD.fullmatch(p) else 2 if p[:1] == b" " and len(p) > 1 and not _MAYBE_SPACE[p[1]] else 3 for p in pieces], np.int8)
        sizes = np.zeros(len(pieces), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(4):
            at = np.flatnonzero(kind == k)
            for i in range(0, len(at), AT_ONCE):
                own = at[i : i + AT_ONCE]
                some = [pieces[j] for j in own.tolist()]
                if k < 2:
                    line = b"\n".join(some).decode("latin-1")
                    line = line.translate(_ALPHABET) if k else line.replace(" ", _ALPHABET[32]).replace("\n", _ALPHABET[10])
                    self.tokenizer.pre_tokenizer = None
                    try:
                        ids = self._whole(line.split(_ALPHABET[10]))
                    finally:
                        self.tokenizer.pre_tokenizer = self.splitter
                    ids, n = self._cut(ids, some)
                elif k == 2:
                    ids, n = self._cut(self._whole(b"".join(some).decode()), some)
                else:
                    ids, n = self._each(some)
                sizes[own] = n
                parts.append((own, ids))
        first = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(first[-1], np.uint32)
        for own, ids in parts:
            out[_spread(first[own], sizes[own])] = ids
        return out, sizes

    def _keep(self, used: np.ndarray) -> None:
        """Beyond the bound, pieces that only one block had go; if that is not enough, all do."""
        self.seen[used] = np.minimum(self.seen[used], 254) + 1
        if len(self.pieces) > KEPT_PIECES:
            stay = np.flatnonzero(self.seen > 1)
            if len(stay) > KEPT_PIECES // 2:
                return self._forget()
            size = np.diff(self.first)[stay]
            self.ids = self.ids[_spread(self.first[stay], size)]
            self.pieces, self.first, self.seen = self.pieces.take(pa.array(stay)), np.concatenate([[0], np.cumsum(size)]), self.seen[stay] - 1

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a block of texts, an end id behind each."""
        begin = data == 0x20
        begin[:-1] &= ~_MAYBE_SPACE[data[1:]]
        begin[at[1:][at[1:] > 0] - 1] = False
        letter = _ASCII_LETTER[data]
        latin = np.flatnonzero((data[:-1] == 0xC3) & _LATIN[data[1:]])
        letter[latin] = letter[latin + 1] = True
        begin[1:] |= letter[:-1] & _ASCII_OTHER[data[1:]] | _BEFORE_LETTER[data[:-1]] & letter[1:]
        begin[2:] |= _NO_SPACE[data[:-2]] & _LINE[data[1:-1]] & letter[2:]
        begin[at[:-1][at[:-1] < at[1:]]] = True
        starts = np.flatnonzero(begin)
        places = pa.py_buffer(np.append(starts, len(data)))
        named = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, places, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        known = pc.index_in(named.dictionary, value_set=self.pieces).fill_null(-1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            new = named.dictionary.take(pa.array(missing))
            ids, sizes = self._learn(new.to_pylist())
            known[missing] = len(self.pieces) + np.arange(len(missing))
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.ids, self.seen = np.concatenate([self.ids, ids]), np.append(self.seen, np.zeros(len(missing), np.uint8))
        own = known[named.indices.to_numpy()]
        size = np.diff(self.first)[own]
        of = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, at)]
        out = np.insert(self.ids[_spread(self.first[own], size)], of[1:], END)
        self._keep(known)
        return out, of + np.arange(len(of))

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets) of runs of whole texts, an end id behind each; null texts are empty."""
        for row, data, at in blocks(texts, BLOCK_TEXT):
            yield row, *self.encode(data, at)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... size[0] numbers, then from first[1] on."""
    total = np.cumsum(size)
    return np.repeat(first - total + size, size) + np.arange(total[-1] if len(total) else 0)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
