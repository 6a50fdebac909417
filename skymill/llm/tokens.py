"""Byte-level BPE encoding with the tokenizers library, one call per distinct word instead of one per text.

The pre-tokenizer of the vocabularies used here never crosses a place where a single space stands between two
characters that are not white space: a piece takes at most the one space before it. So the ids of a text are the
ids of the units between such places, put after each other, and each distinct unit needs encoding only once per
worker. Texts with other white space keep it inside longer units.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np

MEMO_LIMIT = 700_000  # units kept per worker; the memo starts anew beyond it, at the next call
JOINED = 500  # units encoded in one call


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file stands on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Units(dict):
    """Unit -> place in ``table``; a unit not seen before gets the next place and waits in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.table: list[bytes | None] = []
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        at = self[unit] = len(self.table)
        self.table.append(None)
        self.fresh.append(unit)
        return at


class Encoder:
    """Encodes texts to little-endian id bytes, two bytes an id where the vocabulary allows it.

    The string of an added token inside a text becomes that token, as the library has it; with ``plain`` it is ordinary
    text, so that nobody can write control tokens into a corpus. Texts with such a string are encoded whole.
    """

    def __init__(self, path: str, limit: int = MEMO_LIMIT, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        spaced = np.zeros(size, dtype=bool)
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            spaced[i] = piece.startswith("Ġ")  # how a byte-level vocabulary writes a space
        self.spaced = spaced
        self.limit = limit
        self.inner, self.first = _Units(), _Units()

    def _ids(self, text: str) -> np.ndarray:
        got = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(got.ids, dtype=self.dtype)

    def _learn_inner(self) -> None:
        """Ids of the fresh units as they stand after one space; units with white space at an end get none."""
        units, table = self.inner, self.inner.table
        plain = [w for w in units.fresh if w and not w[0].isspace() and not w[-1].isspace()]
        units.fresh = []
        for k in range(0, len(plain), JOINED):
            some = plain[k : k + JOINED]
            ids = self._ids(" " + " ".join(some))
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(some) and starts[0] == 0:
                raw, width = ids.tobytes(), self.dtype.itemsize
                at = (starts * width).tolist()
                for w, a, b in zip(some, at, [*at[1:], len(raw)]):
                    table[units[w]] = raw[a:b]
            else:
                for w in some:
                    table[units[w]] = self._ids(" " + w).tobytes()

    def _learn_first(self) -> None:
        fresh, self.first.fresh = self.first.fresh, []
        for w, got in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)):
            self.first.table[self.first[w]] = np.array(got.ids, dtype=self.dtype).tobytes()

    def _in_units(self, words: list[str]) -> bytes:
        """A text whose white space is not single spaces between words."""
        units = [words[0]]
        for before, word in zip(words, words[1:]):
            if before and word and not before[-1].isspace() and not word[0].isspace():
                units.append(word)
            else:
                units[-1] += " " + word
        rest = [self._ids(" " + u).tobytes() for u in units[1:]]
        return b"".join([self._ids(units[0]).tobytes(), *rest])

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as bytes; null counts as empty."""
        for units in (self.inner, self.first):
            if len(units) > self.limit:
                units.clear()
                units.table.clear()
        split, places = [], []
        place = self.inner.__getitem__
        whole = {}
        for t in texts:
            if t and any(a in t for a in self.added):
                whole[len(split)] = self._ids(t).tobytes()
                t = ""
            words = (t or "").split(" ")
            split.append(words)
            places.append(list(map(place, words[1:])))
        first = [self.first[words[0]] for words in split]
        self._learn_inner()
        self._learn_first()
        known, start, out = self.inner.table.__getitem__, self.first.table, []
        for words, at, head in zip(split, places, first):
            if at and (not words[0] or words[0][-1].isspace()):
                out.append(self._in_units(words))
                continue
            try:
                out.append(start[head] + b"".join(map(known, at)))
            except TypeError:  # a unit without ids
                out.append(self._in_units(words))
        for i, ids in whole.items():
            out[i] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per vocabulary and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
