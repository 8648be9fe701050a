"""Byte-level vocabularies and the pretoken patterns of the public tokenizers; paths are parameters."""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import regex
from tokenizers import Tokenizer

from .shared import process_cache

#: Code points of Unicode White_Space, the \s of both pretoken patterns.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the byte-level vocabulary's pretoken pattern.
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Fixed value: the word vocabulary's pretoken pattern.
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next from U+0100 on."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


LETTER_OF = {b: c for b, c in enumerate(byte_letters())}
BYTE_OF = {c: b for b, c in LETTER_OF.items()}


def as_letters(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(LETTER_OF)


def load_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Remembered:
    """Strings by number, with the ids of each in one flat array; at ``keep`` strings those not used for longest are forgotten."""

    def __init__(self, keep: int):
        self.keep, self.turn, self.numbers = keep, 0, {}
        self.size, self.begin, self.used, self.flat = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint32))

    def numbers_of(self, names: list[str], ids_of) -> np.ndarray:
        """The numbers of strings; ``ids_of`` gives the sizes and ids of those that are new. Numbers hold until the next call."""
        self.turn += 1
        if len(self.numbers) > self.keep:
            stay = self.used > np.median(self.used)
            kept = [w for w, s in zip(self.numbers, stay.tolist(), strict=True) if s]
            flat = self.ids(np.flatnonzero(stay))
            self.numbers = dict(zip(kept, range(len(kept)), strict=True))
            self.size, self.used, self.flat = self.size[stay], self.used[stay], flat
            self.begin = np.cumsum(self.size) - self.size
        numbers = self.numbers
        fresh = list(dict.fromkeys(w for w in names if w not in numbers))
        if fresh:
            size, flat = ids_of(fresh)
            numbers.update(zip(fresh, range(len(numbers), len(numbers) + len(fresh)), strict=True))
            self.begin = np.append(self.begin, len(self.flat) + np.cumsum(size) - size)
            self.size, self.flat = np.append(self.size, size), np.append(self.flat, flat)
            self.used = np.append(self.used, np.zeros(len(fresh), np.int64))
        found = np.fromiter(map(numbers.__getitem__, names), np.int64, len(names))
        self.used[found] = self.turn
        return found

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of strings one after the other."""
        n = self.size[numbers]
        done = np.cumsum(n)
        return self.flat[np.repeat(self.begin[numbers] - (done - n), n) + np.arange(int(done[-1]) if len(done) else 0)]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return size, np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))


class WordEncoder:
    """Ids of single words under the lower-casing word vocabulary.

    White space parts its pretokens, so a text's ids are its words' ids in a row. Words of Latin letters take the model alone,
    pretoken by pretoken; all others take the library's whole chain.
    """

    def __init__(self, path: str, keep: int):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.latin, self.ascii = regex.compile(WORD_PATTERN + r"|\n"), re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\n]+|\n")
        self.words, self.pretokens = Remembered(keep), Remembered(keep)

    def _pretoken_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize = self.model.tokenize
        return _flat([[] if p == "\n" else [t.id for t in tokenize(p if p.isascii() and p.isprintable() else as_letters(p))] for p in pieces])

    def _by_pretokens(self, words: list[str], pattern) -> tuple[np.ndarray, np.ndarray]:
        pieces = pattern.findall("\n".join(words).lower() + "\n")
        found = self.pretokens.numbers_of(pieces, self._pretoken_ids)
        word = np.cumsum(np.fromiter(("\n" == p for p in pieces), bool, len(pieces)))
        return np.bincount(word, weights=self.pretokens.size[found], minlength=len(words) + 1)[: len(words)].astype(np.int64), self.pretokens.ids(found)

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        kind = np.fromiter((2 if "<|" in w else 0 if w.isascii() else 1 if max(w) < "ɐ" and "İ" not in w else 2 for w in words), np.int8, len(words))
        size, parts = np.zeros(len(words), np.int64), []
        for k, way in enumerate((lambda x: self._by_pretokens(x, self.ascii), lambda x: self._by_pretokens(x, self.latin), lambda x: _flat([e.ids for e in self.tokenizer.encode_batch(x, add_special_tokens=False)]))):
            at = np.flatnonzero(kind == k)
            size[at], flat = way([words[i] for i in at.tolist()]) if len(at) else (0, np.zeros(0, np.uint32))
            parts.append((at, flat))
        begin = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        for at, flat in parts:
            n = size[at]
            out[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
        return size, out

    def look_up(self, words: list[str]) -> np.ndarray:
        """The words' numbers in ``words``, a Remembered, until the next call."""
        return self.words.numbers_of(words, self._word_ids)


@process_cache
def word_encoder(path: str, keep: int) -> WordEncoder:
    """One encoder a worker process, so that its memory outlives a task."""
    return WordEncoder(path, keep)
