"""Public tokenizers inside tasks: loaded once per process from a path, never trained here."""

from __future__ import annotations

import base64
from collections import defaultdict
from functools import lru_cache
from itertools import chain, count
from pathlib import Path

import numpy as np


def public(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a file of byte ranks."""
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """The byte-level encoder of a file of ranks, without special tokens."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={}
    )


@lru_cache(maxsize=2)
def word_bpe(path: str):
    """The word-level encoder of a tokenizer file, as the library reads it."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ragged(flat: np.ndarray, ends: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``flat`` (run i ends at ``ends[i]``), one after the other."""
    starts = np.concatenate([[0], ends[:-1]])[which]
    sizes = ends[which] - starts
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return flat[np.arange(len(shift)) + shift]


class _Numbers(defaultdict):
    """Words by number, the empty one 0; one that is asked for first gets the next number."""

    def __init__(self):
        super().__init__(count(1).__next__, {"": 0})

    def of(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """The numbers of the words, and those that are new, in the order of their numbers."""
        before = len(self)
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self) == before:
            return numbers, []
        highest = np.maximum.accumulate(np.concatenate([[before - 1], numbers]))
        return numbers, [words[i] for i in np.flatnonzero(numbers > highest[:-1]).tolist()]


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, each new word encoded once.

    The tokenizer splits at white space and between letters and other signs, and
    its lower-casing works sign by sign, so the ids of a text are those of its
    words in turn, and those of a word of letters with closing marks are those
    of the letters and of the marks.  Words of letters are encoded many at a
    time: the last id of a word is one that ends words.  About ``remembered``
    words are kept."""

    CLOSING = ".,;:!?%&$*#|)\""
    TOGETHER = 1000

    def __init__(self, path: str, remembered: int = 300_000):
        self.tokenizer = word_bpe(path)
        self.remembered = remembered
        vocabulary = self.tokenizer.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ending[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.words = _Numbers()
        #: Parts of each word, letters and closing marks, by number; part 0 is empty.
        self.halves = np.zeros((1, 2), np.int64)
        self.parts = _Numbers()
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode_parts(self, parts: list[str]) -> None:
        """Ids of new parts, which have the numbers that follow, in this order."""
        plain = [p for p in parts if p.isalpha()]
        groups = [plain[i : i + self.TOGETHER] for i in range(0, len(plain), self.TOGETHER)]
        flat, sizes, alone, at = [], [], [], 0
        places = np.flatnonzero(np.fromiter(map(str.isalpha, parts), bool, len(parts)))
        order, others = [], np.setdiff1d(np.arange(len(parts)), places, assume_unique=True).tolist()
        encoded = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, found in zip(groups, encoded, strict=True):
            ids = np.array(found.ids, np.int64)
            ends = np.flatnonzero(self.ending[ids]) + 1
            here = places[at : at + len(group)]
            at += len(group)
            if len(ends) != len(group):
                others += here.tolist()
                continue
            flat.append(ids)
            sizes.append(np.diff(ends, prepend=0))
            order.append(here)
        alone = self.tokenizer.encode_batch_fast([parts[i] for i in others], add_special_tokens=False) if others else []
        flat += [np.array(found.ids, np.int64) for found in alone]
        sizes.append(np.array([len(found.ids) for found in alone], np.int64))
        order.append(np.array(others, np.int64))
        # Back into the order of their numbers.
        flat, sizes, order = np.concatenate(flat), np.concatenate(sizes), np.concatenate(order)
        back = np.argsort(order)
        flat = ragged(flat, np.cumsum(sizes), back)
        self.ends = np.concatenate([self.ends, len(self.flat) + np.cumsum(sizes[back])])
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])

    def _learn(self, words: list[str]) -> None:
        closing, cores, tails = self.CLOSING, words.copy(), [""] * len(words)
        letters = np.fromiter(map(str.isalpha, words), bool, len(words))
        for i in np.flatnonzero(~letters).tolist():
            core = words[i].rstrip(closing)
            if core.isalpha() and "Σ" not in core:
                cores[i], tails[i] = core.lower(), words[i][len(core) :]
        # Only this letter becomes another one by its place in the word.
        plain = [i for i in np.flatnonzero(letters).tolist() if "Σ" not in words[i]]
        for i, low in zip(plain, "\n".join([words[i] for i in plain]).lower().split("\n"), strict=False):
            cores[i] = low
        halves, new = self.parts.of(cores + tails)
        if new:
            self._encode_parts(new)
        self.halves = np.concatenate([self.halves, halves.reshape(2, -1).T])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > self.remembered:
            self._forget()
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        words = list(chain.from_iterable(split))
        known, new = self.words.of(words)
        if new:
            self._learn(new)
        parts = self.halves[known].ravel()
        sizes = (self.ends[parts] - np.concatenate([[0], self.ends[:-1]])[parts]).reshape(-1, 2).sum(axis=1)
        reached = np.concatenate([[0], np.cumsum(sizes)])
        cuts = reached[np.cumsum([len(s) for s in split])[:-1]]
        return np.split(ragged(self.flat, self.ends, parts), cuts)


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this process; what it has learned serves the tasks that follow."""
    return WordEncoder(path)
