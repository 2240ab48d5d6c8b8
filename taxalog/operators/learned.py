"""A lexical vector learned from labelled lines.

Words, pairs of neighbouring words and the character n-grams of words are hashed and
weighed by TF-IDF; a ridge regression maps them to one coordinate per label of the
lines. The vector of a text is a sum over its words and pairs, so a model is a table
from hashed feature to coordinates. A word met before costs one lookup, a pair one hash,
and features that no line has add nothing and are passed over. Labels are embedded from their descriptions like any text, so any taxonomy can be used;
the closer it is to the one of the lines, the better.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from importlib import resources
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame

from taxalog.operators.classify import MODEL_THRESHOLD, ModelEmbedder
from taxalog.operators.taxonomy import rows as taxonomy_rows

BITS = 16
GRAMS = (3, 4, 5)
#: Chosen by accuracy on the package's lines with whole software left out (0.1: 0.78, 0.3: 0.80, 1: 0.82).
RIDGE = 1.0
#: Words that a task remembers; beyond it, the memory starts anew after a slice of texts: one, or so many characters.
MAX_KNOWN, SLICE = 200_000, 1 << 19
#: Characters of one word that its n-grams are taken from; a longer run is a payload, not a word.
MAX_WORD = 64

_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_WORD = re.compile(r"[^\W\d_]+|(?<![\d.:/-])[1-5]\d\d(?![\d.:/-])")


def line_words(text: str) -> list[str]:
    """Lower-cased words, parts of camel case apart; of the numbers only those that can be a status."""
    # Most words are lower-case after their first letter, so there is nothing to part.
    return [part[:MAX_WORD].lower() for word in _WORD.findall(text)
            for part in ((word,) if word[1:].islower() else _HUMP.split(word))]


_MASK = (1 << BITS) - 1
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ 0xEDB88320, _CRC >> 1).astype(np.uint32)  # the table of crc32, a byte at a time
#: By the number of bytes that follow, what each byte of a crc32 becomes; the crc32 of what follows is added by exclusive or.
_MOVED = [np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]]
for _ in range(4 * MAX_WORD):
    _MOVED.append(_CRC[_MOVED[-1] & 255] ^ _MOVED[-1] >> 8)
_MOVED = (np.array(_MOVED) & _MASK).astype(np.uint16)
_BEGUN = {kind: crc32(f"{kind}:".encode()) for kind in "bcnw"}  # hashes that the names of features go on from


def word_features(word: str) -> list[int]:
    """Hashes of n:404 and n:4xx, or of w:word and c:gram of each n-gram."""
    if word.isdigit():
        return [crc32(n.encode(), _BEGUN["n"]) & _MASK for n in (word, f"{word[0]}xx")]
    marked = f"<{word}>"
    grams = [crc32(marked[i:i + n].encode(), _BEGUN["c"]) & _MASK for n in GRAMS for i in range(len(marked) - n + 1)]
    return [crc32(word.encode(), _BEGUN["w"]) & _MASK, *grams]


def gram_features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-gram the hashes of those of all words, as in ``word_features``, and how many a word has."""
    longest, sizes = max(GRAMS), np.array([len(w) + 2 for w in words])
    raw = np.frombuffer("".join(f"<{w}>" for w in words).encode() + bytes(longest + 4), np.uint8)
    first = np.flatnonzero(raw & 0xC0 != 0x80)  # of the bytes of each character
    width = np.diff(first, append=len(raw))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())  # characters to the end of the word
    state = np.full(len(left), ~np.uint32(_BEGUN["c"]))
    for n in range(1, longest + 1):
        at, bytes_of = first[n - 1:n - 1 + len(left)], width[n - 1:n - 1 + len(left)]
        for k in range(width[:-longest - 4].max()):
            state = np.where(bytes_of > k, _CRC[(state ^ raw[at + k]) & 255] ^ (state >> 8), state)
        if n in GRAMS:
            yield (~state & _MASK)[left >= n].astype(np.int64), np.maximum(sizes - n + 1, 0)


def parts(text: str) -> list[str]:
    """The distinct words of a text and its pairs of neighbours, joined by a blank; each stands for fixed features."""
    words = line_words(text)
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))


def part_features(part: str) -> np.ndarray:
    return np.array([crc32(part.encode(), _BEGUN["b"]) & _MASK] if " " in part else word_features(part), dtype=np.int64)


def part_weights(part: str, size: int) -> np.ndarray:
    """A word, or a pair, weighs as much as all n-grams of a word together."""
    if size == 1 or part.isdigit():
        return np.ones(size)
    return np.r_[1.0, np.full(size - 1, 1.0 / np.sqrt(size - 1))]


class LearnedModel:
    """``embed(texts)``: float32 rows of one coordinate per label of ``lines``, a list of (label, text)."""

    def __init__(self, lines: list[tuple[str, str]], ridge: float = RIDGE):
        self.names = sorted({label for label, _ in lines})
        cells = [[(part_features(p), p) for p in parts(text)] for _, text in lines]
        seen = np.zeros(1 << BITS)
        for line in cells:
            seen[np.unique(np.concatenate([f for f, _ in line] or [np.zeros(0, dtype=np.int64)]))] += 1
        self.idf = np.log((1 + len(lines)) / (1 + seen)).astype(np.float64)
        used = np.flatnonzero(seen)
        column = np.full(1 << BITS, -1)
        column[used] = np.arange(len(used))
        x = np.zeros((len(lines), len(used)))
        for row, line in zip(x, cells):
            for features, part in line:
                np.add.at(row, column[features], self.idf[features] * part_weights(part, len(features)))
        x /= np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None]
        y = (np.array([label for label, _ in lines])[:, None] == np.array(self.names)).astype(float)
        # Lines per label differ; each label weighs the same in total.
        weight = np.sqrt(len(lines) / (len(self.names) * y.sum(axis=0)))[y.argmax(axis=1)][:, None]
        x, y = x * weight, y * weight
        dual = np.linalg.solve(x @ x.T + ridge * np.eye(len(lines)), y)
        self.place = column.astype(np.int32)  # of a feature in ``table``, -1 where no line has it
        self.table = (self.idf[used][:, None] * (x.T @ dual)).astype(np.float32)
        #: Words with their row in ``vectors`` and ``hashes``: of "b:word ", of the word, and the word's length in bytes.
        self.known: dict[str, int] = {}
        self.vectors = np.zeros((0, len(self.names)), dtype=np.float32)
        self.hashes = np.zeros((0, 3), dtype=np.uint32)

    def learn(self, words: list[str]) -> None:
        """Puts the vectors of new words behind those of the known ones."""
        at, end = len(self.known), len(self.known) + len(words)
        if end > len(self.vectors):
            more = max(end, min(2 * end, MAX_KNOWN)) - at
            self.vectors, self.hashes = (np.concatenate([a[:at], np.zeros((more, a.shape[1]), a.dtype)]) for a in (self.vectors, self.hashes))
        self.known.update(zip(words, range(at, end)))
        for start in range(0, len(words), 1 << 12):
            some = words[start:start + (1 << 12)]
            to = slice(at + start, at + start + len(some))
            number = np.array([w.isdigit() for w in some])
            if not number.all():
                self.vectors[to][~number] = self.word_vectors([w for w, is_one in zip(some, number) if not is_one])
            if number.any():
                lists = [word_features(w) for w, is_one in zip(some, number) if is_one]
                self.vectors[to][number] = self.summed(joined(lists), np.array([len(f) for f in lists]))
            coded = [w.encode() for w in some]
            self.hashes[to] = np.transpose([[crc32(w + b" ", _BEGUN["b"]) for w in coded], [*map(crc32, coded)], [*map(len, coded)]])

    def word_vectors(self, words: list[str]) -> np.ndarray:
        """The vectors of words that are no numbers."""
        whole = np.fromiter((crc32(w.encode(), _BEGUN["w"]) & _MASK for w in words), np.int64, len(words))
        grams, n = 0.0, np.zeros(len(words), dtype=np.int64)
        for features, sizes in gram_features(words):
            grams, n = grams + self.summed(features, sizes), n + sizes
        return self.summed(whole, np.ones(len(words), dtype=np.int64)) + grams / np.sqrt(n)[:, None]

    def summed(self, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The coordinates of features, added up run by run of ``sizes``."""
        place = self.place[features]
        ends = np.concatenate([[0], np.cumsum(place >= 0)])[np.cumsum(sizes)]
        return run_sums(self.table[place[place >= 0]], np.diff(ends, prepend=0))

    def pair_features(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of pairs of known words."""
        begun, (_, ended, more) = self.hashes[a, 0], self.hashes[b].T
        moved = [_MOVED[more, k, begun >> np.uint32(8 * k) & 255] for k in range(4)]
        return ((ended & _MASK) ^ moved[0] ^ moved[1] ^ moved[2] ^ moved[3]).astype(np.int64)

    def embed(self, texts: list[str]) -> np.ndarray:
        """A text without a word gives zeros, which have similarity 0 to every label."""
        out, slices, size = np.zeros((len(texts), len(self.names)), dtype=np.float32), [0], 0
        for k, text in enumerate(texts):
            if size + len(text) > SLICE and k > slices[-1]:
                slices.append(k)
                size = 0
            size += len(text)
        for start, end in zip(slices, [*slices[1:], len(texts)]):
            out[start:end] = self.sums([line_words(t) for t in texts[start:end]])
            if len(self.known) > MAX_KNOWN:
                self.known.clear()
        return out

    def sums(self, lines: list[list[str]]) -> np.ndarray:
        """What the distinct words and pairs of each line add up to, in order of their first occurrence."""
        self.learn([w for w in dict.fromkeys(itertools.chain.from_iterable(lines)) if w not in self.known])
        words = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(lines)), np.int64)
        line, n = np.repeat(np.arange(len(lines)), np.array([len(w) for w in lines], dtype=int)), len(self.known)

        def distinct(codes, line):
            at = np.sort(np.unique(codes, return_index=True)[1])
            return at, np.bincount(line[at], minlength=len(lines))
        at, sizes = distinct(line * n + words, line)
        out = run_sums(self.vectors[words[at]], sizes)
        first = np.flatnonzero(line[1:] == line[:-1])  # of each pair
        a, b, line = words[first], words[first + 1], line[first]
        at, sizes = distinct((line * n + a) * n + b, line)
        return out + self.summed(self.pair_features(a[at], b[at]), sizes)


def joined(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64)


def run_sums(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``rows``; an empty run gives zeros."""
    out = np.zeros((len(sizes), rows.shape[1]))
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[full], axis=0, dtype=np.float64)
    return out


def read_lines() -> list[tuple[str, str, str]]:
    """(label, software, line) of the package's labelled lines."""
    text = resources.files("taxalog.operators").joinpath("lines.tsv").read_text(encoding="utf-8")
    return [tuple(line.split("\t")) for line in text.splitlines()]


def labelled(roots=None) -> list[tuple[str, str]]:
    """Lines to learn from: those of the package and the descriptions of the labels."""
    return [(label, line) for label, _, line in read_lines()] + [(row[3], row[6]) for row in taxonomy_rows(roots)]


class LearnedEmbedder:
    """``LearnedModel`` fitted once per task from lines that travel with the query, some 30 KB; nothing is downloaded."""

    #: Of the package's lines with their software left out, one in a hundred is right but falls below it.
    threshold = MODEL_THRESHOLD

    def __init__(self, lines: list[tuple[str, str]] | None = None):
        self.lines = labelled() if lines is None else lines

    def match(self, text: Column, labels: DataFrame) -> tuple[Column, Column]:
        lines = self.lines
        return ModelEmbedder(lambda: LearnedModel(lines)).match(text, labels)
