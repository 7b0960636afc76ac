"""Language identification by unigrams marginalised over segmentations.

A word is scored under a language as the sum, over all ways to cut it into pieces
of a fixed public vocabulary, of the product of the pieces' probabilities; a
forward recursion sums them without listing them.  The vocabulary is a byte-level
rank file (it holds every byte, so every word has a segmentation) and is never
trained; the piece probabilities of each language are, by expectation-maximisation
with the same recursion run both ways.

Training reads a bounded sample: about ``SAMPLE`` documents of each language, whole.
Their word counts stay a table; each round of expectation-maximisation goes over it
in at most ``PARTS`` tasks, and only piece counts come back, a table of the size of the
vocabulary times the number of languages.  That is the size of the model too.

Words are runs of letters, of any length; sums over segmentations are rescaled along a
word, so that long words do not underflow.  Pieces with other characters than
lower-case letters cannot be in a word and are left out of the table.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
training rows without a language are ignored; equal scores go to the smaller
language name; without any training row every text is ``und``; rows are kept as
they are, repeated ones too; texts of any length are whole; an empty table gives an
empty table.  Only the id, text and language columns are read, whatever others there
are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches
from .bpe import read_ranks
from .shared import ensure_checkpoints

#: Documents of each language in the training sample, about; tasks of a round of training, at most.
SAMPLE, PARTS = 1500, 16
ROUNDS, CACHED, FLOOR = 6, 300_000, 1e-7
#: Cells (words times bytes) that are worked on at once, and places after which sums are rescaled.
CELLS, STRIDE = 1 << 17, 8
UNKNOWN = "und"

_letters = regex.compile(r"\p{L}+").findall


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _letters(text.lower()) if text else []


class Pieces:
    """The vocabulary as a sorted table of hashes, and words as matrices of piece numbers."""

    _base = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str):
        tokens = sorted(t for t in read_ranks(path) if not any(c < 0x61 or 0x7A < c < 0x80 for c in t))
        self.count = len(tokens)
        random = np.random.default_rng(5).integers(1, 1 << 63, 257, dtype=np.uint64)
        self.random = random
        hashes = np.zeros(len(tokens), np.uint64)
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        #: lengths of pieces in bytes
        self.lengths = np.unique(size).tolist()
        longest = max(self.lengths, default=1)
        flat = np.zeros((len(tokens), longest), np.int64)
        for i, t in enumerate(tokens):
            flat[i, : len(t)] = np.frombuffer(t, np.uint8)
        for j in range(longest):
            has = size > j
            hashes[has] = hashes[has] * self._base + random[flat[has, j]]
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.bits = 18
        # first place in the sorted table of each 18-bit prefix: a short bisection is left
        self.index = np.searchsorted(self.hashes, np.arange((1 << self.bits) + 1, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.depth = int(np.diff(self.index).max(initial=0))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece number of each hash, -1 where there is none."""
        top = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.index[top], self.index[top + 1]
        out = np.full(len(hashes), -1, np.int32)
        for step in range(self.depth):
            here = np.minimum(at + step, len(self.hashes) - 1)
            hit = (at + step < stop) & (self.hashes[here] == hashes)
            out[hit] = here[hit]
        return out

    def lattice(self, words: list[bytes]) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Sizes, and for each length of pieces that occurs, the piece that starts at each place of each word (-1: none)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        width, longest = int(size.max(initial=1)), self.lengths[-1]
        chars = np.zeros((len(words), width + longest), np.int64)
        for i, w in enumerate(words):
            chars[i, : len(w)] = np.frombuffer(w, np.uint8)
        out = []
        h = np.zeros((len(words), width), np.uint64)
        place = np.arange(width)
        for k in range(min(longest, width)):
            h = h * self._base + self.random[chars[:, k : k + width]]
            if k + 1 in self.lengths:
                row, col = np.nonzero(place + k < size[:, None])
                piece = np.full((len(words), width), -1, np.int32)
                piece[row, col] = self.find(h[row, col])
                if (piece >= 0).any():
                    out.append((k + 1, piece))
        return size, out


def blocks(words: list[bytes]) -> Iterator[list[int]]:
    """Words of about the same length, by number, some at a time."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * len(words[order[stop]]) <= CELLS:
            stop += 1
        yield order[at:stop]
        at = stop


def forward(size: np.ndarray, lattice: list[tuple[int, np.ndarray]], table: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all segmentations of the bytes before each place (``backward``: from it on), and their logarithmic scales.

    Both are indexed by place, word and language; the sum is the first times the exponential of the second.
    """
    n, width = len(size), int(size.max(initial=0))
    padded = np.vstack([table, np.zeros((1, table.shape[1]))])  # piece -1: probability 0
    sums = np.zeros((width + 1, n, table.shape[1]))
    scale = np.zeros((width + 1, n, table.shape[1]))
    offset = np.zeros((n, table.shape[1]))
    reach = max((k for k, _ in lattice), default=1)
    if not backward:
        sums[0] = 1
    for step in range(0 if backward else 1, width + 1):
        j = width - step if backward else step
        now = np.zeros_like(offset)
        for k, piece in lattice:
            if backward and j + k <= width:
                now += padded[piece[:, j]] * sums[j + k]
            elif not backward and k <= j:
                now += padded[piece[:, j - k]] * sums[j - k]
        if backward:
            now[size == j] = 1
        sums[j], scale[j] = now, offset
        if step % STRIDE == 0 and width > 4 * STRIDE:
            # the places that later sums need are brought near one
            near = slice(j, min(width, j + reach) + 1) if backward else slice(max(0, j - reach), j + 1)
            most = sums[near].max(axis=0)
            most = np.where(most > 0, most, 1.0)
            # places that were scaled otherwise before are needed at one scale: shift all of them
            sums[near] /= most
            scale[near] += np.log(most)
            offset = offset + np.log(most)
    return sums, scale


def word_scores(words: list[bytes], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """log probability of each word under each language."""
    out = np.zeros((len(words), table.shape[1]))
    for block in blocks(words):
        size, lattice = pieces.lattice([words[i] for i in block])
        sums, scale = forward(size, lattice, table)
        own = np.arange(len(block))
        out[block] = np.log(np.maximum(sums[size, own], 1e-300)) + scale[size, own]
    return out


def expected(words: list[bytes], counts: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected number of each piece in counted words of one language."""
    out = np.zeros(pieces.count + 1)
    padded = np.append(p, 0.0)
    for block in blocks(words):
        size, lattice = pieces.lattice([words[i] for i in block])
        (before, b), (after, a) = ((x[:, :, 0], y[:, :, 0]) for x, y in (forward(size, lattice, p[:, None], back) for back in (False, True)))
        weight, whole = counts[block], np.log(np.maximum(after[0], 1e-300)) + a[0]
        for k, piece in lattice:
            for i in range(len(after) - k):
                share = before[i] * padded[piece[:, i]] * after[i + k] * np.exp(np.minimum(b[i] + a[i + k] - whole, 700)) * weight
                out += np.bincount(np.where(piece[:, i] < 0, pieces.count, piece[:, i]), share, pieces.count + 1)
    return out[:-1]


def smoothed(expected: np.ndarray) -> np.ndarray:
    p = expected / max(expected.sum(), 1e-300)
    return (p + FLOOR) / (1 + FLOOR * len(p))


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def fit(labelled: DataFrame, path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Language names and their piece probabilities, a column each, from rows of (doc_id, text, lang)."""
    count = pieces_of(path).count
    ensure_checkpoints(labelled)
    known = labelled.filter("lang is not null and text is not null")
    number = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not number:
        return [], np.zeros((count, 0))
    share = F.element_at(F.create_map(*(x for l, n in number.items() for x in (F.lit(l), F.lit(min(1.0, sample / n))))), F.col("lang"))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)

    def tally(parts):
        for batch in batches.by_bytes(iter(parts), "text"):
            held: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, c in Counter(words_of(text)).items():
                    held[lang, w] += c
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array(held.values(), pa.int64())],
                names=["lang", "word", "n"],
            )

    words = chosen.select("lang", "text").mapInArrow(tally, "lang string, word string, n long")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(PARTS, "lang", "word").checkpoint()
    names = sorted(r[0] for r in words.select("lang").distinct().collect())
    table = np.full((count, len(names)), 1 / count)
    for _ in range(rounds if names else 0):
        total = np.zeros_like(table)

        def step(parts, table=table):
            own = pieces_of(path)
            sums = np.zeros_like(table)
            for batch in parts:
                lang, n = np.array(batch.column(0).to_pylist(), object), batch.column(2).to_numpy().astype(float)
                raw = [w.encode("utf-8", "replace") for w in batch.column(1).to_pylist()]
                for k, name in enumerate(names):
                    here = np.flatnonzero(lang == name)
                    if len(here):
                        sums[:, k] += expected([raw[i] for i in here.tolist()], n[here], own, table[:, k])
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        for (blob,) in words.mapInArrow(step, "sums binary").toLocalIterator():  # PARTS rows of the model's size, one at a time
            total += np.frombuffer(blob).reshape(table.shape)
        table = np.stack([smoothed(total[:, k]) for k in range(len(names))], 1)
    return names, table


def predict(docs: DataFrame, names: list[str], table: np.ndarray, path: str) -> DataFrame:
    """(doc_id, lang_pred, score) of each row, from its text alone; whole texts, a few megabytes at a time."""
    columns = table.astype(np.float64)  # travels with the function; it has the size of the vocabulary

    def run(parts):
        pieces, cache, held = pieces_of(path), {}, np.zeros((0, len(names)))
        for batch in batches.by_bytes(iter(parts), "text"):
            texts = [words_of(t) for t in batch.column(1).to_pylist()]
            if len(cache) > CACHED:
                cache, held = {}, held[:0]
            new = list({w for t in texts for w in t if w not in cache})
            if new and names:
                cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
                held = np.vstack([held, word_scores([w.encode("utf-8", "replace") for w in new], pieces, columns)])
            labels, best = [], []
            for t in texts:
                if not t or not names:
                    labels.append(UNKNOWN)
                    best.append(0.0)
                    continue
                total = held[np.fromiter(map(cache.__getitem__, t), np.int64, len(t))].sum(0)
                i = int(total.argmax())
                labels.append(names[i])
                best.append(1 / sum(math.exp(max(x - total[i], -700.0)) for x in total.tolist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(labels, pa.string()), pa.array(best, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """True for ids whose CRC-32 leaves ``part``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts)) == part, F.lit(False))
