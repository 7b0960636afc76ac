"""Byte-level BPE over padded numpy matrices.

A text is split by the vocabulary's pattern.  Distinct pieces that are not cached
yet are encoded together: pieces of about the same length fill the rows of one
matrix of token ids, and in each round every row merges its leftmost pair of the
least rank; the row is compacted and only the two pairs beside the new token are
looked up again, in an open-addressing hash table of all mergeable pairs.  Rows
without a mergeable pair leave the matrix.

A piece of many bytes (a text without any break) is a row of its own.  There a round
merges all places of the least rank, from the left, up to the first merge that makes
a pair of a lesser rank, which is what the single merges would have done; merged
places become holes, and the row is compacted when a quarter of it are holes.  So the
rounds of a long row follow its distinct ranks, not its length.

Defined results: a null text is the empty text (no ids, no bytes); special-token
strings in a text are ordinary text; every row, repeated ones too, gives one row;
equal ranks merge from the left; texts of any length are whole; an empty table gives
an empty table.  Only the id and text columns are read, whatever others there are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import batches

#: Bytes from which a piece is a row of its own.
WIDE = 256
#: Pieces kept per Python worker before the cache starts anew.
CACHED = 300_000
NONE = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 token, blank, rank on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTable:
    """Open-addressing table from a pair of token ids to the id of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        values = np.array(made, np.int32)
        todo = np.arange(len(keys))
        step = 0
        while len(todo):  # each round places one key in every free slot that is asked for
            slot = self._slot(keys[todo], step)
            free = self.keys[slot] == np.iinfo(np.uint64).max
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = first[free[first]]
            self.keys[slot[put]] = keys[todo[put]]
            self.values[slot[put]] = values[todo[put]]
            keep = np.ones(len(todo), bool)
            keep[put] = False
            todo = todo[keep]
            step += 1
        self.steps = step

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (((mixed >> np.uint64(64 - self.bits)) + np.uint64(step)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged tokens, ``NONE`` where the pair does not merge (ids below 0: padding)."""
        keys = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | right.astype(np.int64).astype(np.uint64)
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for step in range(self.steps):
            if not len(todo):
                break
            slot = self._slot(keys[todo], step)
            held = self.keys[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            todo = todo[~hit & (held != np.iinfo(np.uint64).max)]
        return out


class Codec:
    """Encoder and decoder for one rank file and split pattern; made once per Python worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pairs = PairTable(self.ranks)
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.cache: dict[str, bytes] = {}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        if len(self.cache) > CACHED:
            self.cache = {}
        new = list({p for pieces in split for p in pieces if p not in self.cache})
        self.cache.update(zip(new, self.encode_pieces([p.encode("utf-8", "replace") for p in new]), strict=True))
        held = self.cache.__getitem__
        return [b"".join(map(held, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece; a piece that is a token itself is that token."""
        out: list[bytes] = [b""] * len(pieces)
        rows: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > WIDE:
                out[i] = self._row(piece).astype("<u4").tobytes()
            elif piece:
                rows.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, which in rows.items():
            block = max(1, (1 << 20) // width)
            for at in range(0, len(which), block):
                part = which[at : at + block]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        columns = np.arange(width)
        ids = np.where(columns < sizes[:, None], self.byte_ids[flat], -1).astype(np.int32)
        done: list[bytes | None] = [None] * len(pieces)
        ranks = self.pairs.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        live = np.arange(len(pieces))
        while len(live):
            at = ranks.argmin(axis=1)  # the first of equal minima
            best = ranks[np.arange(len(live)), at]
            over = best == NONE
            if over.any():
                for row in np.flatnonzero(over):
                    done[live[row]] = ids[row, : sizes[row]].astype("<u4").tobytes()
                stay = ~over
                live, ids, ranks, sizes, at, best = live[stay], ids[stay], ranks[stay], sizes[stay], at[stay], best[stay]
                if not len(live):
                    break
            sizes = sizes - 1
            used = int(sizes.max())
            row = np.arange(len(live))
            shift = np.minimum(columns[:used] + (columns[:used] > at[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, shift, axis=1)
            ids[row, at] = best
            ids = np.where(columns[:used] < sizes[:, None], ids, -1)
            if used < 2:
                for r in row:
                    done[live[r]] = ids[r, : sizes[r]].astype("<u4").tobytes()
                break
            moved = np.minimum(columns[: used - 1] + (columns[: used - 1] > at[:, None]), ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, moved, axis=1)
            padded = np.concatenate([ids, np.full((len(live), 1), -1, np.int32)], axis=1)
            inside = np.flatnonzero(at < used - 1)
            ranks[inside, at[inside]] = self.pairs.look_up(padded[inside, at[inside]], padded[inside, at[inside] + 1])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.pairs.look_up(padded[before, at[before] - 1], padded[before, at[before]])
            ranks = np.where(columns[: used - 1] < sizes[:, None] - 1, ranks, NONE)
        return done  # type: ignore[return-value]

    def _row(self, piece: bytes) -> np.ndarray:
        """Ids of a piece of any length."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]

        def laid(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = len(ids)
            ranks = np.full(n, NONE, np.int32)
            ranks[:-1] = self.pairs.look_up(ids[:-1], ids[1:])
            return ranks, np.arange(1, n + 1), np.arange(-1, n - 1)

        ranks, after, before = laid(ids)
        live = len(ids)
        while True:
            best = ranks.min()
            if best == NONE:
                return ids[ids >= 0]
            at = np.flatnonzero(ranks == best)
            # of overlapping places the first, third, and so on
            number = np.arange(len(at))
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            at = at[(number - np.maximum.accumulate(np.where(chained, 0, number))) % 2 == 0]
            second = after[at]
            behind, ahead = after[second], before[at]
            # the pairs that each merge makes as it is done, with the places before it merged and those after it not
            left = np.where(ahead >= 0, ids[np.maximum(ahead, 0)], -1)
            left[1:][ahead[1:] == second[:-1]] = best
            right = np.where(behind < len(ids), ids[np.minimum(behind, len(ids) - 1)], -1)
            made = np.full(len(at), best, np.int32)
            lesser = (self.pairs.look_up(left, made) < best) | (self.pairs.look_up(made, right) < best)
            if lesser.any():
                stop = int(lesser.argmax()) + 1
                at, second, behind = at[:stop], second[:stop], behind[:stop]
            ids[at], ids[second], ranks[second], after[at] = best, -1, NONE, behind
            inner = behind < len(ids)
            before[behind[inner]] = at[inner]
            live -= len(at)
            if 4 * live < 3 * len(ids):
                ids = ids[ids >= 0]
                ranks, after, before = laid(ids)
                continue
            ranks[at] = NONE
            ranks[at[inner]] = self.pairs.look_up(ids[at[inner]], ids[behind[inner]])
            first = at[before[at] >= 0]
            ranks[before[first]] = self.pairs.look_up(ids[before[first]], ids[first])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file; its tables have the size of the vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def round_trip(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False
) -> DataFrame:
    """Per row: the id, ``ids`` (little-endian unsigned 32-bit, packed) and ``decoded`` bytes of those ids.

    With ``keep_text`` the text (null: empty) comes too.  A narrow map: no shuffle,
    and a few megabytes of text in memory at a time.
    """

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches.by_bytes(iter(parts), "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = own.encode_all(texts)
            columns = [batch.column(0), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())]
            if keep_text:
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded", "text"][: len(columns)])

    two = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return two.mapInArrow(run, "doc_id long, ids binary, decoded binary" + ", text string" * keep_text)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``ids`` as an array of token ids."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches.by_bytes(iter(parts), "text"):
            ids = own.encode_all([t or "" for t in batch.column(1).to_pylist()])
            arrays = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(arrays, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    two = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return two.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The bytes of each row's ``ids`` array (null: no ids), beside its ``doc_id``."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in parts:
            texts = [own.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
