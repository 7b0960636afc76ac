"""Units and buckets: shuffling many small hashed facts as a few packed arrays.

Rows are dealt to *units* by a hash of their key; a unit is some megabytes of
whole texts, worked on as flat numpy arrays.  What a unit says about hashed
things (shingles, anchors, tokens) goes to *buckets*, hash ranges of about equal
volume, as one packed array per sender and bucket, and a bucket answers with an
array in the same order.

A unit's facts are merged before they leave it, so a thing that a third of all
rows share reaches its bucket once per unit.

*Number of messages.*  A bucket holds the facts of several units.  While there are
few buckets, units write to them directly.  Beyond ``FAN`` buckets that would make
units times buckets messages, so facts take two hops: units write to about
sqrt(buckets) *ranges* of buckets; a node for each group of units and range merges
what its units say of it (a combiner) and writes to the range's buckets; answers
come back the same way.  That is about 2 * units * sqrt(buckets) messages each way,
and a bucket hears of a shared thing once per group.  ``Layout.messages`` states
the number for any size.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a unit, and of the texts whose facts a bucket holds, about.
UNIT_BYTES, BUCKET_UNITS = 6 << 20, 3
#: Units in a partition of the texts, about.
UNITS_EACH = 2
#: Buckets that units write to directly, at most.
FAN = 128
#: Id that stands for a null id, after all others.
NO_ID = np.iinfo(np.int64).max


def text_bytes(docs: DataFrame, text: Column) -> int:
    """Bytes of all texts (one pass over the text column)."""
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


@dataclass(frozen=True)
class Layout:
    """How many units, buckets, ranges of buckets and groups of units there are."""

    units: int
    buckets: int
    ranges: int
    groups: int

    @staticmethod
    def of(total_bytes: int, unit_bytes: int = UNIT_BYTES, fan: int = FAN) -> Layout:
        units = max(1, math.ceil(total_bytes / unit_bytes))
        buckets = max(1, math.ceil(units / BUCKET_UNITS))
        if buckets <= fan:
            return Layout(units, buckets, buckets, units)
        ranges = math.isqrt(buckets - 1) + 1
        # a node hears as many units as there are ranges, so it holds about the facts of one unit
        return Layout(units, ranges * math.ceil(buckets / ranges), ranges, max(1, math.ceil(units / ranges)))

    @property
    def two_hops(self) -> bool:
        return self.ranges < self.buckets

    @property
    def messages(self) -> int:
        """Packed arrays that travel to the buckets, at most (as many come back)."""
        return self.units * self.ranges + (self.groups * self.buckets if self.two_hops else 0)


def dealt(docs: DataFrame, units: int, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), by_text: bool = False, **more: Column) -> DataFrame:
    """(unit, doc_id, text): null ids are ``NO_ID``, null texts empty; one partition holds one or a few units.

    Rows of one id are in one unit, those with a null id anywhere; with ``by_text``
    equal rows are in one unit, whatever the rows of an id hold.  Columns of
    ``carry`` follow as one struct, ``carried``, and those of ``more`` by their names.
    """
    doc_id = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    text = F.coalesce(F.col(text_col), F.lit(""))
    home = F.xxhash64(doc_id, text) if by_text else F.when(F.col(id_col).isNull(), F.xxhash64(doc_id, text)).otherwise(F.xxhash64(doc_id))
    rows = docs.select(
        F.pmod(home, F.lit(units)).cast("int").alias("unit"),
        doc_id.alias("doc_id"),
        text.alias("text"),
        *([F.struct(*carry).alias("carried")] if carry else []),
        *(c.alias(name) for name, c in more.items()),
    )
    return rows.repartition(partitions(units), "unit")


def partitions(units: int) -> int:
    """Partitions that units are dealt to."""
    return math.ceil(units / UNITS_EACH)


_libc = ctypes.CDLL(None)


def release() -> None:
    """Hands freed memory back to the system: a Python worker lives on after its group."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def lean(function, *args):
    """The function's result, with what it used for it released."""
    out = function(*args)
    release()
    return out


def squeeze(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def expand(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), dtype)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the top 32 bits, so that sorted hashes have sorted buckets."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def cuts(sorted_buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each run in a sorted array."""
    if not len(sorted_buckets):
        return []
    at = np.flatnonzero(np.diff(sorted_buckets)) + 1
    start = np.concatenate([[0], at])
    stop = np.concatenate([at, [len(sorted_buckets)]])
    return [(int(sorted_buckets[a]), int(a), int(b)) for a, b in zip(start, stop, strict=True)]


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# ---------------------------------------------------------------- packed facts


def _planes(a: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the second lowest, and so on: like bytes compress together."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(a.size, -1).T.tobytes()


def _unplanes(raw: bytes, at: int, dtype: np.dtype, n: int) -> np.ndarray:
    size = dtype.itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(dtype).reshape(n)


def pack_records(values: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(_planes(values[f]) for f in values.dtype.names), 1)


def unpack_records(raw: bytes, dtype: np.dtype, n: int, at: int = 0) -> np.ndarray:
    out = np.empty(n, dtype)
    for f in dtype.names:
        base, shape = dtype[f].base, dtype[f].shape
        number = n * int(np.prod(shape, dtype=int))
        out[f] = _unplanes(raw, at, base, number).reshape(n, *shape)
        at += number * base.itemsize
    return out


@dataclass
class Facts:
    """Keys in ascending order, a record for each, and a byte string for each where there are any."""

    keys: np.ndarray
    values: np.ndarray
    texts: list[bytes] | None = None

    def part(self, i: int, j: int) -> Facts:
        return Facts(self.keys[i:j], self.values[i:j], None if self.texts is None else self.texts[i:j])

    def pack(self, bits: int) -> bytes:
        keys = self.keys >> np.uint64(64 - bits)
        steps = np.diff(keys, prepend=np.uint64(0))
        parts = [len(keys).to_bytes(8, "little"), _planes(steps.astype("<u8")), *(_planes(self.values[f]) for f in self.values.dtype.names)]
        if self.texts is not None:
            sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts)).astype("<u4")
            parts += [_planes(sizes), *self.texts]
        return zstandard.compress(b"".join(parts), 1)

    @staticmethod
    def unpack(blob: bytes, bits: int, dtype: np.dtype, with_texts: bool) -> Facts:
        raw = zstandard.decompress(blob)
        n = int.from_bytes(raw[:8], "little")
        keys = np.cumsum(_unplanes(raw, 8, np.dtype("<u8"), n), dtype=np.uint64) << np.uint64(64 - bits)
        values = unpack_records(raw, dtype, n, 8 + 8 * n)
        texts = None
        if with_texts:
            at = 8 + (8 + dtype.itemsize) * n
            stop = np.cumsum(_unplanes(raw, at, np.dtype("<u4"), n).astype(np.int64)) + at + 4 * n
            ends = stop.tolist()
            texts = [raw[a:b] for a, b in zip([at + 4 * n, *ends[:-1]], ends, strict=False)]
        return Facts(keys, values, texts)

    @staticmethod
    def joined(parts: list[Facts]) -> Facts:
        texts = None if parts[0].texts is None else [t for p in parts for t in p.texts]
        return Facts(np.concatenate([p.keys for p in parts]), np.concatenate([p.values for p in parts]), texts)


def by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the place of each key among them."""
    return np.unique(keys, return_inverse=True)


@dataclass(frozen=True)
class Talk:
    """What travels, how facts on one thing are merged, and what a bucket answers.

    ``merge`` takes joined facts of several senders and returns the merged ones, in
    order of their keys, and a map from given to merged facts; ``answer`` gives a record
    for each merged fact; ``spread`` turns those into answers to the given facts;
    ``note`` is a byte string that a bucket says to nobody.
    """

    fact: np.dtype
    said: np.dtype
    merge: Callable[[Facts], tuple[Facts, np.ndarray]]
    answer: Callable[[Facts], np.ndarray]
    bits: int = 56
    texts: bool = False
    spread: Callable[[np.ndarray, np.ndarray, Facts, Facts], np.ndarray] = lambda said, which, given, merged: said[which]
    note: Callable[[Facts], bytes] | None = None


SENT = pa.schema([("sender", pa.int32()), ("route", pa.int32()), ("blob", pa.binary())])
SENT_SQL = "sender int, route int, blob binary"


def sent(facts: Facts, sender: int, routes: int, talk: Talk) -> list[tuple[int, int, bytes]]:
    """A message for each route that the facts' keys lead to."""
    return [(sender, r, facts.part(i, j).pack(talk.bits)) for r, i, j in cuts(bucket_of(facts.keys, routes))]


def _heard(rows: pa.Table, talk: Talk) -> tuple[list[int], list[Facts]]:
    blobs = sorted(zip(rows["sender"].to_pylist(), rows["blob"].to_pylist(), strict=True))
    return [u for u, _ in blobs], [Facts.unpack(b, talk.bits, talk.fact, talk.texts) for _, b in blobs]


def _replies(senders: list[int], parts: list[Facts], route: int, answers: np.ndarray) -> list[tuple[int, int, bytes]]:
    out, at = [], 0
    for u, p in zip(senders, parts, strict=True):
        out.append((u, route, pack_records(answers[at : at + len(p.keys)])))
        at += len(p.keys)
    return out


def answer(rows: pa.Table, talk: Talk) -> pa.Table:
    route = rows["route"][0].as_py()
    senders, parts = _heard(rows, talk)
    given = Facts.joined(parts)
    merged, which = talk.merge(given)
    out = _replies(senders, parts, route, talk.spread(talk.answer(merged), which, given, merged))
    if talk.note:
        out.append((-1, route, talk.note(merged)))
    return table(out, SENT)


def _gather(rows: pa.Table, talk: Talk, buckets: int) -> pa.Table:
    merged, _ = talk.merge(Facts.joined(_heard(rows, talk)[1]))
    return table(sent(merged, rows["home"][0].as_py(), buckets, talk), SENT)


def _spread(rows: pa.Table, back: pa.Table, talk: Talk) -> pa.Table:
    if not rows.num_rows:  # notes
        return table(list(zip(back["sender"].to_pylist(), back["bucket"].to_pylist(), back["blob"].to_pylist(), strict=True)), SENT)
    senders, parts = _heard(rows, talk)
    given = Facts.joined(parts)
    merged, which = talk.merge(given)
    said = _told(back, "bucket", talk, len(merged.keys))
    return table(_replies(senders, parts, rows["route"][0].as_py(), talk.spread(said, which, given, merged)), SENT)


def _told(rows: pa.Table, route: str, talk: Talk, n: int | None) -> np.ndarray:
    blobs = sorted(zip(rows[route].to_pylist(), rows["blob"].to_pylist(), strict=True))
    parts = []
    for _, blob in blobs:
        raw = zstandard.decompress(blob)
        parts.append(unpack_records(raw, talk.said, len(raw) // talk.said.itemsize))
    out = np.concatenate(parts) if parts else np.zeros(0, talk.said)
    assert n is None or len(out) == n
    return out


def told(rows: pa.Table, talk: Talk, facts: Facts | None) -> np.ndarray:
    """A unit's answers, in the order of its facts."""
    return _told(rows, "route", talk, None if facts is None else len(facts.keys))


def answered(asked: DataFrame, talk: Talk, layout: Layout) -> DataFrame:
    """(sender, route, blob): answers to messages (sender, route, blob) that went to ``layout.ranges`` routes."""
    if not layout.two_hops:
        return asked.groupBy("route").applyInArrow(lambda t: lean(answer, t, talk), SENT_SQL)
    each = layout.buckets // layout.ranges
    near = asked.withColumn("home", F.pmod("sender", F.lit(layout.groups)))
    merged = near.groupBy("home", "route").applyInArrow(lambda t: lean(_gather, t, talk, layout.buckets), SENT_SQL)
    judged = merged.groupBy("route").applyInArrow(lambda t: lean(answer, t, talk), SENT_SQL)
    back = judged.select("sender", F.col("sender").alias("home"), F.floor(F.col("route") / each).cast("int").alias("route"), F.col("route").alias("bucket"), "blob")
    return near.groupBy("home", "route").cogroup(back.groupBy("home", "route")).applyInArrow(lambda t, b: lean(_spread, t, b, talk), SENT_SQL)


class Unit:
    """The texts of one unit as one byte buffer, ordered by (id, text)."""

    def __init__(self, rows: pa.Table):
        ids, texts = rows["doc_id"].to_pylist(), rows["text"].to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.fromiter((ids[i] for i in self.order), np.int64, len(ids))
        texts = [texts[i].encode("utf-8", "replace") for i in self.order]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.bytes = b"".join(texts)
        self.buf = np.frombuffer(self.bytes, np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
