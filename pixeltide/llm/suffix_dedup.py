"""Exact removal of repeated byte strings, on Burrows-Wheeler transforms of candidate contexts.

Contract: with documents in the order of their ids, a byte goes if a string of
``length`` bytes that covers it also starts in a document of a smaller id.

1. *Candidates.*  In every window of ``length`` bytes the ``GRAM``-gram of the least
   hash is the window's anchor, so equal windows have equal anchors.  Units send
   their distinct anchor hashes, about one per 14 bytes, to hash buckets, and
   learn which occur in several documents.
2. *Holders.*  The windows of such an anchor are one short context (50 to 76 bytes
   for windows of 50).  Units send a 64-bit hash of each of its distinct contexts, with
   the smallest document, to the anchor's bucket.  Contexts are the same if anchor and
   hash are (120 bits).  A context that a smaller document holds as a whole has all of
   its windows from there; one that no other context of its anchor stands beside
   repeats nothing.
3. *Expansion.*  Only the smallest holder of each of several different contexts sends
   its bytes.  A bucket concatenates them, orders their suffixes to the
   depth ``length``, and derives common prefixes from the Burrows-Wheeler
   transform by backward extension of intervals, breadth first: an extension by
   one character that ends at a place without a value sets it to the level, and
   only such intervals are extended again.  The search stops at ``length``;
   places without a value then join suffixes with a common prefix of at least
   ``length``, and the smallest document of such a run decides its windows.
4. *Cutting.*  Units map the answers back to places and cut the texts.

*Disk.*  Text that very many documents repeat travels as bytes once, not once for each
unit; a second hop writes hashes and those bytes again, not all of a unit's contexts.
With grams of 24 bytes the share of anchors in several documents hardly grows with the
input, as it does with those of 16, which different texts have by chance.  Each pass
deals the texts anew, after the files of the pass before have gone.

*Skew.*  An anchor that very many documents hold has as many different contexts at
the edges of the passage.  Anchors are salted: one that has more than ``PER_SALT``
different contexts has as many salts as there are different strings around it.  Its
contexts are split into runs of at most ``STEP`` windows, by the windows' distance to
the anchor, and a run's salt is the hash of the ``length - STEP + 1`` bytes that all
windows of such distances hold there.  Equal windows have equal distances and bytes, so
equal salts; contexts of a salt differ in 2 * (``STEP`` - 1) bytes only, and are expanded
like any others.  All stages are deterministic functions of their inputs, so lost
executors are made good by recomputation.

Defined results: a null text is empty, and texts shorter than ``length`` lose
nothing; rows that share an id, repeated rows too, are not "smaller" than each
other, so ties keep all copies; null ids come after all others, as one id; texts of
any length are whole (a long one makes its unit as large as itself); an empty table
gives an empty table.  Other columns are ignored, whatever their names, unless
``carry`` asks for them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from .shared import ensure_checkpoints, free_shuffles
from .shingles import mix

LENGTH = 50
GRAM = 24
#: Different contexts of an anchor without salts, at most.
PER_SALT = 50_000
#: Windows in a run of a salted context, at most.
STEP = 3
#: Positions hashed at a time, and characters of one transform, about.
SLICE, BLOCK = 1 << 18, 1 << 20

_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 20) - 1)


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM``-gram at each place, by doubling a polynomial hash of a third of it."""
    h, n, power = _TABLE[buf], 1, _BASE
    while n < GRAM // 3:
        h = h[:-n] * np.uint64(power) + h[n:]
        n, power = n * 2, power * power % (1 << 64)
    power = np.uint64(power)
    h = (h[: -2 * n] * power + h[n:-n]) * power + h[2 * n :]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def contexts(unit: X.Unit, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor hash and anchor's place of each context, in order of place.

    Every window of ``length`` bytes inside a document is in exactly one context.
    """
    total, parts = len(unit.buf), []
    width = length - GRAM + 1
    inside = np.zeros(total + 1, np.int8)
    long = unit.ends - unit.starts >= length
    np.add.at(inside, unit.starts[long], 1)
    np.add.at(inside, unit.ends[long] - length + 1, -1)
    inside = np.cumsum(inside, dtype=np.int8) > 0
    for at in range(0, total - length + 1, SLICE):
        part = unit.buf[at : at + SLICE + length - 1]
        h = _gram_hashes(part)
        keyed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        least = _sliding_min(keyed, width)
        ok = inside[at : at + len(least)]
        change = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])]))
        stop = np.concatenate([change[1:], [len(least)]])
        keep = ok[change]
        change, stop = change[keep], stop[keep]
        gram = (least[change] & _PLACE).astype(np.int64)
        parts.append((change + at, stop - change, h[gram], gram + at))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first, number, anchor, gram = (np.concatenate(c) for c in zip(*parts, strict=True))
    anchor = mix(anchor, 9)  # anchors are least hashes; buckets go by the top bits
    # two documents may meet between equal keys: cut there
    doc = np.searchsorted(unit.ends, first, side="right")
    over = first + number - 1 + length > unit.ends[doc]
    assert not over.any()
    return first.astype(np.int64), number.astype(np.int64), anchor, gram


def _shared(facts: X.Facts) -> tuple[X.Facts, np.ndarray]:
    keys, which = X.by_key(facts.keys)
    values = np.zeros(len(keys), _SEVERAL)
    values["several"] = (np.bincount(which, minlength=len(keys)) > 1) | (np.bincount(which, facts.values["several"], len(keys)) > 0)
    return X.Facts(keys, values), which


_SEVERAL = np.dtype([("several", "u1")])
#: Whether several documents hold an anchor; one that another's hash resembles in 48 bits is only looked at in vain.
_ANCHORS = X.Talk(_SEVERAL, _SEVERAL, _shared, lambda facts: facts.values, bits=48)


class _Anchors:
    """A unit's contexts (first window, number of windows, anchor, its place, and document), and the facts of its anchors."""

    def __init__(self, rows: pa.Table, length: int):
        self.unit = unit = X.Unit(rows)
        self.first, self.number, self.anchor, self.gram = contexts(unit, length)
        self.doc = np.searchsorted(unit.ends, self.first, side="right")
        keys, lead, self.inverse = np.unique(self.anchor, return_index=True, return_inverse=True)
        several = np.zeros(len(keys), _SEVERAL)
        several["several"][self.inverse[self.doc != self.doc[lead][self.inverse]]] = 1
        self.facts = X.Facts(keys, several)


def _ask_anchors(rows: pa.Table, length: int, routes: int) -> pa.Table:
    return X.table(X.sent(_Anchors(rows, length).facts, rows["unit"][0].as_py(), routes, _ANCHORS), X.SENT)


_HELD, _SALTS = np.dtype([("context", "<u8"), ("id", "<i8")]), np.dtype([("salts", "<u4")])
#: Instead of a number of salts: a smaller document holds the whole context.
_LATER = np.uint32(0xFFFFFFFF)


def _smallest_holders(facts: X.Facts) -> tuple[X.Facts, np.ndarray]:
    """Distinct contexts of each anchor with their smallest documents."""
    v, keys = facts.values, facts.keys
    order = np.lexsort((v["id"], v["context"], keys))
    by, text = keys[order], v["context"][order]
    fresh = np.concatenate([[True], (by[1:] != by[:-1]) | (text[1:] != text[:-1])]) if len(order) else np.zeros(0, bool)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(fresh) - 1
    lead = order[fresh]
    return X.Facts(keys[lead], v[lead]), which


def _whole(said: np.ndarray, which: np.ndarray, given: X.Facts, merged: X.Facts) -> np.ndarray:
    salts = np.where(given.values["id"] > merged.values["id"][which], _LATER, said["salts"][which])
    return salts.astype("<u4").view(_SALTS)


def _holder_talk(per_salt: int) -> X.Talk:
    """Number of salts of each context's anchor, 0 if it has no other context; ``_LATER`` where a smaller document holds the context."""

    def salts(facts: X.Facts) -> np.ndarray:
        _, which, n = np.unique(facts.keys, return_inverse=True, return_counts=True)
        return np.where(n > 1, -(-n // per_salt), 0)[which].astype("<u4").view(_SALTS)

    return X.Talk(_HELD, _SALTS, _smallest_holders, salts, spread=_whole)


def _context_hashes(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the ``size`` bytes at each place."""
    n = len(buf)
    power, back = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[buf] * power[:n])])
    return mix((total[first + size] - total[first]) * back[first] + mix(size.astype(np.uint64), 24), 25)


class _Holders(_Anchors):
    """A unit's contexts of shared anchors: those that are the same are one entry, which its smallest document leads."""

    def __init__(self, rows: pa.Table, said: pa.Table, length: int):
        super().__init__(rows, length)
        shared = np.flatnonzero(X.told(said, _ANCHORS, self.facts)["several"][self.inverse])
        self.first, self.number, self.anchor, self.gram, self.doc = (x[shared] for x in (self.first, self.number, self.anchor, self.gram, self.doc))
        values = np.zeros(len(shared), _HELD)
        values["context"] = _context_hashes(self.unit.buf, self.first, self.number - 1 + length)
        values["id"] = self.unit.ids[self.doc]
        self.entries, self.entry = _smallest_holders(X.Facts(self.anchor, values))
        self.lead = np.full(len(self.entries.keys), len(self.entry), np.int64)
        np.minimum.at(self.lead, self.entry, np.arange(len(self.entry)))  # places are in order of documents


def _ask_holders(rows: pa.Table, said: pa.Table, length: int, routes: int, per_salt: int) -> pa.Table:
    if not rows.num_rows:
        return X.table([], X.SENT)
    return X.table(X.sent(_Holders(rows, said, length).entries, rows["unit"][0].as_py(), routes, _holder_talk(per_salt)), X.SENT)


class _Texts(_Holders):
    """The bytes that a unit sends: of entries that it leads among different ones, or of the runs of salted ones."""

    def __init__(self, rows: pa.Table, said: pa.Table, length: int, per_salt: int):
        super().__init__(rows, said.filter(pc.equal(said["kind"], 0)), length)
        self.salts = salts = X.told(said.filter(pc.equal(said["kind"], 1)), _holder_talk(per_salt), self.entries)["salts"]
        first, number = self.first[self.lead], self.number[self.lead]
        plain, salted = np.flatnonzero(salts == 1), np.flatnonzero((salts > 1) & (salts != _LATER))
        gram = self.gram[self.lead][salted]
        far = gram - first[salted]  # distances of the first window and the last one to the anchor
        near = far - number[salted] + 1
        each = far // STEP - near // STEP + 1
        step = STEP * (np.repeat(near // STEP, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))
        far, near, gram = (np.repeat(x, each) for x in (far, near, gram))
        #: First window of each run in its entry, and number of windows.
        self.window = far - np.minimum(far, step + STEP - 1)
        self.windows = far - self.window - np.maximum(near, step) + 1
        own = _window_hashes(self.unit.buf, gram - step, length - STEP + 1)
        #: Entry of each text, those of whole entries first.
        self.of = np.concatenate([plain, np.repeat(salted, each)])
        self.plain = len(plain)
        start = first[self.of]
        start[self.plain :] += self.window
        size = np.concatenate([number[plain], self.windows]) + length - 1
        group = np.concatenate([self.entries.keys[plain], mix(np.repeat(self.entries.keys[salted], each) ^ mix(own, 22), 23)])
        order = np.argsort(group, kind="stable")
        text = self.unit.bytes
        texts = [text[a:b] for a, b in zip(start[order].tolist(), (start + size)[order].tolist(), strict=True)]
        ids = self.entries.values["id"][self.of[order]].astype("<i8").view(_SMALLEST)
        self.facts, which = _distinct(X.Facts(group[order], ids, texts))
        self.sent = np.empty(len(order), np.int64)
        self.sent[order] = which

    def seen(self, said: np.ndarray) -> np.ndarray:
        """Bits of each entry's windows that start in a smaller document too."""
        bits = np.where(self.salts == _LATER, _EVERY, np.uint64(0))
        told = _later(said, self.sent, X.Facts(self.facts.keys, self.entries.values[["id"]][self.of]), self.facts)["bits"]
        bits[self.of[: self.plain]] = told[: self.plain]
        every = (np.uint64(1) << self.windows.astype(np.uint64)) - np.uint64(1)
        np.bitwise_or.at(bits, self.of[self.plain :], (told[self.plain :] & every) << self.window.astype(np.uint64))
        return bits


def _window_hashes(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes at each place."""
    out = np.zeros(len(at), np.uint64)
    for k in range(length):
        out = out * np.uint64(_BASE) + _TABLE[buf[at + k]]
    return out


_SMALLEST, _BITS = np.dtype([("id", "<i8")]), np.dtype([("bits", "<u8")])
_EVERY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _distinct(facts: X.Facts) -> tuple[X.Facts, np.ndarray]:
    """Distinct contexts with their smallest documents."""
    held: dict[bytes, int] = {}
    entry = np.fromiter((held.setdefault(t, len(held)) for t in facts.texts), np.int64, len(facts.texts))
    _, lead = np.unique(entry, return_index=True)
    least = np.full(len(held), X.NO_ID, np.int64)
    np.minimum.at(least, entry, facts.values["id"])
    order = np.argsort(facts.keys[lead], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    texts = list(held)
    return X.Facts(facts.keys[lead][order], least[order].astype("<i8").view(_SMALLEST), [texts[k] for k in order.tolist()]), place[entry]


def _later(said: np.ndarray, which: np.ndarray, given: X.Facts, merged: X.Facts) -> np.ndarray:
    """A context that a smaller document holds as a whole has all of its windows from there."""
    bits = np.where(given.values["id"] > merged.values["id"][which], _EVERY, said["bits"][which])
    return bits.astype("<u8").view(_BITS)


def _context_talk(length: int) -> X.Talk:
    return X.Talk(_SMALLEST, _BITS, _distinct, lambda facts: _judge(facts, length), texts=True, spread=_later)


def _ask_contexts(rows: pa.Table, said: pa.Table, length: int, routes: int, per_salt: int) -> pa.Table:
    if not rows.num_rows:
        return X.table([], X.SENT)
    return X.table(X.sent(_Texts(rows, said, length, per_salt).facts, rows["unit"][0].as_py(), routes, _context_talk(length)), X.SENT)


def order_to_depth(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of a circular text, ordered by the ``depth`` characters that start there (depth 16 or more)."""
    n = len(text)
    ring = np.concatenate([text, text[np.arange(8) % n]]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | ring[i : i + n]
    have, order = 8, None
    while True:
        order = np.argsort(key)
        held = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], held[1:] != held[:-1]])).astype(np.uint64)
        if have >= depth:
            return order
        step = min(have, depth - have)
        key = (rank << np.uint64(32)) | np.roll(rank, -(step % n))
        have += step


def bounded_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """True at each place of the order whose common prefix with the place before is shorter than ``depth``.

    Breadth-first backward extension of intervals on the transform, level by
    level; values are found in increasing order, and the search ends at ``depth``.
    """
    n = len(text)
    before = text[order - 1]
    last = np.empty(n, np.int64)
    by_char = np.argsort(before, kind="stable")
    last[by_char] = np.arange(n)  # the place that an extension by its character leads to
    front = text[order]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n - 1])
    owner = np.empty(n, np.int32)
    marked = np.zeros(n, bool)
    for _ in range(depth):
        if not len(low):
            break
        size = high - low + 1
        total = int(size.sum())
        place = np.arange(total) + np.repeat(low - (np.cumsum(size) - size), size)
        to = last[place]
        owner[to] = np.repeat(np.arange(len(low), dtype=np.int32), size)
        if total * 16 > n:
            marked[to] = True
            to = np.flatnonzero(marked)
            marked[to] = False
        else:
            to = np.sort(to)
        own, char = owner[to], front[to]
        cut = np.concatenate(
            [[True], (to[1:] != to[:-1] + 1) | (own[1:] != own[:-1]) | (char[1:] != char[:-1])]
        )
        start = np.flatnonzero(cut)
        lows, highs = to[start], to[np.concatenate([start[1:], [len(to)]]) - 1]
        new = ~known[highs + 1]
        low, high = lows[new], highs[new]
        known[high + 1] = True
    return known[:n]


def _windows_seen_before(texts: list[bytes], docs: np.ndarray, length: int) -> list[int]:
    """Per context, the bits of its windows that also start in a document smaller than its own smallest."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    start = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(len(text)) - np.repeat(start, sizes)
    valid = offset < np.repeat(sizes - length, sizes)
    order = order_to_depth(text, length)
    runs = np.flatnonzero(bounded_prefixes(text, order, length))
    doc = np.where(valid, docs[of], X.NO_ID)[order]
    least = np.repeat(np.minimum.reduceat(doc, runs), np.diff(np.concatenate([runs, [len(text)]])))
    seen = np.zeros(len(text), bool)
    seen[order] = least < docs[of[order]]
    seen &= valid
    bits = np.zeros(len(texts), np.uint64)
    at = np.flatnonzero(seen)
    np.bitwise_or.at(bits, of[at], np.uint64(1) << offset[at].astype(np.uint64))
    return bits.tolist()


def _judge(facts: X.Facts, length: int) -> np.ndarray:
    """Windows of each distinct context that also start in a document smaller than its own smallest."""
    bits = np.zeros(len(facts.keys), np.uint64)
    block: list[int] = []
    held = 0

    def solve() -> None:
        if block:
            bits[block] = _windows_seen_before([facts.texts[k] for k in block], facts.values["id"][block], length)

    # contexts that are alone in their group have no string in common with another
    _, index, count = np.unique(facts.keys, return_index=True, return_counts=True)
    for i, c in zip(index.tolist(), count.tolist(), strict=True):
        if c > 1:
            size = sum(len(t) for t in facts.texts[i : i + c])
            if block and held + size > BLOCK:
                solve()
                block, held = [], 0
            block += range(i, i + c)
            held += size
    solve()
    return bits.astype("<u8").view(_BITS)


_CUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
        ("kept", pa.binary()),
    ]
)
_CUT_SQL = "doc_id long, n_bytes long, spans array<struct<from:long,to:long>>, kept binary"


def _cut(rows: pa.Table, said: pa.Table, length: int, per_salt: int) -> pa.Table:
    if not rows.num_rows:
        out = _CUT.empty_table()
        return out.append_column("carried", rows["carried"].combine_chunks()) if "carried" in rows.column_names else out
    own = _Texts(rows, said, length, per_salt)
    unit = own.unit
    bits = own.seen(X.told(said.filter(pc.equal(said["kind"], 2)), _context_talk(length), own.facts))
    mine = np.where(unit.ids[own.doc] > own.entries.values["id"][own.entry], _EVERY, bits[own.entry])
    change = np.zeros(len(unit.buf) + 1, np.int8)  # at most ``length`` windows cover a byte
    for w in range(int(own.number.max(initial=0))):
        hit = (own.number > w) & ((mine >> np.uint64(w)) & np.uint64(1)).astype(bool)
        at = own.first[hit] + w
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
    gone = np.cumsum(change[:-1], dtype=np.int8) > 0
    spans, kept = [], []
    for a, b in zip(unit.starts.tolist(), unit.ends.tolist(), strict=True):
        part = gone[a:b]
        if not part.any():
            spans.append([])
            kept.append(unit.bytes[a:b])
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).astype(np.int8))).reshape(-1, 2)
        spans.append([{"from": int(x), "to": int(y)} for x, y in edge])
        kept.append(unit.buf[a:b][~part].tobytes())
    ids = [None if i == X.NO_ID else i for i in unit.ids.tolist()]
    sizes = (unit.ends - unit.starts).tolist()
    out = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((ids, sizes, spans, kept), _CUT, strict=True)], schema=_CUT)
    return out.append_column("carried", rows["carried"].take(unit.order)) if "carried" in rows.column_names else out


def dedup(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", per_salt: int = PER_SALT,
    unit_bytes: int = X.UNIT_BYTES, carry: tuple[str, ...] = (), fan: int = X.FAN,
) -> DataFrame:
    """Per row: doc_id, n_bytes, ``spans`` (removed byte ranges), ``kept`` (the bytes that remain).

    Columns of ``carry`` come back as the fields of one more column, ``carried``.
    """
    if not 32 <= length <= 79:
        raise ValueError("length must be from 32 to 79 bytes")
    ensure_checkpoints(docs)
    to = X.Layout.of(X.text_bytes(docs, F.col(text_col)), unit_bytes, fan)
    texts = X.dealt(docs, to.units, id_col, text_col, carry, by_text=True)
    out_schema = T.StructType.fromDDL(_CUT_SQL)
    if carry:
        out_schema.add(texts.schema["carried"])
    units = texts.groupBy("unit")
    # each pass over the texts deals them anew: the files of a pass that is done go before the next one
    asked = units.applyInArrow(lambda t: X.lean(_ask_anchors, t, length, to.ranges), X.SENT_SQL)
    said = X.answered(asked, _ANCHORS, to).checkpoint()
    free_shuffles(docs.sparkSession)
    held = (
        units.cogroup(said.groupBy("sender"))
        .applyInArrow(lambda t, s: X.lean(_ask_holders, t, s, length, to.ranges, per_salt), X.SENT_SQL)
    )
    holders = X.answered(held, _holder_talk(per_salt), to).checkpoint()
    free_shuffles(docs.sparkSession)
    both = said.withColumn("kind", F.lit(0)).unionByName(holders.withColumn("kind", F.lit(1)))
    shown = (
        units.cogroup(both.groupBy("sender"))
        .applyInArrow(lambda t, s: X.lean(_ask_contexts, t, s, length, to.ranges, per_salt), X.SENT_SQL)
    )
    judged = X.answered(shown, _context_talk(length), to)
    every = both.unionByName(judged.withColumn("kind", F.lit(2)))
    return (
        units.cogroup(every.groupBy("sender"))
        .applyInArrow(lambda t, s: X.lean(_cut, t, s, length, per_salt), out_schema)
    )
