"""N-gram Jaccard join on parity sketches.

Two documents link when their sets of word shingles have a Jaccard similarity of
at least ``percent`` hundredths.  The result has one row per document with its
connected component, so links are searched only as far as they can still join
two components, but none between different texts is lost.

*Sketch.*  A set's shingles fall into ``m`` blocks of its size band; in a block
each shingle flips one bit, so a block is a parity sketch, kept as the XOR of the
random words of its set bits.  Two sets that differ in ``d`` shingles differ in at
most ``d`` blocks.  At the wanted similarity a set of ``n`` shingles differs from a
partner in at most ``bound(n)``, so they agree in at least
``nonempty blocks - bound(n)`` nonempty blocks (pigeonhole).  Sets for which that
is no positive number also make sketches under further seeds, until one is found
that works for them; a pair is met under the first seed that works for either.
Sets for which no seed works (similarities of about a half or less, where sets may
differ in as many shingles as they have) meet by their single shingles, of which
partners share at least ``percent`` hundredths.

*Pruning without loss.*  A set that shares fewer blocks with others than that
number has no partner.  The others join on their rarest blocks only, as many as
must contain a common one.

*Skew.*  Equal sets are one class before anything is joined.  The members of a
block are neither paired nor gathered: units merge what they say of a block, and
buckets answer with one member.  Each set is verified against one centre, the first
set of most of its blocks, and in some more rounds against one random member
of another component.  Pairs that such links do not connect are then compared
within blocks, less those that the triangle inequality of the Jaccard distance
over a common centre excludes: the Hamming distance of their sketches, of four
bits or more per shingle, bounds the difference of the sets from below, and only
pairs that it allows leave the block for exact verification.  For that step a block
of h sets is cut into ceil(h / ``TILE``) parts, and each pair of parts is a tile of
its own, so no task compares more than a tile at a time.

Defined results: a null or empty text has no shingle and stays alone; a text
with fewer words than a shingle has one shingle, its whole sequence; rows that
share an id are one document each for links and one node of the components, whatever
their texts, and give a row each; a row with a null id is a document of its own,
its id comes back null, and so does its component where no id is in it; texts of any
length are whole; an empty table gives an empty table.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .components import connected, few
from .shared import ensure_checkpoints
from .shingles import mix, sets, shingles, words

WORDS, PERCENT = 5, 75
#: Nonempty blocks for each shingle in which sets may differ, about.
MARGIN = 1.1435
#: Seeds before sets meet by their single shingles.
SEEDS = 8
EMPTY = np.uint64(0)
#: Rounds in which sets are verified against one more member of their blocks before pairs are formed.
ROUNDS = 1
#: Salt of the round that finds centres; later rounds count on from it.
CENTRE = 20
#: Contested documents for each bucket of the last step, and members of a part of a block there.
PER_BUCKET, TILE = 1000, 2000


def density(percent: int) -> float:
    """Blocks per shingle of a band's largest set: as many as leave ``MARGIN`` times the bound nonempty."""
    want = min(MARGIN * (100 - percent) / percent, 0.95)
    low, high = 1e-3, 16.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mid * (1 - math.exp(-1 / mid)) < want else (low, mid)
    return high


def bands(percent: int, largest: int) -> np.ndarray:
    """First size of each band; a set's partners are in its own band or beside it."""
    sizes = [1]
    while sizes[-1] <= largest + 1:
        sizes.append(max(sizes[-1] + 1, -(-sizes[-1] * 100 // percent)))
    return np.array(sizes + [max(sizes[-1] + 1, -(-sizes[-1] * 100 // percent))])


def bound(a, c, percent: int):
    """Shingles in which sets of sizes a and c may differ at most: |A| + |C| - 2 |A and C|."""
    return (np.asarray(a) + c) * (100 - percent) // (100 + percent)


def sketch_keys(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, percent: int):
    """Block keys of the sets ``hashes[starts[i] : starts[i] + sizes[i]]`` (sorted hashes).

    Returns key, set index, group (a number for each set, band pair and seed) and,
    by group, the set and the least number of keys shared with any partner.
    """
    out_key, out_group, group_set, group_least = [], [], [], []
    edges = bands(percent, int(sizes.max(initial=1)))
    band = np.searchsorted(edges, sizes, side="right") - 1
    each = density(percent)
    n_groups = 0
    for upper in (0, 1):  # as the lower band of (b, b+1), then as the upper band of (b-1, b)
        todo = np.flatnonzero((sizes > 0) & (band >= upper))
        seed = 0
        while len(todo):  # each further seed works for most of the sets that are left
            low = band[todo] - upper
            top = edges[low + 1] - 1  # the largest set of the lower band
            n = sizes[todo]
            most = np.minimum(n * 100 // percent, edges[low + 2] - 1) if not upper else np.minimum(n, top)
            apart = bound(n, most, percent)
            if seed < SEEDS:
                blocks = np.ceil(each * top).astype(np.int64) + 1
            total = int(n.sum())
            inner = np.cumsum(n) - n
            h = hashes[np.arange(total) + np.repeat(starts[todo] - inner, n)]
            place = np.repeat(np.arange(len(todo)), n)
            if seed < SEEDS:
                if seed:
                    h = mix(h, seed)
                block = ((h >> np.uint64(32)) * np.repeat(blocks, n).astype(np.uint64)) >> np.uint64(32)
                if seed:  # under seed 0 sorted hashes have sorted blocks
                    order = np.lexsort((block, place))
                    h, block, place = h[order], block[order], place[order]
                cut = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (place[1:] != place[:-1])]))
                bit = mix(h & np.uint64(0xFFFFFF), 3)  # the random word of the bit that a shingle flips
                parity = np.bitwise_xor.reduceat(bit, cut)
                filled = parity != EMPTY
                cut, parity = cut[filled], parity[filled]
                of = place[cut]
                what = block[cut]
                least = np.bincount(of, minlength=len(todo)) - apart
            else:
                of, parity, what = place, mix(h, 5), np.zeros(total, np.uint64)
                least = -(-n * percent // 100)
            key = mix(parity ^ mix((what << np.uint64(24)) | (low[of].astype(np.uint64) << np.uint64(8)) | np.uint64(seed), 4))
            out_key.append(key)
            out_group.append(of + n_groups)
            group_set.append(todo)
            group_least.append(np.maximum(least, 1))
            n_groups += len(todo)
            # a seed can only work where a set has more shingles than it may differ in
            todo = todo[least < 1]
            seed = seed + 1 if (n > apart).any() else max(seed + 1, SEEDS)
    if not out_key:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    return (np.concatenate(x) for x in (out_key, out_group, group_set, group_least))


class _Sets:
    """The distinct shingle sets of one unit, and their sketches' keys."""

    def __init__(self, rows: pa.Table, size: int, percent: int):
        self.unit = unit = X.Unit(rows)
        _, _, word, doc = words(unit)
        h, d = sets(*shingles(word, doc, size))
        n_docs = len(unit.ids)
        self.sizes = np.bincount(d, minlength=n_docs).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hashes = h
        full = np.flatnonzero(self.sizes)
        self.name = np.zeros((n_docs, 2), np.uint64)
        if len(full):
            self.name[full, 0] = np.bitwise_xor.reduceat(mix(h, 5), self.starts[full]) ^ mix(self.sizes[full].astype(np.uint64), 6)
            self.name[full, 1] = np.add.reduceat(mix(h, 7), self.starts[full])
        # documents are ordered by id: the first of equal names has the smallest
        keys = self.name[:, 0] ^ mix(self.name[:, 1], 8)
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        self.lead = first[inverse]
        self.own = full[self.lead[full] == full]
        self.names = keys
        self.set_keys = keys[self.own]

    def sketches(self, percent: int, keep: np.ndarray | None = None):
        own = self.own if keep is None else self.own[keep]
        key, group, of, least = sketch_keys(self.hashes, self.starts[own], self.sizes[own], percent)
        return key, group, own[of] if len(of) else of, least


#: What units say: sets that hold a key; or, of a set's name (its other bits are ``rest``), their own number and its smallest document.
_ASKED, _SAID = np.dtype([("n", "<u4"), ("unit", "<u4"), ("rest", "<u2"), ("id", "<i8")]), np.dtype([("n", "<u4"), ("unit", "<u4"), ("id", "<i8")])


def _count(facts: X.Facts) -> tuple[X.Facts, np.ndarray]:
    keys, which = X.by_key(facts.keys | facts.values["rest"])
    out = np.zeros(len(keys), _ASKED)
    out["n"] = np.minimum(np.bincount(which, facts.values["n"], len(keys)), 2**32 - 1)
    unit = np.full(len(keys), 2**32 - 1, np.uint32)
    np.minimum.at(unit, which, facts.values["unit"])
    least = np.full(len(keys), X.NO_ID, np.int64)
    np.minimum.at(least, which, facts.values["id"])
    out["unit"], out["rest"], out["id"] = unit, (keys & np.uint64(0xFFFF)).astype(np.uint16), least
    return X.Facts(keys, out), which


def _held(facts: X.Facts) -> np.ndarray:
    out = np.empty(len(facts.keys), _SAID)
    for name in _SAID.names:
        out[name] = facts.values[name]
    return out


_BLOCKS = X.Talk(_ASKED, _SAID, _count, _held, bits=48)


def _first_facts(own: _Sets, number: int, keys: np.ndarray) -> tuple[X.Facts, np.ndarray, np.ndarray]:
    """Facts of a unit's block keys and set names, and the places of both in them."""
    high = np.uint64(0xFFFFFFFFFFFF0000)
    block, of, count = np.unique(keys & high, return_inverse=True, return_counts=True)
    order = np.argsort(own.set_keys)
    names = own.set_keys[order]
    at = np.searchsorted(block, names & high)  # names stand between the block keys
    shift = np.cumsum(np.bincount(at, minlength=len(block) + 1))[: len(block)]
    at_block, at_name = np.arange(len(block)) + shift, np.empty(len(names), np.int64)
    at_name[order] = at + np.arange(len(names))
    every, values = np.empty(len(block) + len(names), np.uint64), np.zeros(len(block) + len(names), _ASKED)
    every[at_block], every[at_name] = block, own.set_keys & high
    values["n"][at_block], values["unit"][at_block] = count, 2**32 - 1
    values["unit"][at_name], values["rest"][at_name] = number, (own.set_keys & np.uint64(0xFFFF)).astype(np.uint16)
    values["id"] = X.NO_ID
    values["id"][at_name] = own.unit.ids[own.own]
    return X.Facts(every, values), at_block[of], at_name


def _ask(rows: pa.Table, size: int, percent: int, routes: int) -> pa.Table:
    own, number = _Sets(rows, size, percent), rows["unit"][0].as_py()
    key, *_ = own.sketches(percent)
    facts, *_ = _first_facts(own, number, key)
    return X.table(X.sent(facts, number, routes, _BLOCKS), X.SENT)


_BASE = pa.schema(
    [("kind", pa.int32()), ("unit", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("name", pa.int64()), ("blob", pa.binary()), ("hashes", pa.list_(pa.int64()))]
)
_BASE_SQL = "kind int, unit int, doc_id long, n long, name long, blob binary, hashes array<long>"
#: kinds of the base rows: every document, a candidate's set, a unit's candidate keys, two sets of one id
_DOC, _SET, _KEYS, _SAME = 0, 1, 2, 3


def _candidates(rows: pa.Table, said: pa.Table, size: int, percent: int) -> pa.Table:
    if not rows.num_rows:
        return _BASE.empty_table()
    own, number = _Sets(rows, size, percent), rows["unit"][0].as_py()
    ids = own.unit.ids
    key, group, group_set, least = own.sketches(percent)
    facts, at_key, at_name = _first_facts(own, number, key)
    answers = X.told(said, _BLOCKS, facts)
    names = own.names.view(np.int64)
    full = own.sizes > 0
    out = [
        (_DOC, number, None if i == X.NO_ID else i, n, a if n else None, None, None)
        for i, n, a in zip(ids.tolist(), own.sizes.tolist(), names.tolist(), strict=True)
    ]
    # documents are ordered by id: different sets of one id are neighbours, but for empty ones
    some = np.flatnonzero(full & (ids != X.NO_ID))
    same = np.flatnonzero((ids[some][1:] == ids[some][:-1]) & (names[some][1:] != names[some][:-1]))
    out += [(_SAME, number, a, None, b, None, None) for a, b in zip(names[some][same].tolist(), names[some][same + 1].tolist(), strict=True)]
    if len(key):
        held = answers["n"][at_key].astype(np.int64)
        # one unit alone stands for equal sets of all units
        leads = np.zeros(len(ids), bool)
        leads[own.own] = answers["unit"][at_name] == number
        smallest = np.zeros(len(ids), np.int64)
        smallest[own.own] = answers["id"][at_name]
        n_groups = len(group_set)
        shared = np.bincount(group, weights=held > 1, minlength=n_groups)
        alive = ((shared >= least) & leads[group_set])[group]
        key, group, held = key[alive], group[alive], held[alive]
        number_of = np.bincount(group, minlength=n_groups)
        order = np.lexsort((key, held, group))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(number_of) - number_of, number_of)
        g = group[order]
        take = (rank <= number_of[g] - least[g]) & (held[order] > 1)
        key, doc = key[order][take], group_set[g[take]]
        if len(key):
            who = np.unique(doc)
            local = np.searchsorted(who, doc)
            by = np.argsort(key, kind="stable")
            blob = _packed(names[who], own.sizes[who], smallest[who], key[by], local[by])
            out.append((_KEYS, number, None, None, None, blob, None))
            for w in who.tolist():
                a = own.starts[w]
                out.append((_SET, number, None, int(own.sizes[w]), int(names[w]), None, own.hashes[a : a + own.sizes[w]].view(np.int64)))
    return X.table(out, _BASE)


_WHO, _KEY = np.dtype([("name", "<i8"), ("n", "<i8"), ("first", "<i8")]), np.dtype([("key", "<u8"), ("local", "<u4")])


def _packed(names: np.ndarray, sizes: np.ndarray, first: np.ndarray, key: np.ndarray, local: np.ndarray) -> bytes:
    who, keys = np.empty(len(names), _WHO), np.empty(len(key), _KEY)
    who["name"], who["n"], who["first"] = names, sizes, first
    keys["key"], keys["local"] = key, local
    head = np.array([len(who), len(keys)], "<i8").tobytes()
    return X.squeeze(np.frombuffer(head + who.tobytes() + keys.tobytes(), np.uint8))


class _Members:
    """A unit's candidate sets and their keys, in order of the keys; and what is known of the sets so far."""

    def __init__(self, blob: bytes, known: pa.Table | None = None):
        raw = X.expand(blob, np.uint8).tobytes()
        n_who, n_keys = np.frombuffer(raw, "<i8", 2).tolist()
        who = np.frombuffer(raw, _WHO, n_who, 16)
        keys = np.frombuffer(raw, _KEY, n_keys, 16 + n_who * _WHO.itemsize)
        self.name, self.n, self.first = who["name"], who["n"], who["first"]
        self.key, self.local = keys["key"], keys["local"].astype(np.int64)
        self.label, self.centre, self.far = np.zeros(n_who, np.int64), np.zeros(n_who, np.int64), np.zeros(n_who, np.float32)
        if known is None:
            return
        order = np.argsort(self.name)
        own = np.array(known["d"].to_pylist(), np.int64)
        place = order[np.minimum(np.searchsorted(self.name, own, sorter=order), len(order) - 1)]
        here = self.name[place] == own  # sets without keys are left out
        place, known = place[here], known.filter(pa.array(here))
        self.chosen = np.zeros(n_who, bool)
        self.chosen[place] = True
        self.label[place] = known["l"].to_pylist()
        self.centre[place] = known["centre"].to_pylist()
        self.far[place] = known["far"].to_pylist()
        self.told, self.place = known, place

    def only(self, keep: np.ndarray) -> list[bytes]:
        """The members with these keys only, if there are any."""
        if not keep.any():
            return []
        who, local = np.unique(self.local[keep], return_inverse=True)
        return [_packed(self.name[who], self.n[who], self.first[who], self.key[keep], local)]


#: Of a block: one of its sets, the one that comes first in some order, with what is known of it, and the
#: extreme labels.  Labels are kept as differences, as most are equal, and the centre as a hash.
_HEAD = np.dtype([("first", "<i8"), ("name", "<i8"), ("n", "<u4"), ("label", "<i8"), ("centre", "<u4"), ("far", "<f4"), ("low", "<i8"), ("high", "<i8"), ("several", "u1")])
_TOLD = np.dtype([("name", "<i8"), ("n", "<u4"), ("label", "<i8"), ("centre", "<u4"), ("far", "<f4"), ("mixed", "u1"), ("several", "u1")])


def _heads(facts: X.Facts, salt: int) -> tuple[X.Facts, np.ndarray]:
    v = facts.values
    keys, which = X.by_key(facts.keys)
    # the set of the smallest document is most like the copies made of it; later rounds take any other
    turn = mix(v["name"].astype(np.uint64), salt)
    order = np.lexsort((turn, v["first"], which) if salt == CENTRE else (turn, which))
    lead = order[np.flatnonzero(np.concatenate([[True], which[order][1:] != which[order][:-1]]))] if len(order) else order
    out = v[lead].copy()
    label = v["label"] ^ v["name"]
    for name, least in (("low", np.minimum), ("high", np.maximum)):
        given = v[name] ^ label
        held = given[lead].copy()
        least.at(held, which, given)
        out[name] = held ^ label[lead]
    out["several"] = (np.bincount(which, v["several"], len(keys)) > 0) | (np.bincount(which, minlength=len(keys)) > 1)
    return X.Facts(keys, out), which


def _say(facts: X.Facts) -> np.ndarray:
    out = np.empty(len(facts.keys), _TOLD)
    for name in ("name", "n", "label", "centre", "far", "several"):
        out[name] = facts.values[name]
    out["mixed"] = facts.values["low"] != facts.values["high"]
    return out


def _centres(salt: int) -> X.Talk:
    return X.Talk(_HEAD, _TOLD, lambda facts: _heads(facts, salt), _say)


def _hashed(centre: np.ndarray) -> np.ndarray:
    return (mix(centre.view(np.uint64), 34) >> np.uint64(32)).astype(np.uint32)


def _block_facts(m: _Members, salt: int) -> tuple[X.Facts, np.ndarray]:
    """For each key of a unit its first set in the order of ``salt``, and the place of each member's key."""
    who = np.zeros(len(m.name), _HEAD)
    who["name"], who["n"], who["label"] = m.name, m.n, m.name ^ m.label
    who["centre"], who["far"] = _hashed(m.centre), m.far
    if salt == CENTRE:
        who["first"] = m.first
    return _heads(X.Facts(m.key, who[m.local]), salt)


def _most_common(m: _Members, head: np.ndarray, ok: np.ndarray) -> pa.Table:
    """For each set the head of most of its blocks, of those that may be a partner."""
    pairs, count = np.unique(np.stack([m.name[m.local[ok]], head["name"][ok]], 1), axis=0, return_counts=True)
    order = np.lexsort((pairs[:, 1], -count, pairs[:, 0]))
    pairs = pairs[order]
    first = np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]]) if len(pairs) else np.zeros(0, bool)
    return pa.Table.from_arrays([pa.array(pairs[first, 0], pa.int64()), pa.array(pairs[first, 1], pa.int64())], names=["a", "c"])


def _says(rows: pa.Table, known: pa.Table | None, salt: int, routes: int) -> pa.Table:
    out = []
    for unit, blob in zip(rows["unit"].to_pylist(), rows["blob"].to_pylist(), strict=True):
        facts, _ = _block_facts(_Members(blob, known), salt)
        out += X.sent(facts, unit, routes, _centres(salt))
    return X.table(out, X.SENT)


_PAIRS = pa.schema([("a", pa.int64()), ("c", pa.int64())])
#: Pairs to verify, contested sets, and what is left of a unit's keys.
_OFFERS = pa.schema([("contested", pa.bool_()), ("a", pa.int64()), ("c", pa.int64()), ("unit", pa.int32()), ("blob", pa.binary())])
_OFFERS_SQL = "contested boolean, a long, c long, unit int, blob binary"


def _offers(pairs: pa.Table, contested: np.ndarray, unit: int, blobs: list[bytes]) -> pa.Table:
    n, m, k = pairs.num_rows, len(contested), len(blobs)
    return pa.Table.from_arrays(
        [
            pa.array([False] * n + [True] * m + [None] * k, pa.bool_()),
            pa.array([*pairs["a"].to_pylist(), *contested.tolist(), *[None] * k], pa.int64()),
            pa.array([*pairs["c"].to_pylist(), *[None] * (m + k)], pa.int64()),
            pa.array([None] * (n + m) + [unit] * k, pa.int32()),
            pa.array([None] * (n + m) + blobs, pa.binary()),
        ],
        schema=_OFFERS,
    )


def _vote(rows: pa.Table, said: pa.Table, salt: int) -> pa.Table:
    """Per set the centre that it shares most blocks with; and the keys that several sets have."""
    if not rows.num_rows:
        return _OFFERS.empty_table()
    m = _Members(rows["blob"][0].as_py())
    facts, which = _block_facts(m, salt)
    head = X.told(said, _centres(salt), facts)[which]
    pairs = _most_common(m, head, head["name"] != m.name[m.local])
    return _offers(pairs, np.zeros(0, np.int64), rows["unit"][0].as_py(), m.only(head["several"] > 0))


def _offer(rows: pa.Table, both: pa.Table, salt: int, percent: int) -> pa.Table:
    """Per set one member of its blocks with another label that may be a partner; and the sets and keys of blocks of several labels."""
    if not rows.num_rows:
        return _OFFERS.empty_table()
    known, said = both.filter(pc.is_valid(both["d"])), both.filter(pc.is_valid(both["route"]))
    m = _Members(rows["blob"][0].as_py(), known)
    facts, which = _block_facts(m, salt)
    head = X.told(said, _centres(salt), facts)[which]
    n, label = m.n[m.local], m.label[m.local]
    theirs = head["label"] ^ head["name"]
    small, large = np.minimum(n, head["n"].astype(np.int64)), np.maximum(n, head["n"].astype(np.int64))
    limit = np.float32(1 - percent / 100 + 1e-5)
    apart = (head["centre"] == _hashed(m.centre)[m.local]) & (np.abs(m.far[m.local] - head["far"]) > limit)
    pairs = _most_common(m, head, (theirs != label) & (small * 100 >= large * percent) & ~apart)
    mixed = head["mixed"] > 0
    return _offers(pairs, np.unique(m.name[m.local[mixed]]), rows["unit"][0].as_py(), m.only(mixed))


def sketch_bits(n) -> np.ndarray:
    """Bits of the parity sketch of a set of n shingles: a power of two, four times n or more."""
    return 1 << np.ceil(np.log2(np.maximum(np.asarray(n) * 4, 128))).astype(np.int64)


def parity_sketch(hashes: np.ndarray) -> bytes:
    """Each shingle flips one bit."""
    bits = int(sketch_bits(len(hashes)))
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def fold(sketch: bytes, bits: int) -> np.ndarray:
    """The sketch of fewer bits: halves are XORed, which keeps the parities."""
    words64 = np.frombuffer(sketch, "<u8")
    while len(words64) * 64 > bits:
        words64 = words64[: len(words64) // 2] ^ words64[len(words64) // 2 :]
    return words64


_NUMBER = np.dtype([("n", "<u4")])


def _add(facts: X.Facts) -> tuple[X.Facts, np.ndarray]:
    keys, which = X.by_key(facts.keys)
    return X.Facts(keys, np.minimum(np.bincount(which, facts.values["n"], len(keys)), 2**32 - 1).astype("<u4").view(_NUMBER)), which


_SIZES = X.Talk(_NUMBER, _NUMBER, _add, lambda facts: facts.values)


def _member_counts(m: _Members) -> tuple[X.Facts, np.ndarray, np.ndarray]:
    """Chosen members of each of a unit's keys, the members that are chosen, and the place of their keys."""
    take = np.flatnonzero(m.chosen[m.local])
    facts, which = _add(X.Facts(m.key[take], np.ones(len(take), "<u4").view(_NUMBER)))
    return facts, take, which


def _count_members(rows: pa.Table, known: pa.Table, routes: int) -> pa.Table:
    if not rows.num_rows or not known.num_rows:
        return X.SENT.empty_table()
    facts, *_ = _member_counts(_Members(rows["blob"][0].as_py(), known))
    return X.table(X.sent(facts, rows["unit"][0].as_py(), routes, _SIZES), X.SENT)


def tiles(key: np.ndarray, name: np.ndarray, held: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tile, place of the member and side of each member in the tiles that it takes part in.

    A block of h members has ceil(h / tile) parts; a tile is a pair of parts, with the
    members of the first on side 0 and those of the second on side 1, or one part with
    all on side 0.  Any two members of a block meet in exactly one tile.
    """
    parts = -(-held // tile)
    part = (mix(name.view(np.uint64), 31) % parts.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(key)), parts)
    other = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    low, high = np.minimum(part[at], other), np.maximum(part[at], other)
    which = mix(key[at] ^ mix((low.astype(np.uint64) << np.uint64(32)) | high.astype(np.uint64), 32), 33)
    return which, at, (part[at] > other).astype(np.uint8)


#: Per set in a tile.
_FACTS = np.dtype([("name", "<i8"), ("n", "<i8"), ("label", "<i8"), ("centre", "<i8"), ("far", "<f4")])
_TILE = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def _send_tiles(rows: pa.Table, both: pa.Table, buckets: int, tile: int) -> pa.Table:
    if not rows.num_rows:
        return _TILE.empty_table()
    known, said = both.filter(pc.is_valid(both["d"])), both.filter(pc.is_valid(both["route"]))
    if not known.num_rows:
        return _TILE.empty_table()
    m = _Members(rows["blob"][0].as_py(), known)
    facts, take, which = _member_counts(m)
    held = X.told(said, _SIZES, facts)["n"][which].astype(np.int64)
    fact = np.zeros(len(m.name), _FACTS)
    for name in _FACTS.names:
        fact[name] = getattr(m, name)
    sketches = [b""] * len(m.name)
    for place, hashes in zip(m.place.tolist(), m.told["hashes"], strict=True):
        sketches[place] = parity_sketch(hashes.values.to_numpy().view(np.uint64))
    of, at, side = tiles(m.key[take], m.name[m.local[take]], held, tile)
    member = m.local[take][at]
    order = np.argsort(of, kind="stable")
    of, member, side = of[order], member[order], side[order]
    out = []
    for b, i, j in X.cuts(X.bucket_of(of, buckets)):
        who, place = np.unique(member[i:j], return_inverse=True)
        head = np.array([len(who), j - i], "<i8").tobytes()
        raw = head + fact[who].tobytes() + of[i:j].tobytes() + place.astype("<u4").tobytes() + side[i:j].tobytes() + b"".join(sketches[w] for w in who.tolist())
        out.append((b, X.squeeze(np.frombuffer(raw, np.uint8))))
    return X.table(out, _TILE)


def _cross(rows: pa.Table, percent: int) -> pa.Table:
    """Pairs of a tile with different labels whose sketches' Hamming distance allows the similarity."""
    facts, keys, places, sides, sketches, at = [], [], [], [], [], 0
    for blob in rows["blob"].to_pylist():
        raw = X.expand(blob, np.uint8).tobytes()
        n_sets, n_keys = np.frombuffer(raw, "<i8", 2).tolist()
        facts.append(np.frombuffer(raw, _FACTS, n_sets, 16))
        to = 16 + n_sets * _FACTS.itemsize
        keys.append(np.frombuffer(raw, "<u8", n_keys, to))
        places.append(np.frombuffer(raw, "<u4", n_keys, to + 8 * n_keys).astype(np.int64) + at)
        sides.append(np.frombuffer(raw, np.uint8, n_keys, to + 12 * n_keys))
        at, to = at + n_sets, to + 13 * n_keys
        for size in (sketch_bits(facts[-1]["n"]) // 8).tolist():
            sketches.append(raw[to : to + size])
            to += size
    fact, key, place, side = np.concatenate(facts), np.concatenate(keys), np.concatenate(places), np.concatenate(sides)
    order = np.lexsort((fact["n"][place], key))
    key, place, side = key[order], place[order], side[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    label = fact["label"][place]
    mixed = np.maximum.reduceat(label, starts) != np.minimum.reduceat(label, starts)
    out_a, out_c = [], []
    limit = np.float32(1 - percent / 100 + 1e-5)
    for s, n in zip(starts[mixed].tolist(), sizes[mixed].tolist(), strict=True):
        members, on = place[s : s + n], side[s : s + n]
        two = bool(on.any())
        f = fact[members]
        bits = int(sketch_bits(f["n"][0]))
        matrix = np.stack([fold(sketches[m], bits) for m in members.tolist()])
        last = np.searchsorted(f["n"], f["n"] * 100 // percent, side="right")
        for i in range(n - 1):
            j = np.arange(i + 1, last[i])
            x, y = f[i], f[j]
            ok = (y["label"] != x["label"]) & ~((y["centre"] == x["centre"]) & (np.abs(y["far"] - x["far"]) > limit))
            if two:
                ok &= on[j] != on[i]
            j = j[ok]
            if len(j):
                apart = np.bitwise_count(matrix[j] ^ matrix[i]).sum(1, dtype=np.int64)
                other = f["name"][j[apart <= bound(x["n"], f["n"][j], percent)]]
                out_a.append(np.maximum(other, x["name"]))
                out_c.append(np.minimum(other, x["name"]))
    if not out_a:
        return _PAIRS.empty_table()
    pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_c)], 1), axis=0)
    return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "c"])


def _verify(pairs: DataFrame, own_sets: DataFrame) -> DataFrame:
    """Exact Jaccard similarity of each (a, c) row's sets, as intersection and union sizes."""
    left = own_sets.select(F.col("name").alias("a"), F.col("hashes").alias("x"))
    right = own_sets.select(F.col("name").alias("c"), F.col("hashes").alias("y"))
    both = pairs.join(left, "a").join(right, "c").select("a", "c", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return both.select("a", "c", F.col("both").cast("long").alias("both"), (F.col("sum") - F.col("both")).cast("long").alias("either"))


def _merge(label: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """Labels (d, l) after links (a, c): the components of the labels' own graph, which is small."""
    links = few(links, n)
    left = label.select(F.col("d").alias("a"), F.col("l").alias("x"))
    right = label.select(F.col("d").alias("c"), F.col("l").alias("y"))
    edges = links.join(left, "a").join(right, "c").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("c"))
    reached = connected(edges).select(F.col("node").alias("l"), F.col("component").alias("to"))
    return few(label.join(few(reached, n), "l", "left").select("d", F.coalesce("to", "l").alias("l")).checkpoint(), n)


def components(
    docs: DataFrame, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
    unit_bytes: int = X.UNIT_BYTES, fan: int = X.FAN, tile: int = TILE,
) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest id that links reach."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    ensure_checkpoints(docs)
    to = X.Layout.of(X.text_bytes(docs, F.col(text_col)), unit_bytes, fan)
    texts = X.dealt(docs, to.units, id_col, text_col)
    asked = texts.groupBy("unit").applyInArrow(lambda t: X.lean(_ask, t, size, percent, to.ranges), X.SENT_SQL)
    said = X.answered(asked, _BLOCKS, to)
    base = (
        texts.groupBy("unit").cogroup(said.groupBy("sender"))
        .applyInArrow(lambda t, s: X.lean(_candidates, t, s, size, percent), _BASE_SQL)
        .checkpoint()
    )
    own_sets = base.filter(F.col("kind") == _SET).select("name", "hashes")
    keys = base.filter(F.col("kind") == _KEYS).select("unit", "blob")

    def says(parts):
        for batch in parts:
            yield from X.lean(_says, pa.Table.from_batches([batch]), None, CENTRE, to.ranges).to_batches()

    centres = X.answered(keys.mapInArrow(says, X.SENT_SQL), _centres(CENTRE), to)
    voted = keys.groupBy("unit").cogroup(centres.groupBy("sender")).applyInArrow(lambda k, s: X.lean(_vote, k, s, CENTRE), _OFFERS_SQL).checkpoint()
    best = voted.filter("a is not null").select("a", "c")
    keys = voted.filter("blob is not null").select("unit", "blob")
    n = base.filter(F.col("kind") == _SET).count()
    judged = few(_verify(best, own_sets).checkpoint(), n)
    linked = F.col("both") * 100 >= F.col("either") * percent

    # every set's label is the least name that its links reach so far
    where = few(base.filter(F.col("kind") == _SET).select(F.col("name").alias("d"), F.col("unit").alias("u")), n)
    facts = judged.select(F.col("a").alias("d"), F.col("c").alias("centre"), (1 - F.col("both") / F.col("either")).cast("float").alias("far"))
    known = where.join(facts, "d", "left").select("d", "u", F.coalesce("centre", "d").alias("centre"), F.coalesce("far", F.lit(0.0).cast("float")).alias("far"))
    known = few(known.checkpoint(), n)
    label = _merge(known.select("d", F.col("d").alias("l")), judged.filter(linked).select("a", "c"), n)

    def facts_of(label: DataFrame) -> DataFrame:
        return known.join(label, "d").select("u", "d", "l", "centre", "far")

    def beside(told: DataFrame, said: DataFrame) -> DataFrame:
        """What a unit knows of its sets and what it is told, in one table."""
        return told.unionByName(said.withColumnRenamed("sender", "u"), allowMissingColumns=True)

    def offers_of(keys: DataFrame, label: DataFrame, salt: int) -> DataFrame:
        told = facts_of(label)
        asked = keys.groupBy("unit").cogroup(told.groupBy("u")).applyInArrow(lambda k, t: X.lean(_says, k, t, salt, to.ranges), X.SENT_SQL)
        both = beside(told, X.answered(asked, _centres(salt), to))
        found = keys.groupBy("unit").cogroup(both.groupBy("u")).applyInArrow(lambda k, t: X.lean(_offer, k, t, salt, percent), _OFFERS_SQL)
        return found.checkpoint()

    # labels only ever merge, so each pass needs the keys alone whose blocks had several labels in the pass before,
    # and from the first one on the sets alone that have such keys
    found = offers_of(keys, label, CENTRE + 1)
    mixed = few(found.filter("contested").select(F.col("a").alias("name")), n)
    own_sets = few(own_sets.join(mixed, "name", "left_semi").checkpoint(), n)
    for round_ in range(ROUNDS):
        more = _verify(few(found.filter("not contested").select("a", "c"), n), own_sets).filter(linked).select("a", "c").checkpoint()
        if more.isEmpty():
            break
        label = _merge(label, more, n)
        found = offers_of(found.filter("blob is not null").select("unit", "blob"), label, CENTRE + 2 + round_)
    keys = found.filter("blob is not null").select("unit", "blob")
    contested = few(found.filter("contested").select(F.col("a").alias("d")), n)
    told = facts_of(label).join(contested, "d").join(own_sets.withColumnRenamed("name", "d"), "d").select("u", "d", "l", "centre", "far", "hashes").checkpoint()
    counts = keys.groupBy("unit").cogroup(told.groupBy("u")).applyInArrow(lambda k, t: X.lean(_count_members, k, t, to.ranges), X.SENT_SQL)
    both = beside(told, X.answered(counts, _SIZES, to))
    buckets = max(1, -(-told.count() // PER_BUCKET))
    cut = keys.groupBy("unit").cogroup(both.groupBy("u")).applyInArrow(lambda k, t: X.lean(_send_tiles, k, t, buckets, tile), "bucket int, blob binary")
    crossing = cut.groupBy("bucket").applyInArrow(lambda t: X.lean(_cross, t, percent), "a long, c long").distinct()
    label = _merge(label, _verify(crossing, own_sets).filter(linked).select("a", "c"), n)

    # sets of one id are one node
    same = base.filter(F.col("kind") == _SAME).select(F.col("doc_id").alias("a"), F.col("name").alias("c"))
    if not same.isEmpty():
        every = label.select(F.col("d").alias("a"), F.col("l").alias("c")).unionByName(same)
        label = connected(every).select(F.col("node").alias("d"), F.col("component").alias("l")).checkpoint()

    # equal sets meet once per unit before they meet each other, so no class is gathered
    docs_of = base.filter(F.col("kind") == _DOC).select("unit", "doc_id", "n", "name")
    held = docs_of.filter("name is not null").groupBy("unit", "name").agg(F.min("doc_id").alias("least"))
    labelled = held.join(label.withColumnRenamed("d", "name"), "name", "left").select("unit", "name", "least", F.coalesce("l", "name").alias("l"))
    # so do the sets of one label
    part = labelled.groupBy("unit", "l").agg(F.min("least").alias("least"))
    lowest = part.groupBy("l").agg(F.min("least").alias("component_id"))
    named = labelled.join(part.select("unit", "l").join(lowest, "l"), ["unit", "l"]).select(F.col("unit").alias("u"), F.col("name").alias("s"), "component_id")
    out = docs_of.join(named, (F.col("unit") == F.col("u")) & (F.col("name") == F.col("s")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
