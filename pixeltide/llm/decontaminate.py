"""Benchmark decontamination by templates.

Texts become template tokens: words keep their letters (lower-cased), numbers,
units and names become typed placeholders.  Windows of template tokens are
hash-joined with the windows of the benchmark, so a question whose numbers, units
or names were changed still matches.  What stands in the slots of a window must be
consistent: equal values in the item stand for equal ones in the text, different
ones for different ones.  That is part of a window's hash, which takes in, for
each slot, how far back in the window its value stood before.

A window of placeholders alone is no evidence: windows with fewer than ``LITERALS``
words match by what fills their slots, so a table of numbers only matches itself.

Case must not hide a leak, so a text has three templates, and windows of each count:
names inside sentences as placeholders; lower-cased words only; and all capitalised
words as placeholders, sentences' first ones too, in windows that are mostly words.

An item counts as leaked into a document when the windows that agree are at least
``coverage`` of the item's windows, or when windows in a row agree along ``run``
tokens at least, however long the item is.

The benchmark is the small side.  Its size is checked: if it has at most ``BLOCK``
bytes, its window table, made once, goes to the executors, and documents are judged
in one narrow pass.  A larger benchmark is a table of windows like the documents',
and both are joined by an exchange on the hash; a bit filter of fixed size keeps
most windows of documents out of it, and lets all through that may match.

Defined results: null and empty texts match nothing, null and empty items leak
nowhere; items shorter than a window are one window of their own length, and those of
fewer than ``SHORT`` tokens leak where they are a whole line of a text, word for
word; repeated items match each; rows with equal ids, repeated rows too, are judged
each by themselves; texts of any length are whole; an empty benchmark or table gives
an empty result.  Other columns are ignored, or kept by ``clean``, whatever their
names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches
from .shingles import mix

#: Tokens of a window, words of a window that is compared as a template, share of an item's windows, tokens in a row.
WINDOW, LITERALS, COVERAGE, RUN = 8, 3, 0.5, 13
#: Tokens from which an item may stand inside a line.
SHORT = 4
#: Bytes of benchmark texts that are sent to the executors, at most; bits of the filter beyond.
BLOCK, FILTER_BITS = 32 << 20, 27

# Units of measure, as lower-case words.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms t ton tons "
    "oz ounce ounces lb lbs pound pounds ml l liter liters litre litres s sec second seconds min minute minutes h hour "
    "hours day days week weeks month months year years hz khz mhz ghz w kw mw v volt volts a amp amps j joule joules "
    "cal kcal c f k degree degrees percent usd eur gbp dollar dollars euro euros cent cents"
).split()

_RANDOM = np.random.default_rng(11)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_BASE = 0xD1342543DE82EF95
_STEP = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BACK = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
NUMBER, UNIT, NAME = np.uint64(3), np.uint64(5), np.uint64(7)
KINDS = ("inner", "lower", "every")

_KIND = np.zeros(256, np.uint8)  # 1: part of a token
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[[0x0A, 0x21, 0x2E, 0x3A, 0x3F]] = True  # a word after one of these starts a sentence
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        np.multiply.accumulate(np.full(n - 1, _BASE, np.uint64), out=out[1:])
    return out


def _hash_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    power = _powers(int(size.max(initial=1)))
    heads = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(heads, size)
    if not len(size):
        return np.zeros(0, np.uint64)
    return mix(np.add.reduceat(_BYTES[buf[place + np.repeat(start, size)]] * power[place], heads))


_UNIT_HASHES = np.sort(
    np.concatenate([_hash_words(b := np.frombuffer(u.encode(), np.uint8), np.array([0]), np.array([len(b)])) for u in UNITS])
)


class Template:
    """Template tokens of some texts: token, raw hash (what fills a slot), document and line."""

    def __init__(self, texts: list[str | None], kind: str = "inner"):
        self.texts, self.kind = texts, kind
        if kind == "lower":
            texts = [t and t.lower() for t in texts]
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        joined = b"\n".join(raw) + b"\n"  # a line break ends a token and starts a sentence
        buf = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        ends = np.cumsum(sizes)
        ink = _KIND[buf].astype(bool)
        start = np.flatnonzero(ink & ~np.concatenate([[False], ink[:-1]]))
        end = np.flatnonzero(ink & ~np.concatenate([ink[1:], [False]])) + 1
        doc = np.searchsorted(ends, start, side="right")
        hashes = _hash_words(buf, start, end)
        digit = _DIGIT[buf[start]]
        # a decimal or thousands mark between two numbers joins them into one token
        if len(start) > 1:
            glue = digit[1:] & digit[:-1] & (start[1:] == end[:-1] + 1) & np.isin(buf[end[:-1]], [0x2C, 0x2E])
            first = np.concatenate([[True], ~glue])
            if glue.any():
                head = np.flatnonzero(first)
                number = np.arange(len(start))
                behind = number - np.maximum.accumulate(np.where(first, number, 0))
                hashes = np.bitwise_xor.reduceat(hashes * (1 + 2 * behind).astype(np.uint64), head)
                start, doc, digit = start[head], doc[head], digit[head]
        spaced = np.maximum.accumulate(np.where(~_SPACE[buf] | (buf == 0x0A), np.arange(len(buf)), -1))
        before = np.where(start > 0, spaced[np.maximum(start - 1, 0)], -1)
        sentence = (before < 0) | _END[buf[np.maximum(before, 0)]]
        lead = buf[start]
        second = buf[np.minimum(start + 1, len(buf) - 1)]
        upper = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        unit = np.concatenate([[False], digit[:-1] & (doc[1:] == doc[:-1])]) if len(start) else np.zeros(0, bool)
        unit &= np.isin(hashes, _UNIT_HASHES)
        token = hashes.copy()
        token[upper if kind == "every" else upper & ~sentence] = NAME
        if kind == "lower":
            token = hashes.copy()
        token[unit] = UNIT
        token[digit] = NUMBER
        self.token, self.raw, self.doc = token, hashes, doc
        line = np.cumsum(buf == 0x0A)
        self.line = line[start] if len(start) else start
        self.count = np.bincount(doc, minlength=len(raw))
        self.first = np.cumsum(self.count) - self.count
        # how many tokens back a slot's value filled a slot before, in the same text
        slot = np.flatnonzero(token <= NAME)
        by = slot[np.lexsort((slot, hashes[slot], doc[slot]))]
        again = (doc[by][1:] == doc[by][:-1]) & (hashes[by][1:] == hashes[by][:-1]) if len(by) else np.zeros(0, bool)
        self.back = np.zeros(len(token), np.int64)
        self.back[by[1:][again]] = np.diff(by)[again]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First token and hash of each window that lies in one document."""
        n = len(self.token) - size + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        literal = np.concatenate([[0], np.cumsum(self.token > NAME)])
        words = (literal[size:] - literal[:-size])[at]
        total = sum(self.token[i : n + i] * _STEP[i] for i in range(size))[at]
        slots = np.flatnonzero(words < size - 1)  # one slot alone is consistent
        for i in range(1, size):
            back = self.back[at[slots] + i]
            total[slots] += np.where(back <= i, back, 0).astype(np.uint64) * _BACK[i]
        least = max(-(-LITERALS * size // WINDOW), size // 2 + 1 if self.kind == "every" else 0)
        plain = words < least
        exact = at[plain]
        total[plain] = mix(sum((self.raw[exact + i] * _STEP[i] for i in range(size)), np.zeros(len(exact), np.uint64)), 70)
        return at, mix(total, size + 100 * KINDS.index(self.kind))

    def lines(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First token and hash, by what is written, of each line of ``size`` tokens."""
        n = len(self.token)
        head = np.flatnonzero(np.concatenate([[True], self.line[1:] != self.line[:-1]])) if n else np.zeros(0, np.int64)
        at = head[np.diff(np.append(head, n)) == size]
        return at, mix(sum((self.raw[at + i] * _STEP[i] for i in range(size)), np.zeros(len(at), np.uint64)), 1000 + size)


class Table:
    """Windows of benchmark items, by size: hash, item (a row number) and first token in the item."""

    def __init__(self, texts: list[str | None], window: int = WINDOW):
        self.window = window
        found: dict[int, list[tuple]] = defaultdict(list)
        for kind in KINDS:
            own = Template(texts, kind)
            if kind == KINDS[0]:
                self.number = np.where(own.count > 0, np.maximum(own.count - window + 1, 1), 0)
                self.sizes = sorted({min(window, c) for c in own.count.tolist() if c})
                self.size = np.minimum(own.count, window)
            for size in self.sizes:
                if size < min(SHORT, window):
                    at, h = own.lines(size) if kind == "lower" else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                    at, h = at[own.count[own.doc[at]] == size], h[own.count[own.doc[at]] == size]
                else:
                    at, h = own.windows(size)
                    fits = np.minimum(own.count[own.doc[at]], window) == size
                    at, h = at[fits], h[fits]
                found[size].append((h, own.doc[at], at - own.first[own.doc[at]]))
        self.tables = {}
        for size, parts in found.items():
            h, item, q = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[h & np.uint64(0xFFFFF)] = True
            self.tables[size] = (h[order], item[order], q[order], bits)

    def leaks(self, texts: list[str | None], coverage: float = COVERAGE, run: int = RUN) -> list[tuple[int, int, int, int, int]]:
        """(text, item, windows that agree, windows of the item, tokens that agree in a row) of each leak."""
        found: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        for size, doc, p, h in document_windows(texts, list(self.tables)):
            hashes, item, q, bits = self.tables[size]
            likely = bits[h & np.uint64(0xFFFFF)]
            doc, p, h = doc[likely], p[likely], h[likely]
            low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            n = high - low
            which = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
            hits = (np.repeat(doc, n), item[which], np.repeat(p, n) - q[which], q[which])
            for d, i, shift, place in zip(*(x.tolist() for x in hits), strict=True):
                found[d, i].add((shift, place))
        out = []
        for (d, i), places in found.items():
            verdict = judge(places, int(self.number[i]), int(self.size[i]), coverage, run)
            if verdict:
                out.append((d, i, *verdict))
        return out


def document_windows(texts: list[str | None], sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size and template: text, first token in it and hash of all windows."""
    for kind in KINDS:
        own = Template(texts, kind)
        for size in sizes:
            if size < SHORT and kind != "lower":
                continue
            at, h = own.lines(size) if size < SHORT else own.windows(size)
            yield size, own.doc[at], at - own.first[own.doc[at]], h


def judge(places: set[tuple[int, int]], number: int, size: int, coverage: float, run: int) -> tuple[int, int, int] | None:
    """Windows that agree, windows of the item and tokens in a row, if that is a leak; ``places`` are (shift, first token)."""
    matched = len({q for _, q in places})
    longest = held = 0
    before = None
    for shift, q in sorted(places):
        held = held + 1 if before == (shift, q - 1) else 1
        longest, before = max(longest, held), (shift, q)
    tokens = longest + size - 1
    return (matched, number, tokens) if matched >= coverage * number or tokens >= run else None


LEAKS_SQL = "doc_id long, item_id long, n_matched long, n_windows long, n_run long"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_LEAKS = pa.schema([(c.split()[0], pa.int64()) for c in LEAKS_SQL.split(", ")])
_ITEMS = pa.schema([(c, pa.int64()) for c in ("h", "item_row", "q", "size", "number")])
_WINDOWS = pa.schema([(c, pa.int64()) for c in ("h", "row", "p")])


def _row(id_col: str, text_col: str):
    """A number of the row's id and text; equal rows have equal windows."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _joined(docs: DataFrame, benchmark: DataFrame, window: int, coverage: float, run: int, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(row, item_row, n_matched, n_windows, n_run) of leaks, by an exchange of both sides' windows."""
    items = benchmark.select(_row(item_col, item_text).alias("item_row"), F.col(item_text).alias("text")).distinct()

    def item_windows(parts):
        for batch in batches.by_bytes(iter(parts), "text"):
            own, ids = Table(batch.column(1).to_pylist(), window), batch.column(0).to_numpy()
            for size, (h, item, q, _) in own.tables.items():
                columns = (h.view(np.int64), ids[item], q, np.full(len(h), size), own.number[item])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ITEMS)

    table = items.mapInArrow(item_windows, "h long, item_row long, q long, size long, number long")
    sizes = list(range(1, window + 1))
    slots = table.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).cast("int").alias("slot"))
    # the filter has a fixed size: bytes of bits, put together by groups
    packed = (
        slots.groupBy(F.shiftright("slot", 13).alias("page")).agg(F.collect_set(F.col("slot").bitwiseAND(F.lit(8191))).alias("on"))
    )
    bits = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for page, on in packed.toLocalIterator():  # at most 2**FILTER_BITS slots
        at = (page << 13) + np.array(on, np.int64)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    sent = docs.sparkSession.sparkContext.broadcast(bits)  # 2**FILTER_BITS / 8 bytes
    texts = docs.select(_row(id_col, text_col).alias("row"), F.col(text_col).alias("text"))

    def own_windows(parts):
        bits = sent.value
        for batch in batches.by_bytes(iter(parts), "text"):
            rows = batch.column(0).to_numpy()
            for _, doc, p, h in document_windows(batch.column(1).to_pylist(), sizes):
                at = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                on = (bits[at >> 3] >> (at & 7)) & 1 > 0
                columns = (h[on].view(np.int64), rows[doc[on]], p[on])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_WINDOWS)

    found = texts.mapInArrow(own_windows, "h long, row long, p long").distinct()
    places = found.join(table, "h").groupBy("row", "item_row").agg(
        F.collect_set(F.struct((F.col("p") - F.col("q")).alias("shift"), "q")).alias("places"), F.max("number").alias("number"), F.max("size").alias("size")
    )

    def verdicts(parts):
        for batch in parts:
            out = []
            for row, item, found, number, size in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                verdict = judge({(f["shift"], f["q"]) for f in found}, number, size, coverage, run)
                if verdict:
                    out.append((row, item, *verdict))
            yield _batch(out, pa.schema([(c, pa.int64()) for c in ("row", "item_row", "n_matched", "n_windows", "n_run")]))

    return places.mapInArrow(verdicts, "row long, item_row long, n_matched long, n_windows long, n_run long")


def _small(benchmark: DataFrame, item_col: str, item_text: str, block: int) -> tuple[list, list] | None:
    """The benchmark's ids and texts, if they have at most ``block`` bytes."""
    two = benchmark.select(F.col(item_col).cast("long"), F.col(item_text))
    size = two.agg(F.sum(F.coalesce(F.octet_length(item_text), F.lit(0)) + 16)).first()[0] or 0
    if size > block:
        return None
    rows = two.collect()
    return [r[0] for r in rows], [r[1] for r in rows]


def leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, run: int = RUN,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK,
) -> DataFrame:
    """One row per document and item that leaked into it: doc_id, item_id, n_matched, n_windows, n_run."""
    small = _small(benchmark, item_col, item_text, block)
    if small is None:
        found = _joined(docs, benchmark, window, coverage, run, id_col, text_col, item_col, item_text)
        items = benchmark.select(_row(item_col, item_text).alias("item_row"), F.col(item_col).cast("long").alias("item_id"))
        rows = docs.select(_row(id_col, text_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"))
        return rows.join(found, "row").join(items, "item_row").select(*_LEAKS.names)
    ids, texts = small
    table = Table(texts, window)

    def search(parts):
        for batch in batches.by_bytes(iter(parts), "text"):
            doc_ids = batch.column(0).to_pylist()
            yield _batch([(doc_ids[d], ids[i], *more) for d, i, *more in table.leaks(batch.column(1).to_pylist(), coverage, run)], _LEAKS)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(search, LEAKS_SQL)


def clean(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, run: int = RUN,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK,
) -> DataFrame:
    """The rows of ``docs`` into which no item leaked, with all their columns: a narrow filter for a small benchmark."""
    small = _small(benchmark, item_col, item_text, block)
    if small is None:
        found = _joined(docs, benchmark, window, coverage, run, id_col, text_col, item_col, item_text)
        return docs.join(found.select(F.col("row").alias("_row_of_leak")), _row(id_col, text_col) == F.col("_row_of_leak"), "left_anti")
    table = Table(small[1], window)

    def search(parts):
        for batch in batches.by_bytes(iter(parts), text_col):
            keep = np.ones(batch.num_rows, bool)
            column = batch.column(batch.schema.get_field_index(text_col))
            keep[[d for d, *_ in table.leaks(column.to_pylist(), coverage, run)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(search, docs.schema)
