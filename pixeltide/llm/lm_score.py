"""Hashed maximum-entropy language model with a class-factored softmax.

The probability of a token is P(super class | history) * P(class | super class,
history) * P(token | class).  The first two are maximum-entropy models over hashed
features: the class of the word before (bigram), of the second and third word
before (skips), and the pair of the last two (trigram).  The last one is the
token's discounted share of its class.

*Counts* of all training tokens are exact: units send their distinct tokens with
counts to hash buckets and learn the corpus counts of their own tokens, so what is
gathered follows the input and no task holds the vocabulary.

*Training* goes over every training token once: each unit takes gradient steps
from the same start, and the units' weights are averaged, weighted by tokens, in
a tree of bounded fan-in.  The weights have a fixed size (about a megabyte).

*Unknown tokens* are one event.  Words that occur once in training stand for it,
as they would be unknown without that occurrence.

Defined results: a null text is empty and has the end token only; a null id is
never held out; repeated rows count and score each by themselves; without
training tokens N and V are 0 and every token is unknown with probability 1; an
empty table gives an empty table.  Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .shared import ensure_checkpoints, free_shuffles
from .shingles import mix, words

SUPERS, CLASSES = 16, 256
#: Classes of frequent words; the others go by their last two bytes; then the end and the unknown token.
FREQUENT, END_CLASS, UNKNOWN_CLASS = 160, 254, 255
#: A word is frequent from this share of the training tokens.
SHARE = 0.0004
PAIRS = 4096
#: Rows of the two weight tables: bias, three positions, and hashed pairs in the first.
ROWS = 1 + 3 * (CLASSES + 1)
DISCOUNT = 0.75
STEP, BATCH, FAN_IN = 0.25, 8192, 32
END_HASH = np.uint64(0x5AFE_0E2D_0001_0001)


class Tokens:
    """Tokens of a unit's documents, the end token last in each: hash, document, and suffix class."""

    def __init__(self, rows: pa.Table):
        self.unit = unit = X.Unit(rows)
        start, end, word, doc = words(unit)
        n_docs = len(unit.ids)
        number = np.bincount(doc, minlength=n_docs)
        last = unit.buf[end - 1].astype(np.uint64) if len(end) else np.zeros(0, np.uint64)
        but = unit.buf[np.maximum(end - 2, start)].astype(np.uint64) if len(end) else np.zeros(0, np.uint64)
        suffix = FREQUENT + (mix((last | np.uint64(0x20)) * np.uint64(256) + (but | np.uint64(0x20))) % np.uint64(END_CLASS - FREQUENT)).astype(np.int64)
        place = np.arange(len(word)) + doc  # the documents before have an end token each
        total = len(word) + n_docs
        self.hash = np.full(total, END_HASH, np.uint64)
        self.suffix = np.full(total, END_CLASS, np.int64)
        self.hash[place], self.suffix[place] = word, suffix
        self.n = number + 1
        self.doc = np.repeat(np.arange(n_docs), self.n)
        self.first = np.cumsum(self.n) - self.n


def _trains(unit: X.Unit, held: dict[int, bool]) -> np.ndarray:
    return np.fromiter((not held[i] for i in unit.ids.tolist()), bool, len(unit.ids))


def classes(hashes: np.ndarray, suffix: np.ndarray, count: np.ndarray, total: int) -> np.ndarray:
    """Class of each token by its training count; unknown words have the unknown class."""
    frequent = FREQUENT - 1 - (mix(hashes, 12) % np.uint64(FREQUENT)).astype(np.int64)
    out = np.where((count >= SHARE * total) & (suffix != END_CLASS), frequent, suffix)
    return np.where(count == 0, UNKNOWN_CLASS, out)


def features(cls: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first table (5 per token) and of the second (the 4 without the pair)."""
    place = np.arange(len(cls)) - np.repeat(first, n)
    before = []
    for k in (1, 2, 3):
        shifted = np.full(len(cls), CLASSES, np.int64)
        shifted[k:] = cls[:-k] if len(cls) > k else cls[:0]
        before.append(np.where(place >= k, shifted, CLASSES))
    own = [np.zeros(len(cls), np.int64)] + [1 + i * (CLASSES + 1) + b for i, b in enumerate(before)]
    pair = ROWS + ((before[0] * (CLASSES + 1) + before[1]) * 2654435761 % (1 << 32) * PAIRS >> 32)
    return np.stack([*own, pair], 1), np.stack(own, 1)


class Model:
    """Weights of both softmaxes."""

    def __init__(self, upper: np.ndarray | None = None, lower: np.ndarray | None = None):
        self.upper = np.zeros((ROWS + PAIRS, SUPERS), np.float32) if upper is None else upper
        self.lower = np.zeros((ROWS, CLASSES), np.float32) if lower is None else lower

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        np.clip(x, -40, 40, out=x)
        np.exp(x, out=x)
        x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
        return x

    def parts(self, rows: np.ndarray, own: np.ndarray, cls: np.ndarray):
        """Probabilities of all super classes, and of the classes in each token's super class."""
        top = self.upper[rows[:, 0]].copy()
        for f in range(1, rows.shape[1]):
            top += self.upper[rows[:, f]]
        sup = cls // (CLASSES // SUPERS)
        cube = self.lower.reshape(ROWS, SUPERS, CLASSES // SUPERS)
        low = cube[own[:, 0], sup].copy()
        for f in range(1, own.shape[1]):
            low += cube[own[:, f], sup]
        return self._softmax(top), self._softmax(low), sup

    def log10(self, rows: np.ndarray, own: np.ndarray, cls: np.ndarray) -> np.ndarray:
        out = np.empty(len(cls))
        for a in range(0, len(cls), BATCH):
            s = slice(a, a + BATCH)
            top, low, sup = self.parts(rows[s], own[s], cls[s])
            i = np.arange(len(sup))
            out[s] = np.log10(top[i, sup].astype(float)) + np.log10(low[i, cls[s] % (CLASSES // SUPERS)].astype(float))
        return out

    def step(self, rows: np.ndarray, own: np.ndarray, cls: np.ndarray, rate: float) -> None:
        """One gradient step on a batch; each weight's step is damped by how often its row occurs in the batch."""
        width = CLASSES // SUPERS
        top, low, sup = self.parts(rows, own, cls)
        i = np.arange(len(cls))
        top[i, sup] -= 1
        low[i, cls % width] -= 1
        column = np.arange(width)
        for table, which, error, at in ((self.upper, rows, top, None), (self.lower, own, low, sup)):
            columns = table.shape[1]
            blocks = columns // width
            for f in range(which.shape[1]):
                # the rows of one feature are a range of the table
                first = (0, 1, 2 + CLASSES, 3 + 2 * CLASSES, ROWS)[f]
                n = (1, CLASSES + 1, CLASSES + 1, CLASSES + 1, PAIRS)[f]
                cell = (which[:, f] - first) * blocks + (0 if at is None else at)
                grad = np.bincount((cell[:, None] * width + column).ravel(), error.ravel(), n * columns).reshape(n * blocks, width)
                weight = np.bincount(cell, minlength=n * blocks)
                table[first : first + n] -= (rate * grad / (weight[:, None] + 8)).reshape(n, columns).astype(np.float32)


_FACT, _SAID = np.dtype([("n", "<u4"), ("suffix", "u1")]), np.dtype([("n", "<i8")])
#: What a bucket notes: its distinct training tokens, and the discounted weight of each class.
_NOTE = 1 + CLASSES


def _held_of(rows: pa.Table) -> dict[int, bool]:
    return dict(zip(rows["doc_id"].to_pylist(), rows["held_out"].to_pylist(), strict=True))


def _add(facts: X.Facts) -> tuple[X.Facts, np.ndarray]:
    keys, first, which = np.unique(facts.keys, return_index=True, return_inverse=True)
    out = np.empty(len(keys), _FACT)
    out["n"] = np.minimum(np.bincount(which, facts.values["n"], len(keys)), 2**32 - 1)
    out["suffix"] = facts.values["suffix"][first]
    return X.Facts(keys, out), which


def _talk(total: int) -> X.Talk:
    """Training counts of tokens."""

    def note(facts: X.Facts) -> bytes:
        n, suffix = facts.values["n"].astype(np.int64), facts.values["suffix"].astype(np.int64)
        known = n > 0
        weight = np.bincount(classes(facts.keys, suffix, n, total)[known], n[known] - DISCOUNT, CLASSES)
        return np.concatenate([[known.sum()], weight]).astype("<f8").tobytes()

    return X.Talk(_FACT, _SAID, _add, lambda facts: facts.values["n"].astype("<i8").view(_SAID), bits=64, note=note)


def _facts(t: Tokens, trains: np.ndarray) -> tuple[X.Facts, np.ndarray]:
    keys, first, inverse = np.unique(t.hash, return_index=True, return_inverse=True)
    values = np.empty(len(keys), _FACT)
    values["n"] = np.bincount(inverse, weights=trains, minlength=len(keys))
    values["suffix"] = t.suffix[first]
    return X.Facts(keys, values), inverse


def _ask(rows: pa.Table, routes: int) -> pa.Table:
    t, number = Tokens(rows), rows["unit"][0].as_py()
    trains = _trains(t.unit, _held_of(rows))[t.doc]
    facts, _ = _facts(t, trains)
    # the number of training tokens goes to no route
    return X.table([(number, -1, int(trains.sum()).to_bytes(8, "big")), *X.sent(facts, number, routes, _talk(0))], X.SENT)


class _Counted(Tokens):
    """Tokens with their corpus counts and classes."""

    def __init__(self, rows: pa.Table, said: pa.Table, total: int):
        super().__init__(rows)
        facts, inverse = _facts(self, np.zeros(len(self.hash)))
        self.count = X.told(said, _talk(total), facts)["n"][inverse]
        self.cls = classes(self.hash, self.suffix, self.count, total)


_PART = pa.schema([("part", pa.int64()), ("tokens", pa.float64()), ("blob", pa.binary())])
_PART_SQL = "part long, tokens double, blob binary"


def _train(rows: pa.Table, said: pa.Table, total: int) -> pa.Table:
    if not rows.num_rows:
        return _PART.empty_table()
    number = rows["unit"][0].as_py()
    t = _Counted(rows, said, total)
    cls = np.where(t.count == 1, UNKNOWN_CLASS, t.cls)  # what occurs once would be unknown without this text
    rows1, rows2 = features(cls, t.first, t.n)
    own = np.flatnonzero(_trains(t.unit, _held_of(rows))[t.doc])
    own = own[np.argsort(mix(own.astype(np.uint64), 13))]  # batches mix the unit's documents
    model = Model()
    batches = max(1, -(-len(own) // BATCH))
    for i in range(batches):
        which = own[i * BATCH : (i + 1) * BATCH]
        if len(which):
            model.step(rows1[which], rows2[which], cls[which], STEP * 32 / (1 + 4 * i / batches))
    blob = X.squeeze(np.concatenate([model.upper.ravel(), model.lower.ravel()]))
    return X.table([(number, float(len(own)), blob)], _PART)


def _average(rows: pa.Table) -> pa.Table:
    weight, total = 0.0, None
    for tokens, blob in zip(rows["tokens"].to_pylist(), rows["blob"].to_pylist(), strict=True):
        if tokens:
            own = X.expand(blob, np.float32).astype(np.float64) * tokens
            total = own if total is None else total + own
            weight += tokens
    if total is None:
        return _PART.empty_table()
    return X.table([(rows["part"][0].as_py(), weight, X.squeeze((total / weight).astype(np.float32)))], _PART)


_SCORE = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)
_SCORE_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(rows: pa.Table, said: pa.Table, total: int, distinct: int, weight: np.ndarray, model: Model | None) -> pa.Table:
    if not rows.num_rows:
        return _SCORE.empty_table()
    t, held = _Counted(rows, said, total), _held_of(rows)
    base = np.log10((t.count + 0.5) / (total + 0.5 * (distinct + 1)))
    if model is None:
        own = np.zeros(len(base))
    else:
        # words that occur once were unknown in the histories of training
        own = model.log10(*features(np.where(t.count == 1, UNKNOWN_CLASS, t.cls), t.first, t.n), t.cls)
        known = t.count > 0
        own[known] += np.log10((t.count[known] - DISCOUNT) / weight[t.cls[known]])
    ids = t.unit.ids.tolist()
    sums = [np.bincount(t.doc, w, len(ids)) for w in (t.count > 0, base, own)]
    columns = [[None if i == X.NO_ID else i for i in ids], [held[i] for i in ids], t.n, sums[0].astype(np.int64), sums[1], sums[2]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCORE, strict=True)], schema=_SCORE)


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = X.UNIT_BYTES, fan: int = X.FAN) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``held_out`` is a boolean column of ``docs``; rows with true are not trained on.
    """
    ensure_checkpoints(docs)
    to = X.Layout.of(X.text_bytes(docs, F.col(text_col)), unit_bytes, fan)
    texts = X.dealt(docs, to.units, id_col, text_col, held_out=F.coalesce(held_out, F.lit(False)))
    asked = texts.groupBy("unit").applyInArrow(lambda t: X.lean(_ask, t, to.ranges), X.SENT_SQL).checkpoint()
    # each pass over the texts deals them anew: the files of a pass that is done go before the next one
    free_shuffles(docs.sparkSession)
    number = F.conv(F.hex("blob"), 16, 10).cast("long")
    total = asked.filter("route = -1").agg(F.sum(number)).first()[0] or 0
    said = X.answered(asked.filter("route >= 0"), _talk(total), to).checkpoint()
    weight, distinct = np.zeros(CLASSES), 0
    noted = said.filter("sender = -1").select("blob").toLocalIterator()  # a row of fixed size for each bucket, one at a time
    for (blob,) in noted:
        note = np.frombuffer(blob, "<f8")
        distinct, weight = distinct + int(note[0]), weight + note[1:]
    counts = said.filter("sender >= 0")
    parts = texts.groupBy("unit").cogroup(counts.groupBy("sender")).applyInArrow(lambda t, s: X.lean(_train, t, s, total), _PART_SQL)
    left = to.units
    while left > 1:  # a tree of bounded fan-in
        left = -(-left // FAN_IN)
        parts = parts.withColumn("part", F.pmod("part", F.lit(left))).groupBy("part").applyInArrow(lambda t: X.lean(_average, t), _PART_SQL)
    found = parts.filter("tokens > 0").collect()  # one row of fixed size
    del parts
    free_shuffles(docs.sparkSession)
    model = None
    if found:
        flat = X.expand(found[0]["blob"], np.float32)
        cut = (ROWS + PAIRS) * SUPERS
        model = Model(flat[:cut].reshape(-1, SUPERS).copy(), flat[cut:].reshape(-1, CLASSES).copy())
    out = (
        texts.groupBy("unit").cogroup(counts.groupBy("sender"))
        .applyInArrow(lambda t, s: X.lean(_score, t, s, total, distinct, weight, model), _SCORE_SQL)
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
