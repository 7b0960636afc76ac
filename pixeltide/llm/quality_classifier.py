"""Weak-label quality classifier: overlapping heuristics, EM, hashed linear scorers.

Labellers vote good, bad or abstain on each document, from the measurements of the
quality ledger (native columns).  Documents are counted by vote pattern, a table of
at most 3**labellers rows; expectation-maximisation on it estimates each labeller's
votes under both classes, and with them the posterior of each pattern.  Documents
whose quality is known count in their class alone; they tell the classes apart, so
nothing is believed of the labellers beforehand but one vote of each kind.  The others
together weigh ``OTHERS`` of the known ones, because labellers are not quite
independent, and what is not told would outweigh what is.  Without any known quality a belief has to do that (``BELIEVED``, as strong as a tenth of the
documents): kinds of bad text hardly overlap, and without either the estimates take a
labeller that is alone with its kind for noise.  Posterior labels of a bounded sample
train a linear scorer on hashed words and votes.

Toxicity is separate: no labeller votes on it, and a second scorer of the same kind
learns it from a bounded sample of labelled rows.

Bounds: the samples hold about ``SAMPLE`` and at most ``LABELLED`` documents, whole, in a
random order that ends where they would have more than ``CELLS`` features together,
so what the driver reads is bounded.  All other steps cover all rows: patterns,
posteriors and scores.

Defined results: a null or empty text has abstaining votes only and no feature; it
is kept.  Without labels no text is toxic.  Repeated rows count and give a row
each, and so do rows of one id, each with that id's label; of several labels of an id
the larger quality and toxicity hold; labels without a document, an id or a value are
ignored; null ids are carried through; texts of any length are whole; a score equal
to its threshold rejects; an empty table gives an empty table.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches, shared
from .exchange import NO_ID, Unit
from .quality_rules import measure
from .shingles import words

#: Documents that train the quality scorer (about) and the toxicity scorer (at most).
SAMPLE, LABELLED = 6000, 12_000
BITS, CELLS = 20, 20_000_000
EPOCHS, DECAY = 200, 1e-5
#: Votes (abstain, good, bad) on good and on bad text that are believed where no quality is known, and how strongly.
BELIEVED, BELIEF = ((0.05, 0.948, 0.002), (0.05, 0.55, 0.4)), 0.1
#: Weight of all documents of unknown quality, as a share of the known ones.
OTHERS = 0.1
LABELLERS = ("repeats", "symbols", "shouting", "lines", "lengths")
ABSTAIN, GOOD, BAD = 0, 1, 2


def votes(m: DataFrame) -> list[Column]:
    """A vote of each labeller, from columns of the ledger's measurements."""
    n = F.col("n_words")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(n == 0, ABSTAIN).when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    return [
        vote(100 * F.col("n_repeat_words") > 50 * n, 100 * F.col("n_repeat_words") < 35 * n),
        vote(100 * F.col("n_symbols") > 10 * n, 100 * F.col("n_symbols") < 5 * n),
        vote(100 * F.col("n_upper") > 50 * F.col("word_chars"), 100 * F.col("n_upper") < 20 * F.col("word_chars")),
        vote(100 * F.col("n_dup_lines") > 60 * F.col("n_lines"), 100 * F.col("n_dup_lines") < 40 * F.col("n_lines")),
        vote((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 18 * n), (F.col("word_chars") > 3 * n) & (F.col("word_chars") < 12 * n)),
    ]


def patterns(docs: DataFrame) -> DataFrame:
    """(doc_id, text, pattern): the votes as digits to base 3; texts pass through."""
    m = measure(docs, carry={"text": F.col("text")})
    code = sum((v * F.lit(3**i) for i, v in enumerate(votes(m))), F.lit(0))
    return m.select(F.col("doc_id").cast("long").alias("doc_id"), "text", code.cast("int").alias("pattern"))


def estimate(
    counts: dict[int, int], known: dict[tuple[int, int], int] | None = None, labellers: int = len(LABELLERS), rounds: int = 200
) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of "bad" by pattern, and each labeller's vote probabilities under (good, bad).

    ``counts`` has all documents by pattern, ``known`` those of known quality by pattern
    and badness (0 or 1).
    """
    if not counts:
        return {}, np.full((labellers, 2, 3), 1 / 3)
    codes = np.array(sorted(counts))
    digit = codes[:, None] // 3 ** np.arange(labellers) % 3
    told = np.array([[(known or {}).get((c, bad), 0) for c in codes.tolist()] for bad in (0, 1)], float)
    n = np.maximum(np.array([counts[c] for c in codes.tolist()], float) - told.sum(0), 0)
    # start: the share of bad among a pattern's votes
    bad, cast = (digit == BAD).sum(1), (digit != ABSTAIN).sum(1)
    p = np.where(bad > 0, 0.9, np.where(cast > 0, 0.05, 0.2))
    believed = np.array(BELIEVED) * n.sum() * BELIEF
    if told.any(1).all():
        believed, n = np.ones((2, 3)), n * min(1.0, OTHERS * told.sum() / max(n.sum(), 1))
    theta = np.full((labellers, 2, 3), 1 / 3)
    for _ in range(rounds):
        both = np.stack([(1 - p) * n, p * n]) + told
        prior = (both.sum(1) + 1) / (both.sum() + 2)
        for j in range(labellers):
            for c in (0, 1):
                hits = np.bincount(digit[:, j], both[c], 3) + believed[c]
                theta[j, c] = hits / hits.sum()
        log = np.log(prior)[:, None] + sum(np.log(theta[j][:, digit[:, j]]) for j in range(labellers))
        log -= log.max(0)
        p = np.exp(log[1]) / np.exp(log).sum(0)
    return dict(zip(codes.tolist(), p.tolist(), strict=True)), theta


def _features(batch: pa.RecordBatch, place: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of a batch's texts and the row of each, distinct by row."""
    texts = batch.column(place).to_pylist()
    rows = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array([t or "" for t in texts], pa.string())})
    _, _, word, doc = words(Unit(rows))
    keys = np.unique((doc << BITS) | (word >> np.uint64(64 - BITS)).astype(np.int64))
    return keys & ((1 << BITS) - 1), keys >> BITS


def _digits(pattern: np.ndarray) -> np.ndarray:
    """Vote of each labeller, as numbers of features of their own."""
    k = len(LABELLERS)
    return pattern[:, None] // 3 ** np.arange(k) % 3 + 3 * np.arange(k)


def _sample(rows: DataFrame, cells: int = CELLS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features, vote patterns and targets of (doc_id, text, pattern, target) rows on the driver, ``cells`` features at most, one document at least."""

    def run(parts):
        for batch in batches.by_bytes(iter(parts), "text"):
            cell, row = _features(batch, 0)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            packed = pa.array([cell[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, *(batch.column(k) for k in (1, 2, 3))], names=["cells", "pattern", "target", "turn"])

    turn = F.xxhash64("doc_id", "text", F.lit("turn"))
    own = rows.select("text", "pattern", F.col("target").cast("double").alias("target"), turn.alias("turn"))
    found, held = [], 0
    for r in own.mapInArrow(run, "cells binary, pattern int, target double, turn long").orderBy("turn", "target").toLocalIterator():
        held += len(r["cells"]) // 4
        if found and held > cells:
            break
        found.append((np.frombuffer(bytes(r["cells"]), "<i4"), r["pattern"], r["target"]))
    return [f[0] for f in found], np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found])


Linear = tuple[np.ndarray, np.ndarray, float]
#: A scorer that never fires.
SILENT: Linear = (np.zeros(1 << BITS, np.float32), np.zeros(3 * len(LABELLERS)), -20.0)


def fit_linear(cells: list[np.ndarray], pattern: np.ndarray, target: np.ndarray) -> Linear:
    """Word weights, vote weights and bias of a logistic scorer, by adaptive full-gradient steps on soft targets."""
    if not len(target):
        return SILENT
    sizes = np.fromiter(map(len, cells), np.int64, len(cells))
    used, cell = np.unique(np.concatenate(cells), return_inverse=True)
    row = np.repeat(np.arange(len(cells)), sizes)
    value = (1 / np.sqrt(np.maximum(sizes, 1)))[row]
    digit = _digits(pattern)
    share = min(max(float(target.mean()), 1e-3), 1 - 1e-3)
    balance = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share))
    own, vote, bias = np.zeros(len(used)), np.zeros(3 * len(LABELLERS)), 0.0
    seen, seen_vote, seen_bias = np.full(len(used), 1e-8), np.full(len(vote), 1e-8), 1e-8
    for _ in range(EPOCHS):
        z = bias + np.bincount(row, own[cell] * value, len(cells)) + vote[digit].sum(1)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * balance
        grad = np.bincount(cell, error[row] * value, len(used)) / len(cells) + DECAY * own
        seen += grad**2
        own -= grad / np.sqrt(seen)
        grad = np.bincount(digit.ravel(), np.repeat(error, digit.shape[1]), len(vote)) / len(cells) + DECAY * vote
        seen_vote += grad**2
        vote -= 0.3 * grad / np.sqrt(seen_vote)
        seen_bias += error.mean() ** 2
        bias -= 0.3 * error.mean() / np.sqrt(seen_bias)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = own
    return weights, vote, bias


def _apply(judged: DataFrame, models: dict[str, Linear]) -> DataFrame:
    """A score of each linear model for (doc_id, text, pattern) rows."""
    schema = "doc_id long, " + ", ".join(f"{n} double" for n in models)

    def run(parts):
        for batch in batches.by_bytes(iter(parts), "text"):
            cell, row = _features(batch, 1)
            number = np.bincount(row, minlength=batch.num_rows)
            digit = _digits(batch.column(2).to_numpy().astype(np.int64))
            scores = []
            for weights, vote, bias in models.values():
                z = bias + vote[digit].sum(1) + np.bincount(row, weights[cell], batch.num_rows) / np.sqrt(np.maximum(number, 1))
                scores.append(np.where(number > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, scores)], names=["doc_id", *models])

    return judged.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5, toxic_threshold: float = 0.4) -> DataFrame:
    """Per row: doc_id, low_score and toxic_score (0 to 1), and ``kept``.

    ``docs`` has doc_id and text; ``labels`` has doc_id and toxic.
    """
    # documents are measured once: texts and patterns are a table in the shared folder, read by all that follows
    path = shared.folder(docs.sparkSession, "judged")
    patterns(docs).write.option("compression", "zstd").parquet(path)
    judged = docs.sparkSession.read.parquet(path)
    counts = {r["pattern"]: r["n"] for r in judged.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # at most 3**5 rows
    known: dict[tuple[int, int], int] = {}
    if labels is not None and "quality" in labels.columns:
        quality = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        told = judged.select("doc_id", "pattern").join(quality, "doc_id").groupBy("pattern", (F.col("quality") == 0).cast("int").alias("bad"))
        known = {(r["pattern"], r["bad"]): r["n"] for r in told.agg(F.count("*").alias("n")).collect()}  # twice as many at most
    posterior, _ = estimate(counts, known)
    bucket = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    models = {"low_score": SILENT, "toxic_score": SILENT}
    if posterior:
        share = min(1.0, SAMPLE / sum(counts.values()))
        soft = F.create_map(*(x for k, v in posterior.items() for x in (F.lit(k), F.lit(v))))
        # rows without an id are dealt by their texts
        turn = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text")), F.lit("sample")), F.lit(1_000_000))
        picked = judged.filter(turn < share * 1_000_000)
        models["low_score"] = fit_linear(*_sample(picked.withColumn("target", F.element_at(soft, F.col("pattern")))))
    if labels is not None:
        toxic = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("target"))
        share = min(1.0, LABELLED / max(toxic.count(), 1))
        few = toxic.filter(bucket < share * 1_000_000).orderBy("doc_id").limit(LABELLED)
        joined = judged.join(F.broadcast(few), "doc_id")  # at most LABELLED rows of two numbers
        models["toxic_score"] = fit_linear(*_sample(joined))
    scored = _apply(judged, models)
    return scored.withColumn("kept", (F.col("low_score") < threshold) & (F.col("toxic_score") < toxic_threshold))
