"""Rule bitmask ledger: every quality rule is evaluated once per document.

The ledger keeps one row per document with the raw measurements and one
``fail_bits`` integer (bit *i* set: rule *i* failed).  Policies are versioned
masks over those bits, so a new policy, or an ablation of one rule, is a bitwise
test on the ledger and never looks at a text again.

Everything is built from native column expressions; a document is measured in
place, without exploding its words and without a shuffle.

Defined results: a null or blank text has no words (all counts 0) and fails
``few_words``; a null ``doc_id`` is carried through; repeated rows give repeated
ledger rows; an empty table gives an empty ledger.  Input columns other than the
id and the text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words, as a Java character class.
BLANK = r"\x20\x09-\x0D"

#: Name of each rule, in bit order.
RULES = ("few_words", "repeated_windows", "symbol_heavy", "odd_word_length", "duplicate_lines", "shouting")


@dataclass(frozen=True)
class Thresholds:
    """Limits of the rules; a ledger records the verdicts under one set of limits."""

    min_words: int = 50
    max_repeat_pct: int = 50
    max_symbol_pct: int = 10
    min_mean_chars: int = 2
    max_mean_chars: int = 20
    max_dup_line_pct: int = 50
    max_upper_pct: int = 60


@dataclass(frozen=True)
class Policy:
    """A version name and the rules that reject a document under it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


POLICIES = {
    p.version: p
    for p in (
        Policy("base-1", ("few_words", "repeated_windows")),
        Policy("strict-1", RULES),
    )
}


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row of measurements per document (see the module docstring), after the columns of ``carry``."""
    carry = carry or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(f"[^{BLANK}]"))
    carried = [c.alias(f"carried_{name}") for name, c in carry.items()]
    split = docs.select(*carried, F.col(id_col).alias("doc_id"), text.alias("t"), words.alias("w"), lines.alias("l"))
    grams = F.transform(
        F.sequence(F.lit(0), F.size("w") - 3),
        lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)),
    )
    grown = split.select(
        *(f"carried_{name}" for name in carry),
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        (F.length(F.regexp_replace("t", r"[^A-Z]+", ""))).cast("long").alias("n_upper"),
        F.when(F.size("w") >= 3, grams).otherwise(F.array().cast("array<long>")).alias("g"),
    )
    done = grown.withColumn("n_repeat_words", _covered("g")).drop("g")
    return done.withColumnsRenamed({f"carried_{name}": name for name in carry})


def _covered(grams: str) -> Column:
    """Words covered by windows whose hash occurs at least twice in the array.

    Windows are sorted by (hash, place); those equal to a neighbour are flagged,
    and a flagged place covers 3 words less what the next one covers too.
    """
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # let-binding through a one-element transform keeps the sorted array from being computed again
    bound = F.get(F.transform(F.array(pairs), lambda s: _positions(s)), 0)
    total = F.get(
        F.transform(
            F.array(F.sort_array(bound)),
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        ),
        0,
    )
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(total).cast("long")


def _positions(s: Column) -> Column:
    """Places in the sorted array of (hash, place) that equal a neighbour's hash."""
    same = F.transform(
        s,
        lambda x, k: F.when(
            F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)),
            x["i"],
        ),
    )
    return F.array_compact(same)


def ledger(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Thresholds = Thresholds(),
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Measurements plus ``fail_bits``, one row per document, after the columns of ``carry``."""
    m = measure(docs, id_col, text_col, carry)
    c = F.col
    failed = (
        c("n_words") < limits.min_words,
        100 * c("n_repeat_words") > limits.max_repeat_pct * c("n_words"),
        100 * c("n_symbols") > limits.max_symbol_pct * c("n_words"),
        (c("n_words") > 0)
        & (
            (c("word_chars") < limits.min_mean_chars * c("n_words"))
            | (c("word_chars") > limits.max_mean_chars * c("n_words"))
        ),
        100 * c("n_dup_lines") > limits.max_dup_line_pct * c("n_lines"),
        100 * c("n_upper") > limits.max_upper_pct * c("word_chars"),
    )
    bits = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failed)), F.lit(0))
    return m.withColumn("fail_bits", bits.cast("long"))


def apply_policy(led: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def passing(docs: DataFrame, policy: Policy, text_col: str = "text", limits: Thresholds = Thresholds()) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns; no join and no shuffle."""
    whole = {"row": F.struct(*docs.columns)}
    led = ledger(docs, docs.columns[0], text_col, limits, whole)
    # a filter on ``kept`` would be pushed below the projections and repeat their expressions; a generator is not
    kept = apply_policy(led, policy).select(F.explode_outer(F.when(F.col("kept"), F.array("row"))).alias("row"))
    return kept.filter(F.col("row").isNotNull()).select("row.*")


def ablate(led: DataFrame, policy: Policy) -> DataFrame:
    """One row per rule of the policy: documents that fail it, and documents kept only if it is dropped.

    The ledger is first counted by ``fail_bits`` (at most 2**rules groups, map-side
    combined), so the ablations read a bounded table.
    """
    patterns = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in policy.rules))
    hit = patterns.withColumn("r", F.explode(rules)).select("fail_bits", "n", "r.rule", "r.bit")
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    return hit.groupBy("rule").agg(
        F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).cast("long").alias("n_failed"),
        F.sum(F.when(masked == F.col("bit"), F.col("n")).otherwise(0)).cast("long").alias("n_only"),
    )
