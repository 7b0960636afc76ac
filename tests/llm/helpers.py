"""Brute-force versions and awkward documents for the tests."""

import random
import re
from collections import Counter

NO_ID = (1 << 63) - 1
SPACE = r"[^\x20\x09-\x0D]+"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(SPACE, lower(text))


def awkward(seed=5):
    """Copies, near copies, shared passages, nulls, empty, tiny, long and periodic texts, repeated rows."""
    rng = random.Random(seed)
    vocabulary = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "s")]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base, passage = text(150), text(70)
    rows = [(i, text(rng.randrange(60, 200))) for i in range(12)]
    rows += [(20 + i, base) for i in range(5)]
    for i in range(12):
        w = base.split()
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary) + "x"
        rows.append((40 + i, " ".join(w)))
    rows += [(60 + i, f"{text(40)} {passage}\n{text(30 + i)}") for i in range(6)]
    rows += [(80, None), (81, ""), (82, " \t\n"), (83, "One Two"), (84, "one two"), (85, "a" * 900), (86, "ab " * 300), (87, "é" * 200), (88, "x" + "é" * 200)]
    rows += [(90, text(4000)), (91, base.upper()), (92, text(5)), (92, text(5)), (None, base)]
    rows += [(95, rows[0][1]), (95, rows[0][1])]
    return rows


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars", "1 as unit", "2 as kind") if extra else df


def order(rows):
    return sorted((NO_ID if i is None else i, t or "") for i, t in rows)


def removed(rows, length=50):
    """(id, bytes, kept) of each row by the contract of exact string removal."""
    first, out = {}, []
    raw = [(i, t.encode()) for i, t in order(rows)]
    for i, b in raw:
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        out.append((i, len(b), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def shingle_set(text, size=5):
    w = words(text)
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def components(rows, percent=75):
    """(id, set size, component) of each row; rows with one id are one node."""
    sets = [(NO_ID if i is None else i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets)


def token_counts(rows, held):
    count = Counter()
    for i, t in rows:
        if not held(i):
            count.update(words(t))
            count["\0end"] += 1
    return count
