"""Operators without an exact contract: planted cases, held-out accuracy, and the pipeline."""

import random

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

import helpers as H
from pixeltide.llm import decontaminate, language_id, lm_score, quality_classifier, queries, substring_dedup
from pixeltide.llm.shingles import mix

SF = "/root/testdata/sf0.01"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def test_language_of_held_out_documents(spark):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    got = queries.op5_language_id(spark, SF).collect()
    out = [r for r in got if r.held_out]
    assert len(got) == len(lang) and len(out) > 100
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    df = spark.createDataFrame([(1, "the cat sat", "en"), (2, "der hund lief", "de"), (3, "x", None)], "doc_id long, text string, lang string")
    names, table = language_id.fit(df, RANKS)
    assert names == ["de", "en"] and np.allclose(table.sum(0), 1)
    more = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (None, "der hund"), (5, "cat" * 500)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(more, names, table, RANKS).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] == "de" and got[5][0] == "en"
    names, table = language_id.fit(df.limit(0), RANKS)
    assert {r.lang_pred for r in language_id.predict(more, names, table, RANKS).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = language_id.pieces_of(RANKS)
    rng = np.random.default_rng(2)
    p = rng.random(pieces.count) / pieces.count
    table = p[:, None]
    number = {int(h): i for i, h in enumerate(pieces.hashes)}

    def piece(raw):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in raw:
                h = h * pieces._base + pieces.random[c]
        return number.get(int(h), -1)

    words = [b"thing", "größe".encode(), "ありがとうございました".encode(), b"interestingly" * 40, b"a"]
    got = language_id.word_scores(words, pieces, table)[:, 0]
    for word, score in zip(words, got, strict=True):
        logs = [0.0]  # by place, as logarithms: no scaling is needed
        for j in range(1, len(word) + 1):
            terms = [logs[i] + np.log(p[k]) for i in range(max(0, j - 40), j) if (k := piece(word[i:j])) >= 0]
            logs.append(float(np.logaddexp.reduce(terms)))
        assert score == pytest.approx(logs[-1], rel=1e-9)
    # the expected pieces of a word have as many bytes as the word
    sizes = np.zeros(pieces.count)
    for word in words:
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + 40) + 1):
                if (k := piece(word[i:j])) >= 0:
                    sizes[k] = j - i
    for word in words:
        assert language_id.expected([word], np.ones(1), pieces, p) @ sizes == pytest.approx(len(word), rel=1e-6)


def test_language_fit_and_predict_against_brute_force(spark):
    """Expectation-maximisation and prediction, again with plain dictionaries and all segmentations."""
    rows = [(1, "the cat sat on the mat the end", "en"), (2, "der hund lief der katze nach", "de"), (3, "the dog", "en"), (4, "der mat", "de"), (4, "der mat", "de"), (5, None, "en"), (6, "x", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, table = language_id.fit(frame, RANKS, rounds=2)
    from pixeltide.llm.bpe import read_ranks

    vocabulary = sorted(t for t in read_ranks(RANKS) if not any(c < 0x61 or 0x7A < c < 0x80 for c in t))

    def every(word):
        return [[word[:k], *rest] for k in range(1, len(word) + 1) if word[:k] in models[0] for rest in (every(word[k:]) if k < len(word) else [[]])]

    models = [dict.fromkeys(vocabulary, 1 / len(vocabulary)) for _ in names]
    counts = [[w.encode() for _, t, l in rows if l == name and t for w in language_id.words_of(t)] for name in names]
    weigh = lambda cut, p: np.prod([p[x] for x in cut])
    for _ in range(2):
        for k, words in enumerate(counts):
            total = dict.fromkeys(vocabulary, 0.0)
            for w in words:
                cuts = every(w)
                whole = sum(weigh(c, models[k]) for c in cuts)
                for c in cuts:
                    for x in c:
                        total[x] += weigh(c, models[k]) / whole
            sums = sum(total.values())
            models[k] = {x: (v / sums + language_id.FLOOR) / (1 + language_id.FLOOR * len(vocabulary)) for x, v in total.items()}
    texts = ["the der cat", "hund", "mat", "katze the", "the the der der"]
    more = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, score int, lang_pred string")
    for r in language_id.predict(more, names, table, RANKS).collect():
        logs = [sum(np.log(sum(weigh(c, p) for c in every(w.encode()))) for w in texts[r.doc_id].split()) for p in models]
        best = int(np.argmax(logs))
        assert r.lang_pred == names[best] and r.score == pytest.approx(1 / sum(np.exp(x - logs[best]) for x in logs), rel=1e-6)
    assert language_id.predict(more.limit(0), names, table, RANKS).count() == 0


def test_small_languages_keep_their_words(spark):
    rows = [(i, " ".join(f"w{chr(97 + i % 26)}{chr(97 + j % 26)}" for j in range(50)), "en") for i in range(60)] + [(99, "zyx zyx", "zz")]
    names, _ = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), RANKS, rounds=1)
    assert names == ["en", "zz"]


def test_decontamination_finds_changed_numbers_units_and_names(spark):
    item = "Tom has 3 apples and buys 4 kg more at the store in Paris, how many apples does Tom have now?"
    hit = "Well then. Anna has 12 apples and buys 1,200.5 lbs more at the store in Rome, how many apples does Anna have now? Yes."
    mixed = "Bob has 3 apples and Tom buys 3 kg more at a store near Rome and how many pears does Tim have now?"
    docs = H.frame(spark, [(1, hit), (2, item.lower()), (3, mixed), (4, None), (5, ""), (None, item), (7, item), (7, item), (8, item.upper()), (9, "x\nToo short!\ny"), (10, "it is too short for that"), (11, "Well " * 30000 + item)])
    bench = spark.createDataFrame([(70, item), (71, "too short"), (72, None), (73, "a b c d e"), (74, ""), (70, item)], "item_id long, text string")
    twice = [(i, 70) for i in (1, 2, None, 7, 7, 8, 11)] * 2 + [(9, 71)]
    for block in (1 << 20, 1):  # sent to the executors, and joined
        got = [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, block=block).collect()]
        assert sorted(got, key=str) == sorted(twice, key=str), block
        kept = decontaminate.clean(docs, bench, block=block)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 10]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 == decontaminate.leaks(docs.limit(0), bench).count()


def test_slots_must_be_consistent():
    table = decontaminate.Table(["from 3 take 3 then add 5 to what is left over of the pile"])
    for text, found in (("from 8 take 8 then add 2 to what is left over of the pile", 1), ("from 8 take 9 then add 2 to what is left over of the pile", 0)):
        assert len(table.leaks([text], 0.9, 14)) == found


def test_tables_of_numbers_match_themselves_only():
    table = decontaminate.Table(["2, 4, 8, 16, 32, 64, 128, 256, 512, 1024: which number comes next?", "17 93 11 54 2 8 33 21 60 71"])
    texts = ["Sales by day 17 93 11 54 3 8 33 22 60 71 18 94 12 55 4 9 34 23 61 72", "x 17 93 11 54 2 8 33 21 60 71 y", "1, 3, 9, 27, 81, 243, 729, 2187, 6561: which number comes next?"]
    assert {(d, i) for d, i, *_ in table.leaks(texts)} == {(1, 1)}


def test_a_long_part_of_a_longer_item_is_a_leak():
    words = [f"w{i}" for i in range(200)]
    table = decontaminate.Table([" ".join(words)])
    assert [m[4] for m in table.leaks(["so " + " ".join(words[90:103]) + " it"])] == [13]
    assert not table.leaks(["so " + " ".join(words[90:102]) + " it"])


def test_case_and_names_that_open_sentences_hide_no_leak():
    items = [
        "Tom has 3 apples and buys 4 kg more at the café near Österby in Paris, how many apples does Tom have now?",
        "Tom has 3 red apples. Tom buys 4 more apples. Tom eats 2 of them. How many apples are left?",
    ]
    texts = [t for i in items for t in (i.lower(), i.upper())] + [items[1].replace("Tom", "Anna").replace("3", "7")]
    texts += ["ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE", "tom has 5 red apples. tom buys 6 more apples. tom eats 1 of them. how many apples are left?"]
    got = decontaminate.Table(items).leaks(texts)
    assert {(d, i) for d, i, *_ in got} == {(0, 0), (1, 0), (2, 1), (3, 1), (4, 1), (6, 1)}


def test_windows_against_brute_force():
    """The literal template of a text, by another way: equal windows have equal hashes, and others have not."""
    import re

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["red", "blue", "has", "of", "3", "4", "5 kg", "7 lbs"]) for _ in range(40)) for _ in range(30)]
    own = decontaminate.Template(texts, "lower")
    at, h = own.windows(8)
    units, seen = set(decontaminate.UNITS), {}
    for p, key in zip(at.tolist(), h.tolist(), strict=True):
        d = int(own.doc[p])
        tokens = re.findall(r"[a-z0-9]+", texts[d])
        a = p - int(own.first[d])
        kinds = [(2 if w.isdigit() else 1 if a + i and tokens[a + i - 1].isdigit() and w in units else 0, w) for i, w in enumerate(tokens[a : a + 8])]
        values: dict = {}
        words = sum(k == 0 for k, _ in kinds)
        form = tuple((k, w if k == 0 else values.setdefault(w, len(values))) for k, w in kinds) if words >= 3 else ("raw", *tokens[a : a + 8])
        assert seen.setdefault(form, key) == key
    assert len(set(seen.values())) == len(seen)


def test_decontamination_against_containment(spark):
    must = duckdb.sql(f"SELECT DISTINCT d.doc_id, b.item_id FROM '{SF}/documents.parquet' d JOIN '{SF}/benchmark.parquet' b ON contains(d.text, b.text)").fetchall()
    got = {(r.doc_id, r.item_id) for r in queries.op6_decontaminate(spark, SF).collect()}
    assert set(must) <= got and len(got) <= len(must) + 2


def test_compact_windows_cover_every_subsequence_once():
    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n)) for n in (0, 3, 20, 60, 120)]
    rows = pa.table({"unit": pa.array([0] * 5, pa.int32()), "doc_id": pa.array(range(5), pa.int64()), "text": texts})
    seq, length = substring_dedup.Sequences(rows, 2), 7
    value, got = mix(seq.hash, 100), {}
    for left, c, right, _ in zip(*(x.tolist() for x in substring_dedup.compact_windows(seq, length, 0)), strict=True):
        for x in range(left, c + 1):
            for y in range(max(c, x + length - 1), right + 1):
                assert (x, y) not in got
                got[x, y] = c
    want = {}
    for d in range(5):
        a, b = int(seq.first[d]), int(seq.first[d] + seq.n[d])
        want |= {(x, y): x + int(value[x : y + 1].argmin()) for x in range(a, b) for y in range(x + length - 1, b)}
    assert got == want


@pytest.mark.parametrize(("unit_bytes", "fan"), [(8 << 20, 128), (9000, 128), (3000, 2)])
def test_repeated_passages(spark, unit_bytes, fan):
    rows = H.awkward()
    first, must = {}, {}
    for i, t in H.order(rows):
        w = H.words(t)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                must.setdefault(i, set()).update(range(k, k + 50))
    got = {H.NO_ID if r.doc_id is None else r.doc_id: r for r in substring_dedup.dedup(H.frame(spark, rows), unit_bytes=unit_bytes, fan=fan).collect()}
    assert len(got) == len({r[0] for r in rows})
    for i, covered in must.items():
        assert got[i].n_passages > 0 and got[i].n_repeated_words >= 0.8 * len(covered), i
    assert all(got[i].n_passages == 0 for i in (0, 5, 80, 81, 83, 90))
    assert {got[60 + i].component_id for i in range(6)} == {60}
    assert substring_dedup.dedup(H.frame(spark, [])).count() == 0


@pytest.mark.parametrize("unit_bytes", [8 << 20, 9000])
@pytest.mark.parametrize(("words", "edits"), [(100, 0), (100, 1), (100, 2), (60, 1), (150, 4), (300, 8), (300, 3), (100, 3)])
def test_near_passages_against_brute_force(spark, words, edits, unit_bytes):
    """Of planted passages with a similarity of 0.75 or more nine in ten are found at least, and others are not."""
    rng, rows, near = random.Random(words + edits), [], 0
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for k in range(60):
        passage = text(words)
        copy = list(passage)
        for at in rng.sample(range(words), edits):
            copy[at] = f"x{rng.randrange(10**6)}"
        a, b = (H.shingle_set(" ".join(p)) for p in (passage, copy))
        rows += [(10 * k, " ".join(text(70) + passage + text(60)), 100 * len(a & b) >= 75 * len(a | b)), (10 * k + 1, " ".join(text(30) + copy + text(80)), None)]
        rows += [(10 * k + 2, " ".join(text(200)), None)]
    got = {r.doc_id: r for r in substring_dedup.dedup(H.frame(spark, [r[:2] for r in rows]), unit_bytes=unit_bytes).collect()}
    near = [i for i, _, n in rows if n]
    linked = [i for i in near if got[i + 1].component_id == i]
    assert len(linked) >= 0.9 * len(near), (len(linked), len(near))
    assert all(got[10 * k + 2].n_passages == 0 == got[10 * k].n_passages for k in range(60))


@pytest.mark.parametrize("unit_bytes", [8 << 20, 9000])
def test_passages_whose_parts_earlier_documents_hold(spark, unit_bytes):
    rng, rows, whole = random.Random(6), [], []
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for k in range(30):
        passage = text(60 if k % 2 else 50)
        for i in range(10):
            n = 30 if i < 5 else 20
            cut = rng.randrange(len(passage) - n + 1)
            rows.append((100 * k + i, " ".join(text(40) + passage[cut : cut + n] + text(40))))
        for i in (50, 51):
            rows.append((100 * k + i, " ".join(text(30) + passage + text(30))))
        whole.append((100 * k + 51, 100 * k + 50, len(passage)))
    got = {r.doc_id: r for r in substring_dedup.dedup(H.frame(spark, rows), unit_bytes=unit_bytes).collect()}
    assert [(i, got[i].first_source, got[i].n_repeated_words >= n) for i, _, n in whole] == [(i, s, True) for i, s, _ in whole]
    assert sum(r.n_passages > 0 for r in got.values()) == len(whole)


def test_language_model_beats_its_base(spark):
    out = [r for r in queries.op8_lm_score(spark, SF).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_weak_labels_tell_the_classes_apart():
    truth, rng = {}, np.random.default_rng(3)
    for _ in range(20_000):
        bad = rng.random() < 0.2
        votes = [(2 if rng.random() < 0.5 else 1) if bad else (2 if rng.random() < 0.002 else 1) for _ in range(5)]
        code = sum(v * 3**i for i, v in enumerate(votes))
        truth.setdefault(code, []).append(bad)
    posterior, theta = quality_classifier.estimate({k: len(v) for k, v in truth.items()})
    right = sum(sum(v) if posterior[k] > 0.5 else len(v) - sum(v) for k, v in truth.items())
    assert right > 0.97 * 20_000 and theta.shape == (5, 2, 3)
    assert quality_classifier.estimate({})[0] == {}


def test_known_qualities_take_the_place_of_beliefs():
    """Kinds of bad text that do not overlap: a tenth of known qualities is enough, by plain counting too."""
    rng, counts, known = np.random.default_rng(4), {}, {}
    rates = {}
    for _ in range(30_000):
        kind = rng.integers(0, 5) if rng.random() < 0.15 else None
        votes = [2 if kind == j and rng.random() < 0.9 else 2 if rng.random() < 0.01 else 1 for j in range(5)]
        code = sum(v * 3**i for i, v in enumerate(votes))
        counts[code] = counts.get(code, 0) + 1
        if rng.random() < 0.1:
            known[code, int(kind is not None)] = known.get((code, int(kind is not None)), 0) + 1
        rates.setdefault(code, []).append(kind is not None)
    posterior, theta = quality_classifier.estimate(counts, known)
    for code, truth in rates.items():
        if len(truth) > 300:
            assert (posterior[code] > 0.5) == (np.mean(truth) > 0.5), code
    assert np.allclose(theta[:, 0, 2], 0.01, atol=0.01) and np.allclose(theta.sum(2), 1)


def test_scores_against_brute_force(spark):
    """The query's scores again, from its models, text by text."""
    import math

    from pixeltide.llm.exchange import Unit
    from pixeltide.llm.shingles import words

    import pyarrow as pa

    rows = [(1, "good words here"), (2, "Good WORDS words"), (None, "x"), (4, None), (4, "")]
    rng = np.random.default_rng(0)
    models = {n: (rng.normal(size=1 << quality_classifier.BITS).astype(np.float32), rng.normal(size=15), 0.3) for n in ("a", "b")}
    df = spark.createDataFrame([(i, t, 1 + 3 + 9 + 27 + 81) for i, t in rows], "doc_id long, text string, pattern int")
    got = [(r.doc_id, r.a, r.b) for r in quality_classifier._apply(df, models).collect()]
    want = []
    for i, t in rows:
        _, _, word, _ = words(Unit(pa.table({"doc_id": [0], "text": [t or ""]})))
        cells = {int(w) >> (64 - quality_classifier.BITS) for w in word}
        score = lambda w, v, b: 1 / (1 + math.exp(-(b + sum(v[3 * k + 1] for k in range(5)) + sum(float(w[c]) for c in cells) / math.sqrt(len(cells))))) if cells else 0.0
        want.append((i, *(score(*m) for m in models.values())))
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1:] for g in got], [w[1:] for w in want], atol=1e-5)


def test_samples_are_whole_documents(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(3000 * (i + 1))), 1, 0.5) for i in range(4)], "doc_id long, text string, pattern int, target double")
    assert sorted(map(len, quality_classifier._sample(df)[0]))[-1] > 11_000
    few = quality_classifier._sample(df, 10)
    assert len(few[0]) == 1 and len(few[0][0]) > 2900


def test_quality_classifier(spark):
    labels = {i: (q, t) for i, q, t in duckdb.sql(f"SELECT * FROM '{SF}/labels.parquet'").fetchall()}
    got = {r.doc_id: r for r in queries.op9_quality_classifier(spark, SF).collect()}
    clean = [i for i, (q, t) in labels.items() if q and not t]
    low = [i for i, (q, _) in labels.items() if not q]
    assert sum(got[i].kept for i in clean) >= 0.97 * len(clean)
    assert sum(not got[i].kept for i in low) >= 0.9 * len(low)


def test_quality_classifier_edge_cases(spark):
    df = H.frame(spark, [(1, None), (2, ""), (None, "some words here"), (4, "W! " * 80), (4, "W! " * 80)])
    got = quality_classifier.classify(df).collect()
    assert len(got) == 5 and all(r.kept for r in got if r.doc_id in (1, 2))
    assert quality_classifier.classify(df.limit(0)).count() == 0


def test_silent_model_scores_nothing():
    assert lm_score.Model().log10(np.zeros((1, 5), int), np.zeros((1, 4), int), np.array([0]))[0] == pytest.approx(-2 * np.log10(16))
