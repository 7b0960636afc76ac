"""Operators with exact contracts, against brute force."""

import hashlib
import math
import pathlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from pyspark.sql import functions as F

import compare
import helpers as H
from pixeltide.llm import bpe, chat_format, components, jaccard_join, lm_score, quality_rules, queries, shared, suffix_dedup
from pixeltide.llm import exchange as X
from pixeltide.llm.language_id import held_out

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library(coder):
    rng = random.Random(2)
    texts = [t or "" for _, t in H.awkward()]
    texts += ["日本語テキスト" * 60, "".join(rng.choice("abc") for _ in range(3000)), "x" * 257, "🙂🙃" * 40, "<|endoftext|>", "it's 12,345.67!!", "  \n\n  a  "]
    texts += ["".join(chr(rng.randrange(32, 0x2000)) for _ in range(500))]
    own = bpe.Codec(RANKS, P.PATTERN)
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == coder.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_rows_of_any_length(coder):
    own, rng = bpe.Codec(RANKS, P.PATTERN), random.Random(4)
    pieces = ["".join(rng.choice(letters) for _ in range(n)) for n in (2, 9, 33, 120, 250, 255, 256, 257, 600, 5000) for letters in ("thea nio", "ab", "a", "abcdefghijklmnopqrstuvwxyzäöü", "日本語テキスト")]
    for piece, ids in zip(pieces, own.encode_pieces([p.encode() for p in pieces]), strict=True):
        want = coder.encode_single_piece(piece.encode()) if hasattr(coder, "encode_single_piece") else coder._encode_single_piece(piece)
        assert np.frombuffer(ids, "<u4").tolist() == want
        if piece.encode() not in own.ranks:
            assert own._row(piece.encode()).tolist() == want
    long = "x" * 200_000 + "".join(rng.choice("abcdefghij") for _ in range(100_000))
    assert np.frombuffer(own.encode_all([long])[0], "<u4").tolist() == coder.encode_ordinary(long)


def test_bpe_query(spark, coder):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    for r in queries.op1_bpe(spark, SF).collect():
        ids = coder.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_bpe_frames(spark):
    df = H.frame(spark, [(1, "a b"), (None, None)])
    ids = bpe.encode(df, RANKS, P.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, RANKS, P.PATTERN).collect()} == {1: b"a b", None: b""}
    assert bpe.round_trip(df.limit(0), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize(("per_salt", "unit_bytes", "fan"), [(50_000, 8 << 20, 128), (2, 8 << 20, 128), (50_000, 9000, 128), (2, 3000, 2)])
def test_suffix_dedup(spark, per_salt, unit_bytes, fan):
    rows = H.awkward()
    got = suffix_dedup.dedup(H.frame(spark, rows), per_salt=per_salt, unit_bytes=unit_bytes, fan=fan, carry=("lang", "kind")).collect()
    assert sorted((H.NO_ID if r.doc_id is None else r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == H.removed(rows)
    assert all(r.n_bytes - len(r.kept) == sum(s["to"] - s["from"] for s in r.spans) for r in got)
    assert all(r.carried.lang == "en" and r.carried.kind == 2 for r in got)


def _sent_by_units(texts, per_salt=50_000):
    """Byte strings that units of one text each send to be expanded, one after the other."""
    S = suffix_dedup
    units = [pa.table({"unit": [k], "doc_id": [k], "text": [t]}) for k, t in enumerate(texts)]
    to = lambda said, k: said.filter(pc.equal(said["sender"], k))
    said = X.answer(pa.concat_tables([S._ask_anchors(u, 50, 1) for u in units]), S._ANCHORS)
    held = X.answer(pa.concat_tables([S._ask_holders(u, to(said, k), 50, 1, per_salt) for k, u in enumerate(units)]), S._holder_talk(per_salt))
    both = pa.concat_tables([t.append_column("kind", pa.array([k] * t.num_rows, pa.int32())) for k, t in enumerate((said, held))])
    blobs = [S._ask_contexts(u, to(both, k), 50, 1, per_salt)["blob"].to_pylist() for k, u in enumerate(units)]
    return [[t for b in own for t in X.Facts.unpack(b, 56, S._SMALLEST, True).texts] for own in blobs]


def test_repeated_text_travels_once():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage = text(3000)
    sent = _sent_by_units([text(200) + passage + text(200) for _ in range(8)] + [passage] * 4)
    every = [t for own in sent for t in own]
    assert len(every) == len(set(every))  # each unit sent all of the passage once
    # beyond the first holder a unit sends what stands at the passage's ends
    assert all(sum(map(len, own)) < 1000 for own in sent[1:9]) and not any(sent[9:])


def test_texts_that_share_only_word_pairs_by_chance_send_little():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(50)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(30)]
    sent = sum(len(t) for own in _sent_by_units(texts) for t in own)
    assert sent < 0.5 * sum(map(len, texts))  # 16-grams, nearly all shared, made it several times the texts


def test_contexts_of_a_common_anchor_are_dealt_in_small_groups():
    S, rng, per_salt = suffix_dedup, random.Random(5), 100
    text = lambda n: "".join(rng.choices("acgt", k=n))
    passage = text(200)
    texts = [text(60) + passage + text(60) for _ in range(400)]
    units = [pa.table({"unit": [k] * 200, "doc_id": range(200 * k, 200 * k + 200), "text": texts[200 * k :][:200]}) for k in range(2)]
    to = lambda said, k: said.filter(pc.equal(said["sender"], k))
    said = X.answer(pa.concat_tables([S._ask_anchors(u, 50, 1) for u in units]), S._ANCHORS)

    def groups(per_salt):
        held = X.answer(pa.concat_tables([S._ask_holders(u, to(said, k), 50, 1, per_salt) for k, u in enumerate(units)]), S._holder_talk(per_salt))
        both = pa.concat_tables([t.append_column("kind", pa.array([k] * t.num_rows, pa.int32())) for k, t in enumerate((said, held))])
        size = {}
        for k, u in enumerate(units):
            facts = S._Texts(u, to(both, k), 50, per_salt).facts
            for key, t in zip(facts.keys.tolist(), facts.texts, strict=True):
                size[key] = size.get(key, 0) + len(t)
        return size.values()

    whole, dealt = groups(50_000), groups(per_salt)
    assert max(whole) > 2 * per_salt * 50  # there are common anchors
    assert max(dealt) < per_salt * 50
    assert sum(dealt) < 5 * sum(whole)  # not a string for each window


def test_files_of_a_finished_pass_go(spark):
    folder = lambda: sum(p.stat().st_size for top in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for p in pathlib.Path(top.getPath()).rglob("shuffle_*.data"))
    shared.free_shuffles(spark)
    before = folder()
    shared.ensure_checkpoints(spark.range(1))
    kept = spark.range(200_000).selectExpr("sha2(string(id), 256) as x", "id % 7 as k").repartition(5, "k").groupBy("k").agg(F.count("x").alias("n")).checkpoint()
    assert folder() > before + 1_000_000
    shared.free_shuffles(spark)
    assert folder() < before + 100_000 and kept.count() == 7


def test_suffix_dedup_empty_table(spark):
    assert suffix_dedup.dedup(H.frame(spark, [])).count() == 0


def test_bounded_prefixes_against_sorting():
    rng = np.random.default_rng(3)
    for n, k in ((60, 2), (400, 3), (900, 200)):
        text = rng.integers(30, 30 + k, n, dtype=np.uint8)
        ring = text.tobytes() * 2
        if n * 2 < n + 20:
            continue
        keys = [ring[i : i + 20] for i in range(n)]
        at = suffix_dedup.order_to_depth(text, 20)
        ordered = [keys[i] for i in at.tolist()]
        assert ordered == sorted(keys)
        cut = suffix_dedup.bounded_prefixes(text, at, 20)
        assert cut.tolist() == [True] + [a != b for a, b in zip(ordered, ordered[1:], strict=False)]


def _jaccard(rows):
    """Rows as brute force sees them: a null id is a document of its own."""
    least = max((i for i, _ in rows if i is not None), default=0)
    own = [(i if i is not None else least + 1 + k, t) for k, (i, t) in enumerate(rows)]
    back = lambda v: None if v > least else v
    return sorted(((back(i), n, back(c)) for i, n, c in H.components(own)), key=str), least


@pytest.mark.parametrize(("unit_bytes", "fan", "tile"), [(8 << 20, 128, 2000), (9000, 128, 2), (3000, 2, 3)])
def test_jaccard_join(spark, unit_bytes, fan, tile):
    rows = [*H.awkward(), (96, H.awkward()[0][1]), (96, H.awkward()[41][1]), (None, H.awkward()[1][1]), (None, "no one else has these six words"), (None, "no one else has these six words")]
    got = jaccard_join.components(H.frame(spark, rows), unit_bytes=unit_bytes, fan=fan, tile=tile).collect()
    want, _ = _jaccard(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


@pytest.mark.parametrize("percent", [1, 10, 30, 50, 60, 67, 90, 100])
def test_jaccard_join_at_any_similarity(spark, percent):
    rng = random.Random(percent)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 13)))) for i in range(150)]
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((200 + i, " ".join(w[: rng.randrange(30, 61)])))
    got = jaccard_join.components(H.frame(spark, rows), percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == H.components(rows, percent)


def test_every_pair_of_a_block_meets_in_one_tile():
    rng = np.random.default_rng(0)
    name = rng.integers(-(1 << 62), 1 << 62, 50)
    key, held = np.full(50, 7, np.uint64), np.full(50, 50)
    of, at, side = jaccard_join.tiles(key, name, held, 8)
    met = {}
    for tile in np.unique(of):
        own = np.flatnonzero(of == tile)
        two = side[own].any()
        assert len(own) <= 3 * 16
        for x in own:
            for y in own:
                if at[x] < at[y] and (not two or side[x] != side[y]):
                    met[at[x], at[y]] = met.get((at[x], at[y]), 0) + 1
    assert len(met) == 50 * 49 // 2 and set(met.values()) == {1}


def test_jaccard_join_of_small_sets_and_empty_table(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 13)))) for i in range(300)]
    got = jaccard_join.components(H.frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == H.components(rows)
    assert jaccard_join.components(H.frame(spark, [])).count() == 0


def test_rows_that_share_an_id_are_one_node(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n o"), (2, "h i j k l m n o"), (3, "a b c d e f g"), (4, None)]
    got = jaccard_join.components(H.frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    for n, m in ((40, 30), (300, 280), (1000, 700)):
        a = rng.integers(0, 1 << 40, n, dtype=np.uint64)
        b = np.concatenate([a[:m], rng.integers(0, 1 << 40, 25, dtype=np.uint64)])
        bits = int(min(jaccard_join.sketch_bits(len(a)), jaccard_join.sketch_bits(len(b))))
        x, y = (jaccard_join.fold(jaccard_join.parity_sketch(v), bits) for v in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_messages_grow_far_less_than_with_the_square():
    from pixeltide.llm.exchange import Layout

    small, large = Layout.of(50 << 30), Layout.of(500 << 30)
    assert small.two_hops and not Layout.of(1 << 30).two_hops
    assert large.messages < 40 * small.messages  # ten times the data; by the square a hundred times
    assert small.messages < small.units * small.buckets / 8 and large.messages < large.units * large.buckets / 25


def test_components_of_stars_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "SMALL", 10)
    links = spark.range(3000).selectExpr("id + 10 as a", "5 as c").unionByName(spark.createDataFrame([(1, 5), (9000, 9001)], "a long, c long"))
    got = {r.node: r.component for r in components.connected(links).collect()}
    assert got == {i + 10: 1 for i in range(3000)} | {5: 1, 1: 1, 9000: 9000, 9001: 9000}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (7, 7)], "a long, c long")
    got = {r.node: r.component for r in components.connected(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_quality_rules_sql_on_awkward_rows(spark):
    rows = [(i, t) for i, (_, t) in enumerate(H.awkward())]
    led = quality_rules.apply_policy(quality_rules.ledger(H.frame(spark, rows)), quality_rules.POLICIES["strict-1"])
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words kept fail_bits n_lines n_upper".split()
    mine = sorted(tuple(r) for r in led.select(*names).collect())
    assert mine == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({queries.OP4_SQL})").fetchall())


def test_quality_policy_and_ablation(spark):
    df = H.frame(spark, [(1, "a " * 60), (2, "word " * 3), (3, "W X Y Z " * 2), (4, None)])
    strict = quality_rules.POLICIES["strict-1"]
    led = quality_rules.ledger(df)
    got = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablate(led, strict).collect()}
    bits = [r.fail_bits for r in led.collect()]
    for i, rule in enumerate(quality_rules.RULES):
        assert got[rule] == (sum(b >> i & 1 for b in bits), sum(b == 1 << i for b in bits))
    base = quality_rules.passing(df, quality_rules.Policy("none", ()))
    assert base.columns == df.columns and base.count() == 4
    assert quality_rules.passing(df, strict).count() == 0 == quality_rules.ledger(df.limit(0)).count()


def test_chat_format(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 1, None, None), (4, 0, "user", "q"), (5, 0, "assistant", "hi"), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as k", "2 as a")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat_format.render(df).collect()}
    assert set(got) == {1, 4, 5, None} and got[1][:2] == (2, 2)
    assert got[4][2] == "<|user|>\nq\n<|end|>\n<|unknown|>\n\n<|end|>\n"
    assert chat_format.render(df.limit(0)).count() == 0


@pytest.mark.parametrize(("unit_bytes", "fan"), [(20_000, 128), (4000, 2)])
def test_lm_base_scores(spark, unit_bytes, fan):
    rows = [r for r in H.awkward() if r[0] is not None]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    count = H.token_counts(rows, held)
    n, v = sum(count.values()), len(count)
    got = lm_score.score(H.frame(spark, rows), held_out(parts=5, part=1), unit_bytes=unit_bytes, fan=fan).collect()
    want = []
    for i, t in rows:
        w = [*H.words(t), "\0end"]
        want.append((i, held(i), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)))
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score <= 1e-9 for r in got)
    assert lm_score.score(H.frame(spark, []), held_out()).count() == 0


def test_lm_probabilities_add_up():
    model = lm_score.Model()
    rng = np.random.default_rng(0)
    cls = rng.integers(0, lm_score.CLASSES, 4000)
    rows, own = lm_score.features(cls, np.array([0]), np.array([4000]))
    before = model.log10(rows, own, cls).mean()
    for _ in range(5):
        model.step(rows, own, cls, 4.0)
    assert model.log10(rows, own, cls).mean() > before
    every = [10 ** model.log10(rows[:3], own[:3], np.full(3, c)) for c in range(lm_score.CLASSES)]
    assert np.allclose(np.sum(every, 0), 1, atol=1e-4)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_registered_sql(spark, name):
    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLE_SQL[name])
    assert compare.rows_of(df.columns, df.collect()) == compare.rows_of([c[0] for c in cursor.description], cursor.fetchall())
