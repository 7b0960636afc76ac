"""The pipeline against brute-force versions of its stages."""

import shutil

import duckdb
import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
import helpers as H
from pixeltide.llm import bpe, queries

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {i for i, k in con.execute(f"SELECT doc_id, kept FROM ({queries.OP4_SQL})").fetchall() if k}
    rows = {i: t for i, t in rows.items() if i in kept}
    rows = {i: rows[i] for i, _, c in H.components(list(rows.items())) if i == c}
    rows = {i: k.decode("utf-8", "ignore") for i, _, k in H.removed(list(rows.items()))}
    rows = {i: t for i, t in rows.items() if t.strip()}
    bench = [b for (b,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    rows = {i: t for i, t in rows.items() if not any(b in t for b in bench)}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(rows)
    for i, t in rows.items():
        assert got[i].exact and np.frombuffer(got[i].ids, "<u4").tolist() == coder.encode_ordinary(t)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    shutil.rmtree(tmp_path)


def test_empty_documents_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{SF}/benchmark.parquet", tmp_path / "benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_rows(spark, tmp_path):
    """Nulls, repeated rows, shared ids, very long texts and clashing columns, stage after stage."""
    base = " ".join(f"word{i}" for i in range(80))
    long = " ".join(f"l{i}" for i in range(60_000))
    rows = [(1, base), (2, base), (None, base), (3, base + " end"), (3, " ".join(f"other{i}" for i in range(70))), (4, None), (5, ""), (6, long), (6, long)]
    rows += [(None, " ".join(f"null{i}" for i in range(70)))] * 3 + [(7, " ".join(f"short{i}" for i in range(70)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "length(text) n_chars", "1 unit", "2 kept", "'x' ids")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{SF}/benchmark.parquet", tmp_path / "benchmark.parquet")
    docs = corpus_pipeline.quality(spark, frame, SF)
    docs = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert docs.columns == frame.columns
    kept = sorted(((r.doc_id, r.text[:5]) for r in docs.collect()), key=str)
    assert kept == sorted([(1, "word0"), (6, "l0 l1"), (7, "short"), (None, "null0")], key=str)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([1, 6, 7, None], key=str) and all(r.exact for r in got)
    plain = frame.select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain, SF).count() == 0
