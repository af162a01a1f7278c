"""The registered queries on the smallest tables: against their SQL, and the pipeline against its stages' brute-force versions."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_clusters, brute_contamination

import corpus_pipeline
from tidemark.llm import pieces, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("name", [x for x in queries.QUERIES if x not in queries.SQL])
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    n = df.count()
    tables = {"op9": None, "op10": 2 * spark.read.parquet(f"{DATA}/pages.parquet").count()}
    expected = tables.get(name.split("_")[0], spark.read.parquet(f"{DATA}/documents.parquet").count())
    assert n == expected if expected is not None else n > 0


def test_near_duplicates_of_many_copies(spark):
    """Thousands of copies of texts of four and five shingles, four of them shared: one document of each group stays."""
    texts = []
    for g in range(8):
        short = " ".join(f"w{g}x{i}" for i in range(8))
        texts += [short, f"{short} w{g}x8"] * 3000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert sorted(x.doc_id for x in kept.collect()) == [6000 * g for g in range(8)]


def test_sampled_pieces_are_the_operators(spark):
    """The query gives the ids and the decoded texts themselves, those of the operators, for every document."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {r.doc_id: r.piece_ids for r in pieces.encode(docs).collect()}
    found = queries.QUERIES["op8_sampled_pieces"](spark, DATA).collect()
    assert {r.doc_id: r.piece_ids for r in found} == ids and len(found) == len(ids)
    assert {r.doc_id: r.decoded for r in found} == {r.doc_id: r.text for r in docs.collect()}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        steps.append((name, docs, out))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    _, before, after = steps[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert ids(after) == {i for i, _, c in brute_clusters(rows, 5, 80) if i == c}
    _, before, after = steps[2]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids(after) == {x[0] for x in brute_contamination([(r.doc_id, r.text) for r in before.collect()], items) if not x[5]}
    _, before, after = steps[3]
    assert ids(before) == ids(after) and after.where(F.col("n_chars") != F.length("text")).count() == before.where(F.col("n_chars") != F.length("text")).count()
    final = steps[4][2]
    assert ids(final) == ids(after) and final.where("n_pieces <> size(piece_ids)").count() == 0
    assert ids(corpus_pipeline.run(spark, DATA)) == ids(final)
