"""The registered form of each operator: ``QUERIES[name](spark, folder of the tables)`` and, where SQL says it, ``SQL[name]``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, mtree, pieces, pseudonyms, quality, repeats, rollups, toxicity, warc
from .labels import is_fold
from .work import for_texts, shared_dir, table, written


def op6_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found).drop("longest")

#: The folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonyms.pseudonymise(docs, counts="replaced")
    counts = [F.coalesce(F.col("replaced")[k], F.lit(0)).alias(f"n_{k}") for k in ("card", "phone", "ssn", "date", "ip", "email")]
    return out.select("doc_id", *counts, "text")


def op2_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index = written(mtree.build(vectors), "mtree")
    return mtree.search(index, vectors.where("vec_id % 50 = 0"), 5)


def _classified(scored: DataFrame, folds: int, held_out: int, threshold: float) -> DataFrame:
    return scored.select("doc_id", is_fold(F.col("doc_id"), folds, held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return _classified(scored, quality.FOLDS, quality.HELD_OUT, quality.THRESHOLD)


def op5_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return _classified(scored, toxicity.FOLDS, toxicity.HELD_OUT, toxicity.THRESHOLD)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.clusters(table(spark, sf_dir, "documents")).drop("row")


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op9_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: all documents; those not in English counted anew, with a vocabulary of many languages; exact copies deleted.
    The second is sent twice."""
    docs = table(spark, sf_dir, "documents")
    rollup = rollups.Rollup(spark, f"{shared_dir(spark)}/tidemark/rollup-{uuid.uuid4().hex}")
    rollup.apply("1-all", inserts=rollups.token_counts(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "byte_bpe_50k"))
    for _ in range(2):
        rollup.apply("2-recount", revisions=rollups.token_counts(docs.where("lang <> 'en'"), f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", "byte_bpe_multi_50k"))
    rollup.apply("3-copies", deletes=rollups.exact_copies(docs))
    return rollup.totals()


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    source = F.col("headers")
    return records.select(
        "page_id",
        "warc_type",
        "record_id",
        "refers_to",
        "target_uri",
        "content_type",
        "content_length",
        "block_digest",
        source["WARC-Source-Content-Type"].alias("source_content_type"),
        source["WARC-Source-Payload-Digest"].alias("source_payload_digest"),
        F.col("block").cast("string").alias("text"),
    )


def _registered(*found: Callable[[SparkSession, str], DataFrame]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: (lambda spark, sf_dir, f=f: f(for_texts(spark), sf_dir)) for f in found}


QUERIES = _registered(
    op1_feistel_pseudonyms,
    op2_suffix_tree_dedup,
    op3_mtree_topk,
    op4_factorisation_machine,
    op5_kneser_ney_toxicity,
    op6_suffix_decontamination,
    op7_ngram_jaccard,
    op8_sampled_pieces,
    op9_token_rollups,
    op10_warc_derivatives,
)

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op2_suffix_tree_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 19], ' ')) AS h FROM d, unnest(range(1, len(w) - 18)) AS r(i) WHERE len(w) >= 20),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p FROM later, unnest(range(i, i + 20)) AS r(p)),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN lost ON lost.doc_id = d.doc_id""",
    "op3_mtree_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_suffix_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
       FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, ns, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id""",
    "op7_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id""",
}
