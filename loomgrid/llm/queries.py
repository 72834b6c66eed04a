"""Queries of the training-text problems (top items, encoding, packing, quality) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.encode import decode_corpus, encode_corpus
from loomgrid.llm.packing import pack_tokens
from loomgrid.llm.quality import natural_prose, quality
from loomgrid.llm.topn import latest_items, top_n_per_group
from loomgrid.sources.tables import spread_scan, table

ITEM = ["experiment_name", "run_name", "source_name"]
CAPACITY = 2048


# 2 Top N items within every group
def ranked_items(spark: SparkSession, folder: str, n: int) -> DataFrame:
    rows = table(spark, folder, "posterior_predictive_summary").drop("rank_in_experiment", "is_best")
    items = latest_items(rows, ITEM, ["written_at", "row_id"], ["row_id", "mean_abs_zscore", "max_abs_zscore"])
    return top_n_per_group(
        items, "experiment_name", ["mean_abs_zscore", "max_abs_zscore"], ["run_name", "source_name"], n, "rank_in_experiment"
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_items(spark, folder, 3).select("experiment_name", "rank_in_experiment", "row_id")


def p2_best(spark: SparkSession, folder: str) -> DataFrame:
    """The best item of every experiment, newly determined, with its figures."""
    best = ranked_items(spark, folder, 1).withColumn("is_best", F.col("rank_in_experiment") == 1)
    return best.select(*ITEM, "row_id", "mean_abs_zscore", "rank_in_experiment", "is_best")


P2_SQL = """
WITH items AS (
   SELECT * FROM posterior_predictive_summary
   QUALIFY row_number() OVER (PARTITION BY experiment_name, run_name, source_name ORDER BY written_at DESC NULLS LAST, row_id DESC NULLS LAST) = 1),
 clean AS (
   SELECT *, CASE WHEN isfinite(mean_abs_zscore) THEN mean_abs_zscore END AS s1, CASE WHEN isfinite(max_abs_zscore) THEN max_abs_zscore END AS s2 FROM items),
 ranked AS (
   SELECT *, CAST(row_number() OVER (PARTITION BY experiment_name ORDER BY s1 ASC NULLS LAST, s2 ASC NULLS LAST, run_name ASC NULLS FIRST, source_name ASC NULLS FIRST) AS INTEGER) AS r FROM clean)
"""


# 6 Token ids of every document
def texts(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, dealt to all cores where the scan has few splits."""
    return spread_scan(table(spark, folder, "documents").select("doc_id", "text", "lang"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(texts(spark, folder), "doc_id", "text")


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The digest of every text after encoding and decoding."""
    decoded = decode_corpus(p6_ids(spark, folder), "doc_id", "ids")
    return decoded.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


# 7 Texts in containers of 2,048 tokens
def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack_tokens(table(spark, folder, "documents"), "doc_id", "text", CAPACITY)


def p7_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every placed document: whether its pieces follow each other without a gap, with all its tokens, and whether it lies in one container or
    in as many as it must; and whether none of its containers holds more than the capacity."""
    rows = p7_packed(spark, folder)
    fill = rows.groupBy("container").agg(F.sum("n_tokens").alias("fill"), F.max(F.col("container_offset") + F.col("n_tokens")).alias("end"))
    sizes = p6_ids(spark, folder).select("doc_id", F.size("ids").alias("size"))
    each = rows.join(fill, "container").groupBy("doc_id").agg(
        F.sum("n_tokens").alias("tokens"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("container").alias("containers"),
        F.max("fill").alias("fullest"), F.max(F.greatest("fill", F.col("end"))).alias("farthest"),
    )
    each = each.join(sizes, "doc_id")
    whole = (F.col("tokens") == F.col("size")) & (F.col("end") == F.col("size")) & (F.col("pieces") == F.col("containers")) & (F.col("pieces") == F.ceil(F.col("size") / CAPACITY))
    return each.select("doc_id", whole.alias("whole"), ((F.col("fullest") <= CAPACITY) & (F.col("farthest") <= CAPACITY)).alias("fits"))


# 8 Text quality
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "common_words")
    return natural_prose(texts(spark, folder), "doc_id", "text", "lang", words, "word", word_lang="lang").select("doc_id")


def p8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality(texts(spark, folder), "doc_id", "text", "lang", table(spark, folder, "common_words"), "word", word_lang="lang")


QUERIES = {
    "p2_found": p2_found,
    "p2_best": p2_best,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_packed": p7_packed,
    "p7_documents": p7_documents,
    "p8_found": p8_found,
    "p8_quality": p8_quality,
}

ORACLES = {
    "p2_found": P2_SQL + "SELECT experiment_name, r AS rank_in_experiment, row_id FROM ranked WHERE r <= 3",
    "p2_best": P2_SQL + "SELECT experiment_name, run_name, source_name, row_id, mean_abs_zscore, r AS rank_in_experiment, true AS is_best FROM ranked WHERE r = 1",
    "p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p7_documents": "SELECT doc_id, true AS whole, true AS fits FROM documents WHERE text <> ''",
}
