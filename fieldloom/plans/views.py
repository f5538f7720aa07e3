"""Canonical views over the supplied tables, through which the operators are driven."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import read_table


def occurrence_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as occurrence records; depth_m, year and seq come along."""
    t = lambda n: read_table(spark, sf_dir, n)
    joined = (
        t("lineitem")
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    kind = F.when(F.col("l_returnflag") == "A", "Primary").when(F.col("l_returnflag") == "R", "Secondary").otherwise("Uncertain")
    return joined.select(
        F.concat_ws(" ", "p_name", "p_partkey").alias("validName"),
        F.col("p_name").alias("recordedName"),
        F.col("r_name").alias("phylum"),
        F.col("p_brand").alias("family_"),
        F.col("p_type").alias("order_"),
        F.col("n_name").alias("verbatimLocality"),
        kind.alias("occurrenceType"),
        F.concat(F.lit("doc "), F.col("l_orderkey").cast("string")).alias("sourceCitation"),
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").alias("evidence"),
        F.col("l_quantity").alias("depth_m"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.year("l_shipdate").alias("year"),
        F.col("l_shipdate").alias("event_time"),
        F.col("l_suppkey").alias("collector"),
        F.col("l_partkey").alias("part"),
    )


#: The same view for DuckDB.
OCCURRENCE_SQL = """
    occ AS (
        SELECT p_name || ' ' || p_partkey AS validName, p_name AS recordedName, r_name AS phylum, p_brand AS family_,
               p_type AS order_, n_name AS verbatimLocality,
               CASE l_returnflag WHEN 'A' THEN 'Primary' WHEN 'R' THEN 'Secondary' ELSE 'Uncertain' END AS occurrenceType,
               'doc ' || l_orderkey AS sourceCitation, l_orderkey AS doc_id, l_linenumber AS line, l_extendedprice AS evidence,
               l_quantity AS depth_m, l_discount AS discount, l_tax AS tax, year(l_shipdate)::INTEGER AS year, l_shipdate AS event_time,
               l_suppkey AS collector, l_partkey AS part
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
#: Columns that put all records in one order.
SEQ = ["doc_id", "line", "part", "collector", "evidence", "depth_m", "discount", "tax", "event_time"]
SEQ_SQL = ", ".join(SEQ)
