"""The record table that every analytic operator works on, as a view over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The canonical analytic record.
RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType(), False),
        T.StructField("product_id", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("brand", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("rating", T.DoubleType(), False),
        T.StructField("helpful_votes", T.LongType(), False),
        T.StructField("verified_purchase", T.BooleanType(), False),
        T.StructField("event_time", T.TimestampType(), False),
        T.StructField("price", T.DoubleType(), True),
    ]
)

#: The same view as SQL text that Spark and other engines read alike.
RECORDS_SQL = """
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
                 CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS BIGINT) AS STRING)) AS record_id,
       CAST(p_partkey AS STRING) AS product_id, p_type AS category, p_brand AS brand, p_name AS title,
       CAST(1.0 + (CAST(l_quantity AS INT) % 9) * 0.5 AS DOUBLE) AS rating,
       CAST(l_linenumber - 1 AS BIGINT) AS helpful_votes, l_returnflag <> 'R' AS verified_purchase,
       l_shipdate AS event_time, CASE WHEN l_suppkey % 10 < 3 THEN NULL ELSE CAST(p_retailprice AS DOUBLE) END AS price
FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from lineitem and part. Part is the smaller side; Spark broadcasts it only while it is small."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = line.join(part, line.l_partkey == part.p_partkey)
    ident = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return rows.select(
        F.concat_ws("-", *ident, F.col("l_quantity").cast("bigint").cast("string")).alias("record_id"),
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("title"),
        (F.lit(1.0) + (F.col("l_quantity").cast("int") % 9) * F.lit(0.5)).alias("rating"),
        (F.col("l_linenumber") - 1).cast("bigint").alias("helpful_votes"),
        (F.col("l_returnflag") != "R").alias("verified_purchase"),
        F.col("l_shipdate").alias("event_time"),
        F.when(F.col("l_suppkey") % 10 >= 3, F.col("p_retailprice").cast("double")).alias("price"),
    )
