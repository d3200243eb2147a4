"""Tables bucketed by a key, so that sums and joins by it shuffle neither side.

Two tables with the same number of buckets are read bucket by bucket, one task each, and rows of one key meet without an exchange.
That is worth it only while no bucket is much larger than the others: a key that holds a third of all rows would be one task's
work. So the rows of each bucket are counted before the write; a large bucket is written by several tasks, and a table with such
a bucket is read as plain files, whose joins and sums Spark shuffles, adds up on the map side and splits as usual.

Defined results: null keys are a bucket's rows like others; an empty table gives an empty one; rows that repeat stay rows each;
a table of the same name is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the largest bucket, in shares of an even one, from which on a table is read as plain files.
SKEW = 4
_LARGEST = "slipcoach.largest_bucket"


def write_bucketed(df: DataFrame, name: str, path: str, by: str, buckets: int) -> DataFrame:
    """Saves df at the path as the session's table of that name, bucketed and sorted by a column, and returns it as `read_bucketed` does."""
    spark, key = df.sparkSession, f"`{by}`"
    bucket = F.pmod(F.hash(key), F.lit(buckets))
    held = {r.bucket: r.n for r in df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect()}  # a row for each bucket
    even = max(1, -(-sum(held.values()) // buckets))
    # tasks of each bucket: one, or as many as keep them near twice an even bucket
    spread = [max(1, -(-held.get(b, 0) // (2 * even))) for b in range(buckets)]
    first = [sum(spread[:b]) for b in range(buckets)]
    # rows of a bucket are told apart by all columns, so a task that runs again deals them alike
    at = F.get(F.lit(first), bucket) + F.pmod(F.xxhash64(*(f"`{c}`" for c in df.columns)), F.get(F.lit(spread), bucket))
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    dealt = df.repartitionById(sum(spread), at.cast("int"))
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, by).sortBy(by).format("parquet").saveAsTable(name)
    spark.sql(f"ALTER TABLE `{name}` SET TBLPROPERTIES ('{_LARGEST}' = '{max(held.values(), default=0) / even}')")
    return read_bucketed(spark, name)


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    """The table by its buckets, or as plain files if one of its buckets is large."""
    largest = float(spark.sql(f"SHOW TBLPROPERTIES `{name}` ('{_LARGEST}')").first().value)
    table = spark.table(f"`{name}`")
    if largest <= SKEW:
        return table
    path = spark.sql(f"DESCRIBE TABLE EXTENDED `{name}`").filter("col_name = 'Location'").first().data_type
    return spark.read.schema(table.schema).parquet(path)
