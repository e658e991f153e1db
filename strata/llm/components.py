"""Connected components of a distributed edge table by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins; edges are written to the shared folder between
rounds, so lineage stays short and a lost executor costs one round at most. Nothing but a count and
a checksum of the edges reaches the driver. Vertices with very many edges meet in a grouped minimum,
which is combined before the shuffle, and in joins whose other side has one row a vertex, which
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import drop_path, shared_path


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(vertex, root)``: the smallest vertex of each component, for the others in it.

    Roots themselves and vertices without edges have no row. Self-loops, repeats and either direction are fine.
    """

    def keep(df: DataFrame) -> tuple[DataFrame, tuple, str]:
        path = shared_path(spark, "edges")
        df.write.parquet(path)
        df = spark.read.schema("a long, b long").parquet(path)
        return df, tuple(df.agg(F.count("a"), F.bit_xor(F.xxhash64("a", "b"))).first()), path

    now, sign, path = keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while sign[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        star = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = star.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        joined = star.join(least, F.col("a") == F.col("u"))
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        last, old = sign, path
        now, sign, path = keep(small)
        drop_path(spark, old)
        if sign == last:
            break
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
