"""Table access, connected components and running numbers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmeter.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str = "text") -> Column:
    """Tells rows with equal doc_id but other texts apart; equal rows are one document."""
    return F.xxhash64(F.lit(7), F.coalesce(F.col(text), F.lit("")))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long) as (node, component), component the smallest node.

    Rounds of large-star and small-star: each node's neighbours move to its
    smallest neighbour until only stars are left. Links with a null end and
    loops are ignored. Nodes without a link do not occur in the result. Every
    round is written to the shared folder, which cuts the lineage.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, "links")
    before = _signature(links)
    while before[0]:
        links = materialize(_small_star(_large_star(links)), "links")
        after = _signature(links)
        if after == before:
            break
        before = after
    star = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.union(links.select(F.col("v"), F.col("v")).distinct())


def _signature(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.bit_xor(F.xxhash64("v", "u", F.lit(1))).alias("y"),
    ).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def numbered(df: DataFrame, order: list, name: str, label: str, placed: bool = False) -> DataFrame:
    """Number rows from 0 in the total order of ``order``, without one task for all rows.

    Rows are range-partitioned, sorted and stored (``placed``: they lie so
    already); each row takes its place in its partition plus the rows of the
    partitions before. Only one count per partition goes through the driver.
    """
    part = df if placed else df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(part.withColumn("_slot", F.monotonically_increasing_id()), label)
    place = F.shiftright("_slot", 33).cast("int")
    counts = dict(stored.groupBy(place.alias("p")).count().collect())
    base, starts = 0, []
    for p in sorted(counts):
        starts.append((p, base))
        base += counts[p]
    if not starts:
        return stored.withColumn(name, F.lit(0).cast("long")).drop("_slot")
    # A literal map with one entry per partition adds the offset without a join.
    offsets = F.create_map(*[F.lit(x) for pair in starts for x in pair])
    within = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.withColumn(name, offsets[place].cast("long") + within).drop("_slot")
