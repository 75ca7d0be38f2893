"""Connected components of an edge table that no single task or driver could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktide.llm.shared import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node with an edge (a, b); component is the smallest node reachable.

    Rounds of two steps: every node hands its larger neighbours to its smallest one, then all its smaller neighbours.
    They end when every node has one edge, to a node without any.  The table of a round is written to the shared folder,
    so lineage stays short.  Loops and repeated edges do no harm.
    """
    now = stored(_down(edges.select("a", "b")), name)
    while not _stars(now):
        both = _each(now, ("a", "b"), ("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _down(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # edges are dealt by their larger node already; it has as many as its neighbours have different smallest ones
        moved = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        now = stored(_down(_each(moved, ("b", "m"), ("a", "m"))), name)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select("component").distinct().select(F.col("component").alias("node"), "component"))


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """One row (a, b) for each pair of columns, in one pass."""
    made = F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs)))
    return rows.select(made.alias("e")).select("e.a", "e.b")


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node, dealt by the larger."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).repartition("a").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each larger node has one edge and is the smaller node of none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 OR (up > 0 AND least = 0)").isEmpty()
