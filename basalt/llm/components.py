"""Connected components of an edge table, by hooking and contraction on executors.

Every node hooks onto its smallest lower neighbour (a map-side combined minimum), pointer jumping
flattens the trees, edges are rewritten to the trees' roots, and what remains is contracted again.
Each round's tables are written to the shared folder, so lineage stays short and a lost executor
costs one round.  Nothing is collected: the driver only learns whether edges are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _relabelled(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """df with column replaced by its parent, where it has one."""
    to = parents.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return df.join(to, F.col(column) == F.col("_n"), "left").withColumn(column, F.coalesce("_r", column)).drop("_n", "_r")


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) of every node of edges (a, b) but the roots.

    Self-edges and repeated edges do no harm; edges with a null end are ignored; no edges, no rows.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    left, roots = stored(edges.distinct(), "edges"), None
    while not left.isEmpty():
        parents = stored(left.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "node"), "parents")
        while True:
            above = parents.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            jumped = stored(parents.join(above, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "jumped")
            parents = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        roots = parents if roots is None else stored(_relabelled(roots, "root", parents).unionByName(parents.join(roots.select("node"), "node", "left_anti")), "roots")
        left = _relabelled(_relabelled(left, "hi", parents), "lo", parents).filter("hi <> lo")
        left = stored(left.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "edges")
    if roots is None:
        return left.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots
