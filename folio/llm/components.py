"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folio.session import settle


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``node -> parent`` (parents are smaller) to the root by pointer jumping."""
    parents = settle(parents, "parents")
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        jumped = settle(parents.join(up, "parent", "left").select("node", F.coalesce("_up", "parent").alias("parent"), F.col("_up").isNotNull().alias("_moved")), "parents")
        parents = jumped.drop("_moved")
        if jumped.filter("_moved").isEmpty():
            return parents


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after the links (a, b) join components; a component's label is its smallest.

    Nodes without a row are their own component.  Each round hooks every component to its
    smallest neighbour and flattens the chains, so rounds grow with the logarithm of the size.
    """
    links = links.select("a", "b")
    while True:
        named = links
        for end in ("a", "b"):
            own = labels.select(F.col("node").alias(end), F.col("component").alias("_c"))
            named = named.join(own, end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
        links = settle(named.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        if links.isEmpty():
            return labels
        roots = _roots(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")))
        roots = roots.withColumnRenamed("parent", "_root")
        moved = labels.join(roots.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("_root", "component").alias("component"))
        fresh = roots.join(labels, "node", "left_anti").select("node", F.col("_root").alias("component"))
        labels = settle(moved.unionByName(fresh), "labels")


def no_labels(spark) -> DataFrame:
    return spark.createDataFrame([], "node long, component long")
