"""Connected components of a link table by contraction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch, counted


def component_labels(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links(a, b): label is one node of the component, the same for all of them.

    Nodes are ordered by a hash. Every round a node is renamed to the first
    name among its own and its neighbours', followed once (pointer jumping);
    links are renamed alike and those within one name fall away. A dense group
    shrinks to a point at once, and a chain by a constant factor a round,
    because hashed names fall in no order along it. Every round at least the
    last name of each component goes, so rounds end without a limit. Tables are
    written between rounds, never leave the executors, and go when they are
    read no more. Null ends and links of a node to itself are left out.
    """
    tables = Scratch(links.sparkSession)
    mixed = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v")).alias(c)
    both = links.where("a <> b").select(mixed("a"), mixed("b"))
    both = tables.put("links", both.union(both.select("b", "a")).distinct())
    names = both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    stale, step = ["links"], 0
    while not both.isEmpty():
        near = tables.put(f"near{step}", both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        n = near.count()  # a row for each name
        further = near.select(F.col("a").alias("to"), F.col("to").alias("new"))
        renamed = tables.put(f"renamed{step}", near.join(counted(further, n), "to").select("a", "new"))
        names = names.join(counted(renamed, n), names["label"] == renamed["a"], "left").select("node", F.coalesce("new", "label").alias("label"))
        names = tables.put(f"names{step}", names)
        head, tail = renamed.select("a", F.col("new").alias("x")), renamed.select(F.col("a").alias("b"), F.col("new").alias("y"))
        moved = both.join(counted(head, n), "a").join(counted(tail, n), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        both = tables.put(f"links{step}", moved)
        tables.drop(*stale, f"near{step}", f"renamed{step}")
        stale, step = [f"names{step}", f"links{step}"], step + 1
    return names.select(F.col("node.v").alias("node"), F.col("label.v").alias("label"))
