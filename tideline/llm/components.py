"""Connected components of a link table, by contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Shelf


def components(links: DataFrame, shelf: Shelf) -> DataFrame:
    """(a, b) links, a table read from storage, to (id, root): every linked id with the largest id of its component.

    Each round sends every id to its largest neighbour's largest neighbour, if
    larger than itself, and replaces links by those between the targets; what
    has come together drops out, so later rounds are small.  Maxima are combined
    before the shuffle, so an id with very many links costs no more than its
    share.  The result is the shelf's table "c-label".
    """
    edges, label = links.select("a", "b").filter("a != b"), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.max("b").alias("top")).select(F.col("a").alias("id"), F.greatest("a", "top").alias("up"))
        up = shelf.put(up, "c-up")
        jump = shelf.put(up.join(up.select(F.col("id").alias("up"), F.col("up").alias("far")), "up").select("id", "far"), "c-jump")
        moved = edges.join(jump.select(F.col("id").alias("a"), F.col("far").alias("fa")), "a").join(jump.select(F.col("id").alias("b"), F.col("far").alias("fb")), "b")
        edges = shelf.put(moved.filter("fa != fb").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).distinct(), "c-links")
        if label is None:
            found = jump.select("id", F.col("far").alias("root"))
        else:
            found = label.join(jump.select(F.col("id").alias("root"), "far"), "root", "left").select("id", F.coalesce("far", "root").alias("root"))
        label = shelf.put(found, "c-label")
        if edges.isEmpty():
            shelf.drop("c-up", "c-jump", "c-links")
            return label
