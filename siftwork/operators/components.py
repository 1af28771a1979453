"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialise


def components(links: DataFrame) -> DataFrame:
    """(c, comp): each linked vertex with the smallest vertex it is connected with; links: (a, b), in any direction.

    Both rounds are a grouped minimum and a join, so a hub's links lie on many rows and never in one. The edges shrink
    to a star forest in a logarithmic number of rounds. Loops and repeated links change nothing; vertices that are
    their component's least appear too only through others' comp.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        down = materialise(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        # done if no vertex has two centres and no centre is a member
        if least.where("k > 1").isEmpty() and down.join(down.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return down.select(F.col("u").alias("c"), F.col("v").alias("comp"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = materialise(small, "edges")


def labelled(vertices: DataFrame, links: DataFrame, id_: str = "id") -> DataFrame:
    """All vertices with comp, single ones with themselves."""
    return vertices.join(components(links).withColumnRenamed("c", id_), id_, "left").withColumn("comp", F.coalesce("comp", id_))
