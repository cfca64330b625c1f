"""Connected components of links, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.llm.common import HEAVY, cut_lineage, join_by


def _mark(edges: DataFrame) -> tuple:
    """A few numbers that change when the set of links does; the first is their count."""
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 30)))).first()
    return tuple(row)


def _with_least(pairs: DataFrame, total: int) -> DataFrame:
    """(a, b) with m, the least of a and all its b; ``total``: rows of ``pairs`` at most. A hub's links stay where they are: see ``join_by``."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    return join_by(pairs, least if total <= HEAVY else cut_lineage(least), "a", "n", total, total)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b: long); root is the least node that can be reached.

    Steps are taken until the links stay as they are. No neighbourhood is brought together in one task: the least neighbour of
    a node is an aggregate that is joined back, for hubs by broadcast. Nulls, loops and repeats are left out first. A loop is no
    link, so its node has no row; without links there are no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut_lineage(e)
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * mark[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.where("a <> b").distinct())
        small = _with_least(large, 2 * mark[0])
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        e = cut_lineage(small.where("a <> b").distinct())
        was, mark = mark, _mark(e)
        if mark == was:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
