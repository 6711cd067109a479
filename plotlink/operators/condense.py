"""Who must move with whom, as membership and pairs of groups instead of all pairs of candidates.

Links fall into weakly connected parts first (in a number of rounds that grows with the logarithm of a part's length). Where every
link of a part has its reverse, as it is for nearly all rows of houses, the part is one group and nothing else is to be said. In
the others, paths are doubled, inside the part only: candidates that reach each other are one group, and pairs of groups
say which further ones a group takes along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlink.operators.scratch import cut_lineage, spread


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u > v) of a graph with the same parts: nodes are linked to the least one around them (large: their larger
    neighbours are, else they and their smaller ones)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(spread(least), "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def parts(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, part (the least node of its weakly connected part) of every node with a link. links: src, dst."""
    edges = cut_lineage(links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        edges = cut_lineage(_star(_star(edges, True), False))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("part")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("part")).distinct())
        mark = now
    raise RuntimeError(f"parts did not settle in {rounds} rounds")


def _closure(links: DataFrame, rounds: int = 60) -> DataFrame:
    """src, dst of all paths over links, whose length is doubled in each round."""
    paths = cut_lineage(links.select("src", "dst").distinct())
    n = paths.count()
    for _ in range(rounds):
        further = paths.join(spread(paths.select(F.col("src").alias("dst"), F.col("dst").alias("to"))), "dst").select("src", F.col("to").alias("dst"))
        paths = cut_lineage(paths.unionByName(further).distinct())
        now = paths.count()
        if now == n:
            return paths
        n = now
    raise RuntimeError(f"paths did not settle in {rounds} rounds")


def groups(candidates: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, takes): members has id and grp (its least member's id) of every candidate; takes has grp and other, the further
    groups that a group takes along, directly or not.

    What moves with a candidate is its group and the groups that this one takes. links: src, dst, of candidates; a candidate
    without links is its own group. Rows are as many as candidates, but for parts with one-way links, where a group that takes
    many along has a row for each.
    """
    links = cut_lineage(links.where("src <> dst").select("src", "dst").distinct())
    part = cut_lineage(parts(links))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    one_way = links.join(spread(back), ["src", "dst"], "left_anti").join(spread(part.withColumnRenamed("node", "src")), "src").select("part").distinct()
    mixed = cut_lineage(part.join(spread(one_way), "part", "left_semi"))
    inner = links.join(spread(mixed.select(F.col("node").alias("src"))), "src", "left_semi")
    paths = _closure(inner)
    mutual = paths.join(spread(paths.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), ["src", "dst"], "left_semi")
    named = mixed.select("node").join(spread(mutual.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least"))), "node", "left").select("node", F.coalesce("least", "node").alias("grp"))
    named = cut_lineage(named.unionByName(part.join(spread(mixed.select("node")), "node", "left_anti").select("node", F.col("part").alias("grp"))))
    members = candidates.select("id").join(spread(named.withColumnRenamed("node", "id")), "id", "left").select("id", F.coalesce("grp", "id").alias("grp"))
    a, b = named.select(F.col("node").alias("src"), "grp"), named.select(F.col("node").alias("dst"), F.col("grp").alias("other"))
    takes = paths.join(spread(a), "src").join(spread(b), "dst").where("grp <> other").select("grp", "other").distinct()
    return members, takes


def moves_with(members: DataFrame, takes: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node of the candidates in starts (start) only: what moves with them, themselves included."""
    own = starts.select("start").distinct().join(spread(members.withColumnRenamed("id", "start")), "start")
    all_groups = own.select("start", "grp").unionByName(own.join(spread(takes), "grp").select("start", F.col("other").alias("grp")))
    return all_groups.join(spread(members.withColumnRenamed("id", "node")), "grp").select("start", "node")
