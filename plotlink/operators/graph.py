"""Topology of the map layer and dependencies between candidates, as joins on exploded way-node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlink.operators.scratch import cut_lineage, spread
from plotlink.params import DEFAULTS, Params


def shared_nodes(way_nodes: DataFrame) -> DataFrame:
    """node_id, n_ways of nodes that several ways use."""
    return way_nodes.groupBy("node_id").agg(F.count_distinct("way_id").alias("n_ways")).where("n_ways > 1")


def neighbour_rings(ways: DataFrame, members: DataFrame) -> DataFrame:
    """Closed ways of four nodes or more that are buildings or member outlines of a building relation.

    ways: way_id, nodes (ordered ids), is_building; closed as well where nodes can share a place, as their order does not tell
    then whether the way's ends meet. members: way_id.
    """
    meet = F.col("closed") if "closed" in ways.columns else F.element_at("nodes", 1) == F.element_at("nodes", -1)
    closed = ways.where((F.size("nodes") >= 4) & meet)
    return closed.join(members.select("way_id").distinct().withColumn("member", F.lit(True)), "way_id", "left").where(F.col("is_building") | F.col("member"))


def materialised(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, nodes, ring (flat, closed): coordinates joined to the node list; ways with an unknown node are left out."""
    w = ways.select("way_id", F.posexplode("nodes").alias("pos", "node_id")).join(nodes.select("node_id", "x", "y"), "node_id", "left")
    g = w.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id", "x", "y"))).alias("p"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unknown"))
    return g.where("unknown = 0").select("way_id", F.transform("p", lambda p: p["node_id"]).alias("nodes"), F.flatten(F.transform("p", lambda p: F.array(p["x"], p["y"]))).alias("ring"))


def line_directions(way_nodes: DataFrame, buildings: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """way_id (a building), node_id, from_node: the one neighbour node on lines that leave the building there.

    way_nodes: way_id, pos, node_id of all ways in order; buildings: way_id; blocked: node_id of nodes that
    relations hold. A node that another building uses, or from which lines leave in several directions, has none.
    Neighbours that belong to the building itself run along its wall and do not count.
    """
    b = buildings.select("way_id").distinct().withColumn("is_building", F.lit(True))
    lists = way_nodes.where("way_id is not null").groupBy("way_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda p: p["node_id"]).alias("nodes"))
    lists = cut_lineage(lists.join(spread(b), "way_id", "left").select("way_id", "nodes", F.coalesce("is_building", F.lit(False)).alias("is_building")))
    own = lists.where("is_building").select("way_id", F.explode(F.array_distinct("nodes")).alias("node_id"))
    # Only nodes of a single building can have a direction, so each use by a line meets one building, however many share a node.
    sole = own.groupBy("node_id").agg(F.min("way_id").alias("way_id"), F.count(F.lit(1)).alias("n")).where("n = 1 and node_id is not null").drop("n")
    if blocked is not None:
        sole = sole.join(spread(blocked.select("node_id").distinct()), "node_id", "left_anti")
    size, at = F.size("nodes"), lambda k: F.get("nodes", k)
    closed = at(F.lit(0)) == at(size - 1)
    beside = lambda node, k: F.struct(node.alias("node_id"), F.coalesce(at(k - 1), F.when(closed, at(size - 2))).alias("before"), F.coalesce(at(k + 1), F.when(closed, at(F.lit(1)))).alias("after"))
    uses = lists.where("not is_building").select(F.explode(F.transform("nodes", beside)).alias("r")).select("r.*").distinct()
    steps = uses.join(spread(sole), "node_id").select("way_id", "node_id", F.explode(F.array("before", "after")).alias("from_node"))
    wall = own.select("way_id", F.col("node_id").alias("from_node"), F.lit(True).alias("on_wall"))
    steps = steps.join(spread(wall), ["way_id", "from_node"], "left")
    usable = F.when(F.col("on_wall").isNull() & (F.col("from_node") != F.col("node_id")), F.col("from_node"))
    g = steps.groupBy("way_id", "node_id").agg(F.min(usable).alias("from_node"), F.max(usable).alias("other"))
    return g.where("from_node = other").select("way_id", "node_id", "from_node")


def keep_nodes(way_nodes: DataFrame, buildings: DataFrame, tagged: DataFrame, directions: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """way_id, node_id, mode of building nodes that must stay connected: sliding (a single line ends there),
    on_outline (tagged, used by this building alone) or fixed. members: node_id of nodes that relations hold, which keeps them too."""
    n_refs = way_nodes.groupBy("node_id").agg((F.min("way_id") != F.max("way_id")).alias("several"))
    own = way_nodes.select("way_id", "node_id").join(spread(buildings.select("way_id").distinct()), "way_id", "left_semi").distinct()
    d = directions.select("way_id", "node_id", F.lit(True).alias("slides"))
    k = own.join(spread(n_refs), "node_id").join(spread(tagged.select("node_id").distinct().withColumn("tagged", F.lit(True))), "node_id", "left").join(spread(d), ["way_id", "node_id"], "left")
    if members is None:
        k = k.where(F.col("several") | F.col("tagged"))
    else:
        k = k.join(spread(members.select("node_id").distinct().withColumn("member", F.lit(True))), "node_id", "left").where(F.col("several") | F.col("tagged") | F.col("member"))
    mode = F.when(F.col("slides"), "sliding").when(F.col("tagged") & ~F.col("several"), "on_outline").otherwise("fixed")
    return k.select("way_id", "node_id", mode.alias("mode"))


def prerequisites(candidates: DataFrame, touched: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """candidate, prerequisite, align: new buildings wait for the replaced or aligned partner of each touched neighbour.

    candidates: id, match_class, partner, hausdorff; touched: id, handle. align marks prerequisites that are
    identical but further off than near_identical_hausdorff.
    """
    owners = candidates.where(F.col("match_class").isin("ABWEICHEND", "IDENTISCH") & F.col("partner").isNotNull()).select(F.col("id").alias("prerequisite"), F.col("partner").alias("handle"), F.col("match_class").alias("p_class"), "hausdorff")
    new = candidates.where("match_class = 'NEU'").select("id")
    needed = (F.col("p_class") == "ABWEICHEND") | (F.col("hausdorff") > params.near_identical_hausdorff)
    return touched.join(new, "id", "left_semi").join(owners, "handle").where(needed).select(F.col("id").alias("candidate"), "prerequisite", (F.col("p_class") == "IDENTISCH").alias("align")).distinct()


def dependency_order(positions: DataFrame, edges: DataFrame) -> DataFrame:
    """id, place: each prerequisite directly before the first candidate that waits for it, unless it already comes
    earlier by itself. positions: id, position; edges: candidate, prerequisite, n (order of a candidate's list).

    One sort key does it: (own or first dependent's position, 0 before 1, n). Prerequisites never wait themselves.
    """
    at = positions.select(F.col("id").alias("candidate"), F.col("position").alias("waits"))
    first = edges.join(at, "candidate").groupBy("prerequisite").agg(F.min(F.struct("waits", "n")).alias("f"))
    p = positions.join(first.withColumnRenamed("prerequisite", "id"), "id", "left")
    early = F.coalesce(F.col("f.waits") < F.col("position"), F.lit(False))
    key = p.withColumn("k1", F.when(early, F.col("f.waits")).otherwise(F.col("position"))).withColumn("k2", F.when(early, 0).otherwise(1)).withColumn("k3", F.when(early, F.col("f.n")).otherwise(0))
    return _ranked(key, "k1", ["k1", "k2", "k3", "id"])


def _ranked(df: DataFrame, by: str, order: list[str], bucket: int = 4096) -> DataFrame:
    """id, place by a global order, ranked within ranges of the leading key and offset by their counts."""
    b = df.withColumn("range_no", F.floor(F.col(by) / bucket))
    before = b.groupBy("range_no").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("before", F.coalesce(F.sum("n_rows").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_rows")
    return b.join(before, "range_no").select("id", (F.col("before") + F.row_number().over(Window.partitionBy("range_no").orderBy(*order))).cast("long").alias("place"))


def reachable(edges: DataFrame, starts: DataFrame, rounds: int = 10_000) -> DataFrame:
    """start, node for everything that can be reached over directed edges (src, dst), the start itself included.

    Not components: the relation need not be symmetric. The frontier of each round is what was not seen before.
    """
    seen = starts.select("start", F.col("start").alias("node")).distinct()
    frontier = seen
    for _ in range(rounds):
        new = frontier.join(spread(edges.select(F.col("src").alias("node"), "dst")), "node").select("start", F.col("dst").alias("node")).distinct().join(spread(seen), ["start", "node"], "left_anti")
        new = cut_lineage(new)
        if new.isEmpty():
            return seen
        seen, frontier = cut_lineage(seen.unionByName(new)), new
    raise RuntimeError("reachability did not settle")


def greedy_pairs(pairs: DataFrame, a: str, b: str, distance: str, group: list[str]) -> DataFrame:
    """Greedy one-to-one assignment by ascending distance (ties: least a, then b) inside each group of a few dozen pairs:
    one fold over the group's sorted pairs, no rounds."""
    row = F.struct(distance, a, b, *[c for c in pairs.columns if c not in (*group, a, b, distance)])
    g = pairs.groupBy(*group).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    kind = g.schema["rows"].dataType.simpleString()
    free = lambda kept, r: ~F.exists(kept, lambda k: (k[a] == r[a]) | (k[b] == r[b]))
    taken = F.aggregate("rows", F.array().cast(kind), lambda kept, r: F.when(free(kept, r), F.concat(kept, F.array(r))).otherwise(kept))
    return g.select(*group, F.explode(taken).alias("row")).select(*group, "row.*")


def mutual_nearest(pairs: DataFrame, a: str, b: str, distance: str, group: list[str] | None = None, rounds: int = 1000) -> DataFrame:
    """Greedy one-to-one assignment by ascending distance (ties: least a, then b).

    Pairs that are each other's nearest are taken together, their ends leave, and the rest goes on; this gives what
    taking one pair after another in order of distance would, in few rounds.
    """
    if group:
        return greedy_pairs(pairs, a, b, distance, group).select(*pairs.columns)
    group = []
    done, open_ = None, pairs
    for _ in range(rounds):
        order = lambda: F.struct(distance, a, b)
        best_a = F.min(order()).over(Window.partitionBy(*group, a))
        best_b = F.min(order()).over(Window.partitionBy(*group, b))
        marked = open_.withColumn("best_a", best_a).withColumn("best_b", best_b)
        taken = marked.where((F.col("best_a") == order()) & (F.col("best_b") == order())).drop("best_a", "best_b")
        taken = cut_lineage(taken)
        if taken.isEmpty():
            break
        done = taken if done is None else done.unionByName(taken)
        open_ = cut_lineage(open_.join(taken.select(*group, a), [*group, a], "left_anti").join(taken.select(*group, b), [*group, b], "left_anti"))
    else:
        raise RuntimeError(f"pairs are left after {rounds} rounds")
    return done if done is not None else pairs.limit(0)


def corner_owners(corners: DataFrame, nodes: DataFrame, most: float) -> DataFrame:
    """Nearest node of each official corner (key rounded to the centimetre) within `most`, by an equi-join on grid cells."""
    size = F.lit(max(most, 0.01))
    cell = lambda c: F.floor(c / size).cast("long")
    around = F.sequence(F.lit(-1), F.lit(1))
    c = corners.withColumn("gx", F.explode(F.transform(around, lambda d: cell(F.col("x")) + d))).withColumn("gy", F.explode(F.transform(around, lambda d: cell(F.col("y")) + d)))
    n = nodes.select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny"), cell(F.col("x")).alias("gx"), cell(F.col("y")).alias("gy"))
    d = F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))
    key: list[Column] = [F.round("x", 2).alias("kx"), F.round("y", 2).alias("ky")]
    return c.join(spread(n), ["gx", "gy"]).withColumn("d", d).where(F.col("d") <= most).groupBy(*key).agg(F.min(F.struct("d", "node_id")).alias("m")).select("kx", "ky", "m.node_id", F.col("m.d").alias("dist"))


def change_preview(before: DataFrame, after: DataFrame, least: float = 0.001) -> DataFrame:
    """node_id, change (moved, created, deleted), dist: full outer join of two snapshots (node_id, x, y)."""
    a, b = before.select("node_id", F.col("x").alias("ax"), F.col("y").alias("ay")), after.select("node_id", F.col("x").alias("bx"), F.col("y").alias("by"))
    d = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    change = F.when(F.col("ax").isNull(), "created").when(F.col("bx").isNull(), "deleted").when(d > least, "moved")
    return a.join(b, "node_id", "full").select("node_id", change.alias("change"), d.alias("dist")).where("change is not null")


def merged_session(running: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New candidates in front of the running ones; known ids keep their entry."""
    fresh = new.join(running.select(key), key, "left_anti")
    return fresh.withColumn("fresh", F.lit(True)).unionByName(running.withColumn("fresh", F.lit(False)))
