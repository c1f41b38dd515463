"""The property graph: transitive paths, subsumption, places, disjointness.

Paths are a table (src, dst, depth, first_property) over the hierarchy's own nodes, which are few beside the facts; facts
join it on the end of their first hop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.sources.scratch import settle

#: Properties by relation: fixed values. The neighbour sets differ from those of paths.
PATHS = {"is_a": ("P31", "P279"), "part_of": ("P131", "P30", "P17")}
NEIGHBOURS = {"is_a": ("P31", "P279"), "part_of": ("P131", "P361", "P17"), "default": ("P31", "P279", "P361", "P131", "P17")}
#: The property that leads from a region to a larger one, but in general to much else: fixed value.
BRIDGE = "P361"


def transitive_paths(edges: DataFrame, properties: tuple[str, ...]) -> DataFrame:
    """src, dst, depth, first_property: the shortest depth of each pair that one or more edges join, and the least first property at that depth.

    Nodes that no edge leads to are facts. Only edges between other nodes are closed, by doubling: when all pairs up to a
    depth are known, the pairs of just that depth are joined to all of them, which gives all pairs up to twice the depth. So
    a path of a thousand edges takes ten rounds; rounds end when one finds nothing new, in cycles too. Each round is written.
    Facts join the closure once, on the end of their first hop.
    """
    step = edges.where(F.col("property").isin(*properties)).groupBy("src", "dst").agg(F.min("property").alias("first_property"))
    step = settle(step, "steps")
    inner_nodes = step.select(F.col("dst").alias("src")).distinct()
    found = settle(step.join(inner_nodes, "src", "left_semi").select("src", "dst", F.lit(1).alias("depth"), "first_property"), "paths")
    depth = 1
    while True:
        ahead = found.select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("depth").alias("_more"))
        longest = found.where(F.col("depth") == depth).select("src", "dst", "first_property")
        joined = longest.join(ahead, "dst").groupBy("src", F.col("next").alias("dst")).agg(F.min(F.struct((F.lit(depth) + F.col("_more")).alias("depth"), "first_property")).alias("it"))
        fresh = settle(joined.select("src", "dst", "it.*").join(found, ["src", "dst"], "left_anti"), "paths")
        if fresh.isEmpty():
            break
        found, depth = found.union(fresh), 2 * depth
    facts = step.join(inner_nodes, "src", "left_anti").select("src", F.col("dst").alias("via"), "first_property")
    beyond = found.select(F.col("src").alias("via"), "dst", "depth")
    further = facts.join(beyond, "via").select("src", "dst", F.col("depth") + 1, "first_property")
    first = facts.select("src", F.col("via").alias("dst"), F.lit(1).alias("depth"), "first_property")
    return settle(found.union(_shortest(first.union(further.toDF(*first.columns)))), "paths")


def _shortest(paths: DataFrame) -> DataFrame:
    return paths.groupBy("src", "dst").agg(F.min(F.struct("depth", "first_property")).alias("it")).select("src", "dst", "it.*")


def part_of_paths(edges: DataFrame, regions: tuple[str, ...]) -> DataFrame:
    """transitive_paths() of places, which may end in one bridge from a region to a region.

    The bridge's property holds much that isn't geography, so it counts only between nodes that are both instances of a class
    in regions, once, and as the last edge: what a larger region is part of says nothing of the places in it.
    """
    plain = transitive_paths(edges, PATHS["part_of"])
    typed = edges.where((F.col("property") == "P31") & F.col("dst").isin(*regions)).select(F.col("src").alias("node")).distinct()
    ends = lambda c: typed.select(F.col("node").alias(c))
    bridges = edges.where(F.col("property") == BRIDGE).select("src", "dst").distinct().join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi")
    direct = bridges.select("src", "dst", F.lit(1).alias("depth"), F.lit(BRIDGE).alias("first_property"))
    via = bridges.select(F.col("src").alias("via"), "dst")
    longer = plain.withColumnRenamed("dst", "via").join(via, "via").select("src", "dst", F.col("depth") + 1, "first_property")
    return settle(_shortest(plain.union(direct).union(longer.toDF(*plain.columns))), "paths")


def subsumption(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with relation: equivalent, a_subsumed_by_b, b_subsumed_by_a or unrelated."""
    up = paths.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("up"))
    down = paths.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(True).alias("down"))
    both = pairs.join(up, ["a", "b"], "left").join(down, ["a", "b"], "left")
    verdict = F.when((F.col("a") == F.col("b")) | (F.col("up") & F.col("down")), "equivalent").when(F.col("up"), "a_subsumed_by_b").when(F.col("down"), "b_subsumed_by_a")
    return both.select(*pairs.columns, verdict.otherwise("unrelated").alias("relation"))


def places(is_a: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """The nodes that are instances of one of the classes."""
    return is_a.where(F.col("dst").isin(*classes)).select(F.col("src").alias("node")).distinct()


def place_table(part_of: DataFrame, is_a: DataFrame, continents: str = "continent", classes: tuple[str, ...] = ("country", "continent", "place")) -> DataFrame:
    """node, lies_in (its continent), is_place, is_continent of each node that has one of these."""
    tops = is_a.where(F.col("dst") == continents).select(F.col("src").alias("dst")).distinct()
    within = part_of.join(tops, "dst", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("lies_in"), F.lit(False).alias("is_place"), F.lit(False).alias("is_continent"))
    kinds = is_a.where(F.col("dst").isin(*classes)).select(F.col("src").alias("node"), F.lit(None).cast("string").alias("lies_in"), F.lit(True).alias("is_place"), (F.col("dst") == continents).alias("is_continent"))
    every = within.unionByName(kinds).groupBy("node").agg(F.min("lies_in").alias("lies_in"), F.bool_or("is_place").alias("is_place"), F.bool_or("is_continent").alias("is_continent"))
    return settle(every, "places")


def with_disjoint(pairs: DataFrame, part_of: DataFrame, place: DataFrame) -> DataFrame:
    """value, expected_id, inside (the value is part of the expected one), disjoint: surely different places, false in any doubt.

    The expected continent isn't the value's, or both are places of one continent and neither is part of the other. pairs are
    distinct and have value_place, what place_table() says of the value.
    """
    pairs = settle(pairs, "pairs")  # few, as a rule: then paths and places are met where they lie
    asked = pairs.select("value", "expected_id")
    flag = lambda a, b, name: asked.join(part_of.select(F.col("src").alias(a), F.col("dst").alias(b)), [a, b]).select("value", "expected_id", F.lit(True).alias(name))
    at = place.select(F.col("node").alias("expected_id"), F.struct("lies_in", "is_place", "is_continent").alias("_place")).join(asked.select("expected_id").distinct(), "expected_id")
    joined = pairs.join(flag("value", "expected_id", "_in"), ["value", "expected_id"], "left").join(flag("expected_id", "value", "_out"), ["value", "expected_id"], "left").join(at, "expected_id", "left")
    here = F.col("value_place.lies_in")
    elsewhere = F.col("_place.is_continent") & (here != F.col("expected_id"))
    apart = F.col("_place.is_place") & (here == F.col("_place.lies_in")) & F.col("_in").isNull() & F.col("_out").isNull()
    no = F.lit(False)
    disjoint = (F.col("value") != F.col("expected_id")) & (F.coalesce(elsewhere, no) | F.coalesce(apart, no))
    return joined.select("value", "expected_id", F.coalesce("_in", no).alias("inside"), F.coalesce(disjoint, no).alias("disjoint"))


def disjoint_places(rows: DataFrame, part_of: DataFrame, is_a: DataFrame) -> DataFrame:
    """rows (value, expected, ...) with disjoint, as in with_disjoint()."""
    place = place_table(part_of, is_a)
    at = place.select(F.col("node").alias("value"), F.struct("lies_in", "is_place", "is_continent").alias("value_place"))
    pairs = rows.select("value", F.col("expected").alias("expected_id")).distinct().join(at, "value", "left")
    flags = with_disjoint(pairs, part_of, place).select("value", F.col("expected_id").alias("expected"), "disjoint")
    return rows.join(flags, ["value", "expected"], "left").select(*rows.columns, F.coalesce("disjoint", F.lit(False)).alias("disjoint"))


def directions(distribution: Column) -> Column:
    """Which way a predicate carries along a relation, as text: child, parent, both or nothing."""
    return F.when(distribution == "up", "child").when(distribution == "down", "parent").when(distribution == "both", "child,parent").otherwise("")


def neighbours(edges: DataFrame, nodes: DataFrame, properties: tuple[str, ...], incoming: int = 20) -> DataFrame:
    """node, property, neighbour, way: all outgoing edges of nodes and their first incoming ones by source.

    A task keeps the first ones of each node before they are dealt out, so a hub's edges don't meet in one task.
    """
    from pyspark.sql import Window

    step = edges.where(F.col("property").isin(*properties))
    out = nodes.join(step, F.col("node") == F.col("src")).select("node", "property", F.col("dst").alias("neighbour"), F.lit("out").alias("way"))
    order = Window.partitionBy("node").orderBy("src", "property")
    back = nodes.join(step, F.col("node") == F.col("dst")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= incoming)
    return out.union(back.select("node", "property", F.col("src").alias("neighbour"), F.lit("in").alias("way")))
