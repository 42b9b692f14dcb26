"""Communities of a weighted graph by rounds of modularity moves, on an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.tables import discard, materialize


def _mass(x: Column | str) -> Column:
    """Products of edge weights and degrees stay whole numbers, of up to 38 digits."""
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(19,0)")


def upper(node: str) -> Column:
    """The half of a node, by its MD5. In a round one half moves, in the next the other: no two neighbours swap for ever."""
    return F.substring(F.md5(F.col(node).cast("string").cast("binary")), 1, 1) >= "8"


def communities(edges: DataFrame, rounds: int = 6) -> DataFrame:
    """edges(src, dst[, weight]) to (node, community): of every node with an edge, the community that rounds of modularity moves give it.

    Edges have no direction; repeated ones add up (a weight is a positive whole number, 1 without the column), loops
    and null ends don't count. A node starts as a community of its own. In a round, half of the nodes look at
    the communities of their neighbours and their own, and go where links within exceed the number to be expected
    most: 2m * links(node, c) - degree(node) * degrees(c), the node itself left out of c; whole numbers, so no rounding
    decides. Equal gains go to the smallest community, the own one first. A node alone goes to another that is alone
    only if that is smaller. Rounds end after `rounds`, or when neither half has moved. An empty table gives none.

    Rounds work on numbers in place of the nodes' names, in the names' order, so that ties go alike. A round moves the links of half
    of the nodes twice: to the communities of their other ends, and, summed, to the nodes.
    A hub's links are summed by (node, community) on the map side before any shuffle, and its choice is a maximum of
    these sums, also taken on the map side: no task gets a node's links. Each round's state is written, which cuts
    the lineage and lets Spark split hot keys in the joins with it.
    """
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    plain = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), weight.cast("long").alias("w"))
    once = materialize(plain.groupBy("a", "b").agg(F.sum("w").alias("w")), "edges")
    degrees = materialize(once.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("degree")), "degrees")
    total = degrees.agg(F.sum(_mass("degree"))).first()[0]
    # rows of a sorted table are numbered in their order, with gaps
    nodes = materialize(degrees.orderBy("node").select("node", "degree", upper("node").alias("upper"), F.monotonically_increasing_id().alias("id")), "nodes")
    numbered = once
    for side in "ab":
        numbered = numbered.join(nodes.select(F.col("node").alias(side), F.struct("id", "upper").alias(f"{side}_")), side)
    ends = F.array(*(F.struct(F.col(f"{x}_.id").alias("node"), F.col(f"{x}_.upper").alias("upper"), F.col(f"{y}_.id").alias("other")) for x, y in ("ab", "ba")))
    links = materialize(numbered.select(F.explode(ends).alias("e"), "w").select("e.*", "w"), "links")
    discard(once, degrees)
    state = nodes.select(F.col("id").alias("node"), "degree", "upper", F.col("id").alias("community"))
    still = 0
    for round_ in range(rounds if total else 0):
        moves = _moves(links, state, int(total), round_)
        if moves.isEmpty():
            discard(moves)
            still += 1
            if still == 2:
                break
            continue
        still = 0
        new = materialize(state.join(moves, "node", "left").select("node", "degree", "upper", F.coalesce("target", "community").alias("community")), "state")
        discard(state, moves)
        state = new
    discard(links)
    name = lambda c: nodes.select(F.col("id").alias(c), F.col("node").alias(f"{c}_name"))
    return state.select("node", "community").join(name("node"), "node").join(name("community"), "community").select(F.col("node_name").alias("node"), F.col("community_name").alias("community"))


def _moves(links: DataFrame, state: DataFrame, total: int, round_: int) -> DataFrame:
    """node, target of the nodes that change their community in this round."""
    sums = materialize(state.groupBy("community").agg(F.sum("degree").alias("mass"), F.count("*").alias("members")), "masses")
    moving = F.col("upper") == bool(round_ % 2)
    mine = state.filter(moving)
    of_other = state.select(F.col("node").alias("other"), F.col("community").alias("target"))
    seen = links.filter(moving).join(of_other, "other").select("node", "target", "w")
    seen = seen.unionByName(mine.select("node", F.col("community").alias("target"), F.lit(0).cast("long").alias("w")))  # the own one, linked or not
    seen = materialize(seen.groupBy("node", "target").agg(F.sum("w").alias("w")), "seen")
    own = mine.join(sums, "community").select("node", "degree", "community", F.col("members").alias("own_members"))
    found = seen.join(own, "node").join(sums.select(F.col("community").alias("target"), "mass", "members"), "target")
    stays = F.col("target") == F.col("community")
    rest = F.col("mass") - F.when(stays, F.col("degree")).otherwise(0)
    gain = F.lit(total).cast("decimal(19,0)") * _mass("w") - _mass("degree") * _mass(rest)
    fits = stays | (F.col("own_members") > 1) | (F.col("members") > 1) | (F.col("target") < F.col("community"))
    # the smallest of (-gain, stays first, target): taken on the map side
    best = F.min(F.struct((-gain).alias("loss"), (~stays).alias("leaves"), "target")).alias("best")
    moves = materialize(found.filter(fits).groupBy("node").agg(best).filter("best.leaves").select("node", "best.target"), "moves")
    discard(sums, seen)
    return moves


def modularity(edges: DataFrame, found: DataFrame) -> float:
    """The modularity of communities found in edges(src, dst), repeated edges counted each, loops not: 0 without edges."""
    ends = edges.filter("src <> dst").select("src", "dst")
    both = ends.join(found.select(F.col("node").alias("src"), F.col("community").alias("x")), "src").join(found.select(F.col("node").alias("dst"), F.col("community").alias("y")), "dst")
    sides = both.select(F.explode(F.array("x", "y")).alias("c"), ((F.col("x") == F.col("y")).cast("long")).alias("inside"))
    r = sides.groupBy("c").agg(F.count("*").alias("n"), F.sum("inside").alias("inside")).agg(F.sum("n").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")).first()
    return r.inside / r.m2 - r.squares / r.m2**2 if r.m2 else 0.0
