"""Consolidating pairwise matches into groups: connected components by alternating large-star and small-star.

Edges point from a child to a smaller parent. Both rewrites need only the least parent of every node: large-star hangs
the children of a node on the node's own least parent, small-star hangs the other parents of a node on its least
parent. Each is one aggregation with map-side combine and one join whose build side has one row per node; the probe
side may be skewed (a node with a third of all edges), which AQE splits. Groups that came to rest leave the work after
each round, so rounds shrink with what still moves. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.session import cut, release


def _least(edges: DataFrame, node: str) -> DataFrame:
    return edges.groupBy(F.col("child").alias(node)).agg(F.min("parent").alias("least"))


def star_components(edges: DataFrame, left: str, right: str, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node that has an edge to another one; component is its least identifier.

    Edges may come in either order and repeatedly; those with a null end or two equal ends link nothing and are left
    out, so an empty input gives no row. Ids are of any ordered type. Stops when a round of both stars moves no edge,
    O(log² n) rounds; RuntimeError if max_rounds are not enough. The files of states that are done with are deleted.
    """
    a, b = F.col(left), F.col(right)
    state = cut(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).distinct().withColumn("moved", F.lit(True)))
    done: list[DataFrame] = []
    for _ in range(max_rounds):
        if state.where("moved").isEmpty():
            break
        up = _least(state, "parent")
        large = state.join(up, "parent", "left").select("child", F.coalesce("least", "parent").alias("parent"), F.col("least").isNotNull().alias("moved"))
        large = cut(large.groupBy("child", "parent").agg(F.max("moved").alias("moved")))
        joined = large.join(_least(large, "child"), "child")
        aside = F.struct(F.col("parent").alias("child"), F.col("least").alias("parent"), F.lit(True).alias("moved"))
        small = joined.select(F.when(F.col("parent") == F.col("least"), F.struct("child", "parent", "moved")).otherwise(aside).alias("e")).select("e.*")
        after = cut(small.groupBy("child", "parent").agg(F.max("moved").alias("moved")))
        flagged = cut(_busy(after))
        release(state, large, after)
        state = flagged.where("busy").select("child", "parent", "moved")
        done.append(flagged.where("not busy").select("child", "parent"))
    else:
        raise RuntimeError(f"components: edges still move after {max_rounds} rounds")
    links = state.select("child", "parent")
    for d in done:
        links = links.unionByName(d)
    links = links.select(F.col("child").alias("node"), F.col("parent").alias("component"))
    return links.unionByName(links.select(F.col("component").alias("node"), "component").distinct())


def _busy(edges: DataFrame) -> DataFrame:
    """edges with busy: whether the star of the parent has a node that a moved edge touches. The star of a parent without
    is a whole component at rest: an edge that did not move through both rewrites has a parent that is no child and a child
    that is no parent, but by edges that moved."""
    touched = edges.where("moved").select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    near = edges.join(touched.withColumnRenamed("node", "child"), "child", "left_semi").select("parent").unionByName(touched.withColumnRenamed("node", "parent"))
    return edges.join(near.distinct().withColumn("busy", F.lit(True)), "parent", "left").select("child", "parent", "moved", F.coalesce("busy", F.lit(False)).alias("busy"))


def latest_links(matches: DataFrame, known: DataFrame, left: str = "left_id", right: str = "right_id", decision: str = "decision", decided_at: str = "decided_at", known_id: str = "mention_id") -> DataFrame:
    """(a, b) with a < b of the pairs whose latest decision is a match.

    Of each unordered pair only the row with the latest decided_at counts; rows without a time are older than any other,
    ties fall to the greater decision text. A decision is a match if, trimmed of white space and in lower case, it reads
    'match'. Pairs with a null, equal or unknown id link nothing.
    """
    a, b = F.col(left), F.col(right)
    word = F.lower(F.regexp_replace(F.col(decision), r"(?U)^\s+|\s+$", ""))
    pairs = matches.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.struct(F.col(decided_at).alias("at"), word.alias("word")).alias("d"))
    linked = pairs.groupBy("a", "b").agg(F.max("d").alias("d")).where("d.word = 'match'").select("a", "b")
    ids = known.select(F.col(known_id).alias("id")).where("id is not null").distinct()
    return linked.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")


def match_groups(matches: DataFrame, known: DataFrame) -> DataFrame:
    """(group_id, mention_id): every mention of a group of two or more, group_id being its least mention_id."""
    groups = star_components(latest_links(matches, known), "a", "b")
    return groups.select(F.col("component").alias("group_id"), F.col("node").alias("mention_id"))


def full_assignment(groups: DataFrame, known: DataFrame, known_id: str = "mention_id") -> DataFrame:
    """(group_id, mention_id) for every known id: a record that matches nothing is its own group."""
    ids = known.select(F.col(known_id).alias("mention_id")).where("mention_id is not null").distinct()
    return ids.join(groups, "mention_id", "left").select(F.coalesce("group_id", "mention_id").alias("group_id"), "mention_id")
