"""Operators on a parent → child edge list."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .checkpoints import shared_folder
from .references import attach, splittable


def self_loops(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """Edges from a node to itself."""
    return edges.filter(F.col(parent) == F.col(child))


def deeper_than(edges: DataFrame, parent: str, child: str, levels: int) -> DataFrame:
    """Nodes (column ``node``) with a path of more than ``levels`` edges below them.

    Works upwards: a node is deeper than n when a child is deeper than n - 1. Each
    level is one semi-join of the edges, whatever the number of paths, and a cycle
    counts as endless depth.
    """
    links = edges.select(F.col(parent).alias("node"), F.col(child).alias("child")).distinct()
    deep = links.select("node").distinct()
    if levels > 0:
        # Links to nodes without a child end there: one semi-join leaves them out of all others.
        shared_folder(edges.sparkSession)
        links = _among(links, "child", deep).checkpoint()
        deep = links.select("node").distinct()
    for _ in range(levels - 1):
        names = deep.select(F.col("node").alias("__name"))
        deep = links.join(names, F.col("child") == F.col("__name"), "left_semi").select("node").distinct()
    return deep


#: Rounds of dropping loose links before chains are contracted again.
TRIMS = 3


def cycle_members(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """Nodes (column ``node``) from which a path leads back to the node itself.

    Links are dropped that start at a node nothing leads to or end at one that leads nowhere. Chains, runs of nodes
    with one link in and one link out, are contracted to single links by pointer jumping, which doubles the steps it looks
    ahead in each round; a ring of such nodes is found out on the way. So long chains and rings take
    rounds with the logarithm of their length. Both are repeated until nothing changes. What remains lies on cycles
    or between them. To tell these apart, each node takes the largest name among
    the nodes leading to it, then among those it leads to. Nodes of one cycle agree
    on both, so links between differing nodes are dropped, and all starts anew, until none is. At last the contracted
    links that lie on cycles are laid out again.

    The tables of the rounds are written to the folder the session names for checkpoints. A NULL end is no link.
    """
    shared_folder(edges.sparkSession)
    links = edges.select(F.col(parent).alias("source"), F.col(child).alias("target")).dropna().distinct()
    links, _ = _stored(links)
    # A link of a node to itself is a cycle found; as an entry and an exit it would keep all between two of them.
    alone = links.filter("source = target")
    contracted: list[DataFrame] = []
    links, left = _stored(links.filter("source <> target"))
    while left:
        before = left
        links, left = _trimmed(links, left, TRIMS)
        if left:
            links, left = _shortened(links, left, contracted)
        if left == before:
            links, left = _stored(_same_label(links, "source", "target"))
            links, left = _stored(_same_label(links, "target", "source"))
            if left == before:
                break
    cyclic = links
    for level in reversed(contracted):
        whole = cyclic.select(F.col("source").alias("from"), F.col("target").alias("to"))
        same = (F.col("start") == F.col("from")) & (F.col("stop") == F.col("to"))
        laid_out = level.join(splittable(whole), same, "left_semi").union(level.filter("ring OR start = stop"))
        cyclic, _ = _stored(cyclic.union(laid_out.select("source", "target")))
    return cyclic.union(alone).select(F.col("source").alias("node")).distinct()


def _shortened(links: DataFrame, left: int, contracted: list[DataFrame]) -> tuple[DataFrame, int]:
    """The links with every chain as one link, and their number.

    ``contracted`` gets the links of chains (``source``, ``target``) with the ends (``start``, ``stop``) of the link that
    stands for them, and the links of rings (``ring``), which are left out.
    """
    outs = links.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("outs"), F.first("target").alias("ahead"))
    ins = links.groupBy(F.col("target").alias("to")).agg(F.count("*").alias("ins"), F.first("source").alias("back"))
    ins = ins.filter("ins = 1")
    chains, nodes = _stored(
        outs.filter("outs = 1").join(splittable(ins), F.col("node") == F.col("to")).select("node", "back", "ahead")
    )
    if not nodes:
        return links, left
    reach, moving = 1, nodes
    while moving and reach < nodes:
        chains, moving = _jumped(chains)
        reach *= 2
    # Whoever has come as far as there are nodes and still stands on a chain goes round in a ring.
    standing = chains.select(F.col("node").alias("on"))
    rings = chains.join(splittable(standing), F.col("ahead") == F.col("on"), "left_semi").select(F.col("node").alias("ring"))
    ended = chains.join(splittable(standing), F.col("ahead") == F.col("on"), "left_anti")
    placed = attach(links, splittable(ended), {"source": "node"}, a_back="back", a_ahead="ahead")
    placed = attach(placed, splittable(ended), {"target": "node"}, b_back="back", b_ahead="ahead")
    placed = placed.join(splittable(rings), F.col("source") == F.col("ring"), "left").select(
        "source",
        "target",
        F.coalesce("a_back", "b_back", "source").alias("start"),
        F.coalesce("a_ahead", "b_ahead", "target").alias("stop"),
        F.col("ring").isNotNull().alias("ring"),
    )
    placed, _ = _stored(placed)
    contracted.append(placed.filter("ring OR start <> source OR stop <> target"))
    whole = placed.filter("NOT ring AND start <> stop").select(F.col("start").alias("source"), F.col("stop").alias("target"))
    return _stored(whole.distinct())


def _jumped(chains: DataFrame) -> tuple[DataFrame, int]:
    """Every chain node's ``back`` and ``ahead``, moved on to where those nodes' own lead; and how many moved."""
    moved = attach(chains, chains, {"ahead": "node"}, further="ahead")
    moved = attach(moved, chains, {"back": "node"}, before="back")
    moved = moved.select(
        "node",
        F.coalesce("before", "back").alias("back"),
        F.coalesce("further", "ahead").alias("ahead"),
        (F.col("further").isNotNull() | F.col("before").isNotNull()).alias("moved"),
    )
    moved, n = _stored(moved, F.count_if("moved"))
    return moved.drop("moved"), n


def _stored(df: DataFrame, counted: Column | None = None) -> tuple[DataFrame, int]:
    """``df`` as a table written to the shared folder, and its number of rows, or another count, from the same job.

    A checkpoint would keep the estimated size of its plan. Joins multiply sizes, so that the estimate
    would get two or three times as many digits in every round, until the driver did nothing but multiply them.
    """
    rows = Observation()
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
    df.observe(rows, (F.count("*") if counted is None else counted).alias("n")).write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), rows.get["n"]


def _among(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Rows whose column is one of the (distinct) names."""
    other = splittable(names.select(F.col(names.columns[0]).alias("__name")))
    return rows.join(other, F.col(column) == F.col("__name"), "left_semi")


def _trimmed(links: DataFrame, left: int, rounds: int) -> tuple[DataFrame, int]:
    """The links without those that are loose at an end, seen ``rounds`` times or until there are none."""
    for _ in range(rounds):
        inner = _among(links, "target", links.select("source").distinct())
        inner, still = _stored(_among(inner, "source", links.select("target").distinct()))
        if still == left:
            break
        links, left = inner, still
        if not left:
            break
    return links, left


def _same_label(links: DataFrame, start: str, end: str) -> DataFrame:
    """Links whose two nodes see the same largest name when following them from start to end."""
    nodes = links.select(F.col(start).alias("node")).union(links.select(F.col(end))).distinct()
    labels, _ = _stored(nodes.withColumn("label", F.col("node")))
    growing = True
    while growing:
        offered = (
            attach(links, splittable(labels), {start: "node"}, "inner", label="label")
            .groupBy(end)
            .agg(F.max("label").alias("offer"))
        )
        grown = attach(labels, offered, {"node": end}, offer="offer").select(
            "node",
            F.greatest("label", "offer").alias("label"),
            F.coalesce(F.col("offer") > F.col("label"), F.lit(False)).alias("grew"),
        )
        grown, growing = _stored(grown, F.count_if("grew"))
        labels = grown.drop("grew")
    both = attach(links, splittable(labels), {start: "node"}, "inner", first="label")
    both = attach(both, splittable(labels), {end: "node"}, "inner", second="label")
    return both.filter(F.col("first") == F.col("second")).select("source", "target")
