"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checkpoints import shared_folder
from ..operators.references import splittable

#: Links a task takes in a round, and the tasks that a round has at least: short tables go to few.
TASK_LINKS, LEAST_TASKS = 250_000, 6


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node of ``links`` (columns ``a``, ``b``).

    Distributed union-find: every node passes its smallest neighbour on to its larger
    neighbours, then to its smaller ones, until each component is a star around its
    smallest node. A round costs three shuffles of the links; the number of rounds grows
    with the logarithm of the longest path. Minima combine before the shuffle, and the
    joins can be split, so a node with very many links is no bottleneck.

    Nodes may be of any orderable type. Links with a null end and links of a node with
    itself are ignored; repeated links count once; without links the result is empty.
    """
    shared_folder(links.sparkSession)
    ordered = links.dropna().where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = ordered.distinct().checkpoint()
    before = None
    while (now := _fingerprint(stars)) != before:
        before, tasks = now, max(LEAST_TASKS, -(-now[0] // TASK_LINKS))
        stars = _small_star(_large_star(stars.coalesce(tasks), tasks), tasks).coalesce(tasks).checkpoint()
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_smallest(links: DataFrame, tasks: int) -> DataFrame:
    smallest = links.groupBy(F.col("u").alias("own")).agg(F.min("v").alias("least")).coalesce(tasks)
    return links.join(splittable(smallest), F.col("u") == F.col("own")).coalesce(tasks)


def _large_star(links: DataFrame, tasks: int) -> DataFrame:
    both = links.union(links.select("v", "u"))
    moved = _with_smallest(both, tasks).where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
    return moved.distinct().coalesce(tasks)


def _small_star(links: DataFrame, tasks: int) -> DataFrame:
    offered = _with_smallest(links, tasks)
    moved = offered.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    kept = links.groupBy("u").agg(F.min("v").alias("v")).coalesce(tasks)
    return moved.union(kept).distinct()
