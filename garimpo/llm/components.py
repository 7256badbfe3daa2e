"""Connected components and splits that keep them whole.

Method: distributed union-find. Every partition of the edges builds a local forest; where
forests of different partitions meet in one node, their roots become the edges of the
next, smaller graph, which is merged the same way, level by level. No task ever holds
more than one partition's edges, and the driver holds only counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.shared import materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a-b and for each the smallest node of its local tree."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]]


def _local_forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over a partition, folded batch by batch: after each batch only the forest is kept."""
    a = b = np.empty(0, dtype=np.int64)
    for pdf in batches:
        a, b = forest(np.concatenate([a, pdf["u"].to_numpy()]), np.concatenate([b, pdf["v"].to_numpy()]))
    if len(a):
        yield pd.DataFrame({"node": a, "root": b})


def connected_components(edges: DataFrame, one_task: int = 200_000, max_levels: int = 40) -> DataFrame:
    """(node, component) for every node of the edges (u, v); component is its smallest node.

    Edges with a null end are ignored, loops give a component of one, repeated edges are
    harmless. Graphs of up to one_task edges are finished in a single task, larger ones
    level by level; the number of levels grows with the logarithm of the longest chain of
    forests.
    """
    level = materialize(edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).where("u is not null and v is not null"), "edges")
    maps: list[DataFrame] = []
    for depth in range(max_levels):
        n = level.count()
        parts = 1 if n <= one_task else -(-n // one_task)
        placed = level.coalesce(1) if parts == 1 else level.repartition(parts, F.col("u"))
        trees = materialize(placed.mapInPandas(_local_forests, "node bigint, root bigint"), f"forest{depth}")
        if parts == 1:
            maps.append(trees)
            break
        best = materialize(trees.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("_far")), f"roots{depth}")
        maps.append(best.select("node", "root"))
        met = trees.join(best.where("root < _far").select("node", F.col("root").alias("_near")), "node").where("root > _near")
        level = materialize(met.select(F.col("_near").alias("u"), F.col("root").alias("v")).distinct(), f"level{depth + 1}")
        if level.isEmpty():
            break
    else:
        raise RuntimeError(f"components are not closed after {max_levels} levels")
    out = maps[0]
    for up in maps[1:]:
        above = up.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        out = out.join(above, "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
    return out.select("node", F.col("root").alias("component"))


def star_edges(links: DataFrame, hub: str, end: str) -> DataFrame:
    """Edges (u, v) that tie all ends of a hub to its smallest end: k ends give k - 1 edges, not k * k pairs."""
    pairs = links.select(F.col(hub).alias("_hub"), F.col(end).alias("v")).where("_hub is not null and v is not null").distinct()
    least = pairs.groupBy("_hub").agg(F.min("v").alias("u"), F.max("v").alias("_far")).where("u < _far").select("_hub", "u")
    return pairs.join(least, "_hub").where("u < v").select("u", "v")


def pairs_within(members: DataFrame, node: str, component: str) -> DataFrame:
    """All pairs a < b of one component: the result asked for, so its size is the result's.

    The left side of large components is salted over 32 tasks per component.
    """
    salted = members.select(F.col(component).alias("_c"), F.col(node).alias("a"), F.pmod(F.xxhash64(node), F.lit(32)).alias("_s"))
    spread = members.select(F.col(component).alias("_c"), F.col(node).alias("b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(31).cast("bigint"))).alias("_s"))
    return salted.join(spread, ["_c", "_s"]).where("a < b").select("a", "b")


def assign_groups(sizes: list[tuple[int, int]], shares: dict[str, float]) -> dict[int, list[tuple[str, int]]]:
    """Greedy largest-first over the histogram {size: groups}: how many groups of each size every split gets.

    Equal groups are interchangeable, so the greedy rule only needs the histogram, whose
    length is at most the square root of twice the rows. Each group goes to the split
    furthest below its target (ties: the first by name). For equal groups that rule takes
    the highest places of one falling staircase per split, so all whole steps above the
    common level they end at are dealt at once and the few left over one by one: the
    result is that of the plain loop for any number of groups.
    """
    total = sum(s * g for s, g in sizes)
    whole = sum(shares.values()) or 1.0
    left = {k: total * v / whole for k, v in shares.items()}
    out: dict[int, list[tuple[str, int]]] = {}
    for size, groups in sorted(sizes, reverse=True):
        got = {k: max(0, math.floor((v - level(list(left.values()), size * groups)) / max(size, 1) - 1e-9)) for k, v in left.items()}
        left = {k: v - got[k] * size for k, v in left.items()}
        for _ in range(groups - sum(got.values())):
            best = min(left, key=lambda k: (-left[k], k))
            got[best] += 1
            left[best] -= size
        out[size] = [(k, n) for k, n in got.items() if n]
    return out


def level(heights: list[float], amount: float) -> float:
    """The height down to which columns are cut if amount is taken off the highest."""
    heights = sorted(heights, reverse=True)
    cut, taken = heights[0], 0.0
    for n, low in enumerate([*heights[1:], -math.inf], start=1):
        if taken + n * (cut - low) >= amount:
            return cut - (amount - taken) / n
        taken, cut = taken + n * (cut - low), low
    return cut
