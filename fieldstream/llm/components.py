"""Connected components of a table of links, by contraction in the shared folder.

Every task turns its links into a spanning forest, so a node then has at most one root per
task, however many links it had. Nodes are grouped with their roots; where a node has
several, they are linked to the least of them, and these links between roots are the next,
smaller table. Roots are ordered by a digest that changes with every turn: that is what makes
chains shrink by a constant factor a turn. When no node has two roots, labels are handed back
up, turn by turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstream.llm import kernels as K
from fieldstream.llm.common import keep

#: Links that a task joins at once; more make several forests.
LINKS_AT_ONCE = 1_000_000


def forest(u: np.ndarray, v: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some links and the root of each: of its component the first by digest."""
    nodes = np.unique(np.concatenate([u, v]))
    salt = K.U64(0x9E3779B97F4A7C15 * (2 * turn + 1) & 0xFFFFFFFFFFFFFFFF)
    nodes = nodes[np.argsort(K.mix(nodes.view(K.U64) ^ salt), kind="stable")]
    by_id = np.argsort(nodes)
    a, b = (by_id[np.searchsorted(nodes, x, sorter=by_id)] for x in (u, v))
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[parent]
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            far = parent[parent]
            if (far == parent).all():
                break
            parent = far


def _forests(links: DataFrame, turn: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            node, root = forest(*(np.concatenate(x) for x in zip(*held)), turn)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in (0, 1)))
            size += len(batch)
            if size >= LINKS_AT_ONCE:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return links.mapInArrow(K.tidy(run), "node long, root long")


def components(links: DataFrame, a: str = "a", b: str = "b", most_turns: int = 200) -> DataFrame:
    """(node, component): the least node that each linked node can reach.

    Each turn is one shuffle and a written table, so a lost executor repeats one turn only.
    Null ends and links of a node to itself are no links. No link or component is collected,
    and no node's links meet in one task.
    """
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where(
        F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    turns: list[DataFrame] = []
    for turn in range(most_turns):
        # The digest's order is that of a signed number here; any fixed order will do.
        order = F.transform("roots", lambda x: F.struct(
            F.xxhash64(F.lit(turn), x).alias("h"), x.alias("x")))
        labels = keep(_forests(edges, turn).groupBy("node").agg(F.collect_set("root").alias("roots"))
                      .select("node", F.array_min(order)["x"].alias("root"), "roots"), "labels")
        turns.append(labels.select("node", "root"))
        edges = labels.where(F.size("roots") > 1).select(
            F.explode("roots").alias("u"), F.col("root").alias("v")).where("u <> v")
        if not edges.limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_turns} turns")
    found = turns[-1]
    for below in reversed(turns[:-1]):
        above = found.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
        found = below.join(above, F.col("root") == F.col("__node"), "left").select(
            "node", F.coalesce("__root", "root").alias("root"))
    if len(turns) > 1:
        found = keep(found, "roots")
    least = found.groupBy(F.col("root").alias("__root")).agg(F.min("node").alias("component"))
    return found.join(least, F.col("root") == F.col("__root")).select("node", "component")
