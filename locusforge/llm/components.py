"""Connected components of an edge table by contraction; nothing is gathered on the driver.

Each round, tasks solve the edges that they hold, a bounded chunk at a time: each node gets the least node that its chunk
connects it to. A node that several chunks have takes the least of these roots, and an edge from it to each of the others goes
on to the next round, whose graph has roots alone. When none are left, labels are followed back through the rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

CHUNK = 1 << 20  # edges that are solved at once
TASKS = 8  # of a round at least


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node connected to each) of a list of edges."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return nodes, nodes[label]
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while (label[label] != label).any():
            label = label[label]


@shared.lean
def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def solve() -> Iterator[pa.RecordBatch]:
        u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(2))
        nodes, least = roots(u, v)
        for i in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(least[i : i + 100_000])], ["node", "root"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            yield from solve()
            held, size = [], 0
    if size:
        yield from solve()


def components(edges: DataFrame, most: int = 200) -> DataFrame:
    """(u, v) long, written already -> (node, component), the least node reachable; nodes without edges are left out."""
    shared.prepare(edges.sparkSession)
    now, levels = edges.where("u <> v").select("u", "v"), []
    for _ in range(most):
        n = now.count()
        if not n and levels:
            out = levels.pop()
            while levels:
                before = levels.pop()
                after = out.select(F.col("node").alias("label"), "component")
                out = before.select("node", F.col("component").alias("label")).join(after, "label", "left").select("node", F.coalesce("component", "label").alias("component"))
            return out
        local = now.coalesce(max(TASKS, math.ceil(n / CHUNK))).mapInArrow(_solved, "node long, root long")
        met = shared.materialize(local.groupBy("node").agg(F.min("root").alias("component"), F.collect_set("root").alias("roots")), "roots")
        levels.append(met.select("node", "component"))
        now = met.where(F.size("roots") > 1).select(F.explode("roots").alias("u"), F.col("component").alias("v")).where("u <> v")
    raise RuntimeError("components didn't settle")
