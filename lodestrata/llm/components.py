"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import drop_folder, materialise


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, and the smallest node that each reaches by them."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before, label)  # a root hears what its members heard
        label = label[label]
        if np.array_equal(before, label):
            return nodes, nodes[label]


def _contracted(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars around the smallest node that they reach there: the same components, short paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = low = np.zeros(0, np.int64)
        for t in batches:  # contracted batch by batch: memory follows the nodes, not the edges
            a, b = (np.concatenate((x, t.column(i).to_numpy())) for i, x in enumerate((nodes, low)))
            nodes, low = roots(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != low]), pa.array(low[nodes != low])], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, label of each node of edges (a, b: longs): label is the smallest node of its component.

    Edges are first contracted in their tasks. Then, until nothing changes, each node takes the least label of its
    neighbours, and the label of its label. All of a node's offers are combined before the shuffle (min), so that a node
    with very many edges is no single task's work. Every round is a table in the shared folder.
    """
    ship(edges.sparkSession)
    spark = edges.sparkSession
    pairs = materialise(_contracted(edges.select("a", "b")), f"{folder}/edges")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), f"{folder}/0")
    n = 0
    while True:
        n += 1
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("label").alias("above"))
        new = near.join(up, "mid").select("node", "old", F.least("mid", "above").alias("label"))
        new = materialise(new, f"{folder}/{n}")
        changed = not new.filter("old != label").isEmpty()
        drop_folder(spark, f"{folder}/{n - 1}")
        labels = new.select("node", "label")
        if not changed:
            drop_folder(spark, f"{folder}/edges")
            return labels
