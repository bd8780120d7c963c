"""Connected components of a table of links, with no part of the graph on the driver but a count."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(id, component_id) of every vertex of links(a, b); component_id is its component's smallest id.

    Each round takes the least label among neighbours and then the label of that label, so that distances halve; rounds
    are written to the shared folder, which cuts the lineage.  Self-links are allowed; an empty table gives none.
    """
    both = scratch.table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = scratch.table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), f"{name}-0")
    step = 0
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = hooked.select(F.col("id").alias("root"), F.col("label").alias("root_label"))
        jumped = hooked.join(root, F.col("label") == F.col("root")).select("id", "old", F.col("root_label").alias("label"))
        step += 1
        new = scratch.table(jumped, f"{name}-{step}")
        if not new.where("old <> label").limit(1).count():
            break
        labels = new.select("id", "label")
        if step > 1:
            scratch.drop(f"{name}-{step - 2}")
    scratch.drop(f"{name}-links", f"{name}-{step - 1}")
    return new.select("id", F.col("label").alias("component_id"))


def hook(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """root (of each vertex the least one it is joined to) after joining every u to its v."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up
