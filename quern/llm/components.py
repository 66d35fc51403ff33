"""Connected components of link tables by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a[i], b[i]) as (node, smallest node of its component), without the rows of those smallest nodes."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    kept = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[kept], nodes[root[kept]]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every linked node but the roots: root is the smallest node that links reach.

    ``links`` has two columns of one ordered type; null or equal ends are no links, rows may repeat, an empty table gives an
    empty result. Each round ends in a table in the shared folder. Minima are pre-aggregated before they are shuffled, and
    the joins behind a node with very many links are split by adaptive execution.
    """
    a, b = links.columns
    found = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    found = written(found, "links")
    seen = None
    for _ in range(most_rounds):
        both = found.union(found.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = written(small.union(least.select("u", "m")).distinct(), "stars")
        state = found.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return found.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")
