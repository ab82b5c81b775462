"""Connected components of a link table, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearcharge.llm.common import materialise


def components(links: DataFrame, name: str) -> DataFrame:
    """id, component (smallest id reachable) of every id in `links` (a, b). Smallest labels travel over links, then
    each label jumps to its own label, until nothing changes; each round is a written table. No row per group is
    gathered: only minima travel, so a node with very many links costs one partial minimum in each task.

    Empty links give an empty table; repeated and self links change nothing; null ends are dropped."""
    links = links.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = materialise(links.union(links.select("b", "a")).distinct(), f"{name}-both")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        lowered = materialise(labels.join(near, "id").select("id", F.col("component").alias("before"), F.least("component", "m").alias("component")), f"{name}-lowered")
        jumped = lowered.join(lowered.select(F.col("id").alias("component"), F.col("component").alias("further")), "component").select("id", "before", F.least("component", "further").alias("component"))
        labels = materialise(jumped, f"{name}-labels")
        if labels.filter("before <> component").limit(1).count() == 0:
            return labels.select("id", "component")
