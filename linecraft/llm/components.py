"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, stored


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of ``links`` (a, b).

    Each round a node takes the smallest label among its neighbours' and its own, then its label's
    label; the number of rounds grows with the logarithm of a component's diameter.  Every round is
    written to the shared folder, so a lost executor repeats one round at most; rounds before are freed.
    """
    both = links.filter(F.col("a") != F.col("b")).select("a", "b")
    both = stored(both.union(both.select("b", "a")).distinct())
    held = labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("root").alias("low"))
        step = labels.join(near, F.col("node") == F.col("n")).select("node", F.col("root").alias("was"), F.least("root", "low").alias("next"))
        step = stored(step)
        up = step.select(F.col("node").alias("parent"), F.col("next").alias("above"))
        new = stored(step.join(up, F.col("next") == F.col("parent")).select("node", "was", F.least("next", "above").alias("root")))
        changed = not new.filter(F.col("was") != F.col("root")).isEmpty()
        free(step, held)
        held, labels = new, new.select("node", "root")
        if not changed:
            free(both)
            return labels
