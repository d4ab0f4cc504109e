"""Connected components as DataFrame joins: minimum labels with pointer jumping.

No edge, label or component is collected; each round is written to the shared
folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch


def components(edges: DataFrame, nodes: int | None = None) -> DataFrame:
    """edges (u long, v long) -> (node, comp), comp being the smallest node connected to it.

    Nodes without edges don't appear.  Self-loops and repeated edges are allowed; nulls are not.
    `nodes`, about how many there are at most, bounds the tasks that write a round.
    """
    both = scratch.keep(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).distinct(), None if nodes is None else 2 * nodes)
    labels = scratch.keep(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("comp")), nodes)
    while True:
        heard = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("comp").alias("heard"))
        near = labels.join(heard, labels.node == heard.u).select("node", F.least("comp", "heard").alias("lower"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("top_node"), F.col("comp").alias("further"))
        new = scratch.keep(near.join(jump, F.col("lower") == F.col("top_node")).select("node", F.least("lower", "further").alias("comp"), "was"), nodes)
        changed = new.where("comp <> was").limit(1).count()
        scratch.drop(labels)
        labels = new.select("node", "comp")
        labels._millrace_path = new._millrace_path  # noqa: SLF001
        if not changed:
            scratch.drop(both)
            return labels
