"""Connected components of an edge table, as a chain of joins.

Every round points each node at its smallest neighbour, jumps that pointer
once more, and carries the edges over to the nodes pointed at. A node that
has an edge goes away or takes another one in, so a component at least halves
in each round. Rounds are written to the shared folder; nothing about the
graph reaches the driver except whether edges are left.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, a="a", b="b") -> DataFrame:
    """(node, comp): comp is the smallest node that ``node`` can reach.

    Nodes without an edge to another node are not in the result. Repeated
    edges, edges in both directions and self-loops are allowed; null ends are
    ignored. An empty edge table gives an empty result.
    """
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    work = materialise(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .distinct(), "cc-edges")
    hops = []
    while not work.isEmpty():
        both = work.union(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")) \
            .select("node", F.least("node", "low").alias("low"))
        jump = near.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        hop = materialise(near.join(jump, "low").select("node", F.col("lower").alias("low")), "cc-hop")
        hops.append(hop)
        to_a, to_b = (hop.select(F.col("node").alias(c), F.col("low").alias(f"n{c}")) for c in "ab")
        moved = work.join(to_a, "a").join(to_b, "b").where("na <> nb")
        work = materialise(moved.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
                           .distinct(), "cc-edges")
    if not hops:
        return work.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    labels = hops[0].select("node", F.col("low").alias("comp"))
    for hop in hops[1:]:
        onto = hop.select(F.col("node").alias("comp"), "low")
        labels = labels.join(onto, "comp", "left").select("node", F.coalesce("low", "comp").alias("comp"))
    return materialise(labels, "cc-labels") if len(hops) > 1 else labels
