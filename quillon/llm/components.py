"""Connected components by alternating large-star and small-star steps, all in DataFrame operations.

Each round costs a bounded number of shuffles of the edges that are left, and the number of rounds grows
with the logarithm of the component size, also for chains. Neighbour lists are never collected: a node's
least neighbour is a partial aggregate, and a node with a large share of the edges meets its least
neighbour in a join that adaptive execution splits. Of FEW edges or fewer a round is one task without shuffles, whose
files, several for each partition, and stages would otherwise be most of what it costs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import checkpointed

#: Edges that one task takes a round of; they only become fewer.
FEW = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every neighbour greater than a node to the least of the node and its neighbours."""
    both = edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
    least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its lesser neighbours to the least of them; edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least.hint("merge"), "a").select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def _digest(edges: DataFrame) -> tuple:
    """The number of the edges, which are distinct, and the exclusive or of their hashes."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges: component is the least node that can be reached.

    Self links and null ends link nothing and are left out, so a node that occurs only in those gets no
    row; repeated links count once; an empty table gives an empty table.
    """
    l, r = F.col(left), F.col(right)
    current = checkpointed(
        edges.filter(l.isNotNull() & r.isNotNull() & (l != r)).select(F.greatest(l, r).alias("a"), F.least(l, r).alias("b")).distinct()
    )
    before = _digest(current)
    if before[0] <= FEW:
        current = current.coalesce(1)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        current = checkpointed(_small_star(_large_star(current)))
        if before[0] <= FEW:
            current = current.coalesce(1)
        after = _digest(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not converge")
    # now every edge leads from a node to the least node of its component
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
