"""Connected components of a graph of longs, by repeated contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.llm.common import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of edges (a, b): root is one node of its component, the same for all its nodes.

    In a round each node points to its least neighbour (or stays, if it is less itself), pointers are followed to their
    ends by doubling, edges are renamed by them and repeated ones dropped, until no edge is left; the rounds' moves are
    then joined, last to first. A node's edges never meet in one list: least
    neighbours are partial aggregates, and the joins' hot side can be split. Every round is written to the shared folder.
    Self-loops and rows with a null are ignored; no edges give no rows.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    tidy = lambda df: df.select(a.alias("a"), b.alias("b")).where("a < b").distinct()
    edges = written(tidy(edges), f"{name}-edges")
    moves = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")), f"{name}-moves")
        more = True
        while more:
            after = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            doubled = written(to.join(after, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), f"{name}-moves")
            more, to = not doubled.where("moved").isEmpty(), doubled.drop("moved")
        moves.append(to)
        of = lambda end: to.select(F.col("node").alias(end), F.col("root").alias(f"to_{end}"))  # noqa: E731,B023
        renamed = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        edges = written(tidy(renamed), f"{name}-edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves.pop()
    while moves:
        last = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = written(moves.pop().join(last, "root", "left").select("node", F.coalesce("last", "root").alias("root")), f"{name}-roots")
    return found
