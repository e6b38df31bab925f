"""Union-find over a table of links, as alternating star contractions.

Each round points every node's larger neighbours at its smallest neighbour, then every
node's smaller neighbours at the smallest of them. The links end as stars around the
smallest id of each component, after a number of rounds that grows with the logarithm of
the component's size. Nothing but a few counts per round reaches the driver; every round is
written to the shared folder, and a node with very many links is split among tasks, since
the minima are partial sums and the joins are plain joins of two shuffled tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorana.workdir import MOST_ROWS, Scratch, merged_if


def as_edges(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(u, v), u above v, of links without self-links and nulls."""
    return links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))


class Stars:
    """Links under contraction: ``edges`` always joins what the links joined."""

    def __init__(self, links: DataFrame, a: str = "a", b: str = "b"):
        self.scratch = Scratch(links.sparkSession, "components")
        self.round, self.pending = 0, True
        first = self._written("e0", as_edges(links, a, b))
        #: how many links there are
        self.edges, self.n = first["table"], first["n"]

    def _written(self, name: str, df: DataFrame, **counts: Column) -> dict:
        """The table as read back and, from the same job, its count and further ones."""
        table, counted = self.scratch.counted(df, name, n=F.count(F.lit(1)), **counts)
        if name.startswith("e"):
            self.pending = counted["n"] > 0
        return {"table": merged_if(counted["n"] > MOST_ROWS, table), **counted}

    def contract(self) -> None:
        """One round; ``pending`` is false once a round has nothing left to change."""
        self.round += 1
        k, edges = self.round, self.edges
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(merged_if(self.n > MOST_ROWS, least), "x").select(F.col("y").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("x")).alias("moved"))
        large = self._written(f"large{k}", large, moved=F.count(F.when(F.col("moved"), 1)))
        links = large["table"].select("u", "v")
        least = links.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("far"))
        least = self._written(f"least{k}", least, apart=F.count(F.when(F.col("m") != F.col("far"), 1)))
        #: (node, root), one row per node that was joined so far; final once nothing is pending
        self.merged = least["table"].select(F.col("u").alias("node"), F.col("m").alias("root"))
        if least["apart"]:
            several = least["table"].where("m != far")
            moved = links.join(several, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            found = self._written(f"e{k}", moved.unionByName(least["table"].select("u", F.col("m").alias("v"))))
            self.edges, self.n = found["table"], found["n"]
        else:
            self.edges, self.n = least["table"].select("u", F.col("m").alias("v")), least["n"]
            self.pending = large["moved"] > 0

    def finish(self) -> DataFrame:
        """(node, root) for every node but the roots."""
        while self.pending:
            self.contract()
        return self.edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links`` but the roots themselves; root is the smallest id reachable.

    Self-links and nulls are ignored, repeated links count once. No links: no rows.
    """
    return Stars(links, a, b).finish()
