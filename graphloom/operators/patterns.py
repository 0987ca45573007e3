"""Graph patterns as joins: a chain of node and edge steps over a property graph, folded to a subgraph.

A graph is a set of node tables by label (id and properties) and of edge tables by type (src, dst and
properties). A match starts at a node and grows by steps; each step is an equi-join on ids, and every bound
name gives flat columns (`f_id`, `r_ts`), so Catalyst prunes what nothing reads and pushes conditions to the
scans. An edge is used once in a match, as in pattern languages. A step back to a name that is bound
already closes a cycle: the join is on both ends. Walks of bounded length go front by front.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """nodes: label -> table with id; edges: type -> table with src, dst; ends: type -> labels of src, dst."""

    nodes: dict[str, DataFrame]
    edges: dict[str, DataFrame]
    ends: dict[str, tuple[str, str]]

    def match(self, name: str, label: str, where: str | None = None) -> Match:
        """All nodes of a label; where is a condition on the table's own columns."""
        return Match(self, _named(self.nodes[label], name, where), {name: label}, {}, name)


def _named(rows: DataFrame, name: str, where: str | None) -> DataFrame:
    rows = rows.where(where) if where else rows
    return rows.select(*[F.col(f"`{c}`").alias(f"{name}_{c}") for c in rows.columns])


@dataclass(frozen=True)
class Match:
    """rows of a pattern; labels of the nodes and types of the edges by name; the node that the next step leaves."""

    graph: Graph
    rows: DataFrame
    nodes: dict[str, str]
    edges: dict[str, str]
    at: str

    def out(self, kind: str, edge: str, to: str, where: str | None = None, to_where: str | None = None) -> Match:
        """(at)-[edge:kind]->(to); where and to_where are conditions on the edge's and the node's own columns."""
        return self._step(kind, edge, to, where, to_where, ("src", "dst"))

    def back(self, kind: str, edge: str, to: str, where: str | None = None, to_where: str | None = None) -> Match:
        """(at)<-[edge:kind]-(to)."""
        return self._step(kind, edge, to, where, to_where, ("dst", "src"))

    def _step(self, kind, edge, to, where, to_where, ends) -> Match:
        near, far = ends
        steps = _named(self.graph.edges[kind], edge, where)
        on = F.col(f"{self.at}_id") == F.col(f"{edge}_{near}")
        if to in self.nodes:
            rows = self.rows.join(steps, on & (F.col(f"{to}_id") == F.col(f"{edge}_{far}")))
            nodes = self.nodes
        else:
            label = self.graph.ends[kind][1 if far == "dst" else 0]
            rows = self.rows.join(steps, on)
            rows = rows.join(_named(self.graph.nodes[label], to, to_where), F.col(f"{edge}_{far}") == F.col(f"{to}_id"))
            nodes = self.nodes | {to: label}
        for other, its_kind in self.edges.items():
            if its_kind == kind:
                rows = rows.where((F.col(f"{other}_src") != F.col(f"{edge}_src")) | (F.col(f"{other}_dst") != F.col(f"{edge}_dst")))
        return replace(self, rows=rows, nodes=nodes, edges=self.edges | {edge: kind}, at=to)

    def walk(self, kind: str, path: str, to: str, least: int, most: int) -> Match:
        """(at)-[:kind*least..most]->(to): every trail (no edge twice) of so many steps, with the nodes it goes
        through in `path`. Each length is one more join of the trails that are still growing."""
        edges = self.graph.edges[kind].select("src", "dst").distinct()
        label = self.graph.ends[kind][1]
        grown = self.rows.withColumn(path, F.array(F.col(f"{self.at}_id"))).withColumn("_used", F.array().cast("array<struct<src:long,dst:long>>"))
        found = [grown] if least == 0 else []
        for length in range(1, most + 1):
            step = F.struct(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
            grown = grown.join(edges, F.element_at(path, -1) == F.col("src")).where(~F.array_contains("_used", step))
            grown = grown.withColumn(path, F.array_append(path, F.col("dst"))).withColumn("_used", F.array_append("_used", step)).drop("src", "dst")
            found += [grown] if length >= least else []
        trails = reduce(DataFrame.unionByName, found).drop("_used").withColumn("_end", F.element_at(path, -1))
        if to in self.nodes:
            return replace(self, rows=trails.where(F.col("_end") == F.col(f"{to}_id")).drop("_end"), at=to)
        rows = trails.join(_named(self.graph.nodes[label], to, None), F.col("_end") == F.col(f"{to}_id")).drop("_end")
        return replace(self, rows=rows, nodes=self.nodes | {to: label}, at=to)

    def without(self, kind: str, where: str | None = None, *, backwards: bool = False) -> Match:
        """NOT (at)-[:kind]->(), or the other way round: an anti join."""
        steps = _named(self.graph.edges[kind], "_no", where).select("_no_dst" if backwards else "_no_src")
        return replace(self, rows=self.rows.join(steps, F.col(f"{self.at}_id") == steps[0], "left_anti"))

    def where(self, condition: str | Column) -> Match:
        return replace(self, rows=self.rows.where(condition))

    def first(self, limit: int, *order) -> Match:
        """The first rows by an order; give one that leaves no ties."""
        return replace(self, rows=self.rows.orderBy(*order).limit(limit))

    def fold(self, max_nodes: int = 500, max_edges: int = 1000) -> Folded:
        """The matched rows as a subgraph: distinct nodes (label, id) and edges (type, src, dst), each to a
        limit in their order, and a warning for each limit that cut something off."""
        nodes = [self.rows.select(F.lit(label).alias("label"), F.col(f"{name}_id").cast("string").alias("id")) for name, label in self.nodes.items()]
        edges = [self.rows.select(F.lit(kind).alias("type"), *[F.col(f"{name}_{e}").cast("string").alias(e) for e in ("src", "dst")]) for name, kind in self.edges.items()]
        none = self.rows.sparkSession.createDataFrame([], "type string, src string, dst string")
        every_node = reduce(DataFrame.unionAll, nodes).distinct()
        every_edge = reduce(DataFrame.unionAll, edges).distinct() if edges else none
        # One row beyond the limit tells whether there are more.
        over = lambda rows, most, what: rows.limit(most + 1).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.lit(f"{what} truncated to {most}").alias("warning"))
        return Folded(
            every_node.orderBy("label", "id").limit(max_nodes), every_edge.orderBy("type", "src", "dst").limit(max_edges),
            over(every_node, max_nodes, "nodes").unionAll(over(every_edge, max_edges, "relationships")),
        )


@dataclass(frozen=True)
class Folded:
    nodes: DataFrame
    edges: DataFrame
    warnings: DataFrame

    def table(self) -> DataFrame:
        """kind (node, edge, warning), name (label, type or text), id, src, dst."""
        none = F.lit(None).cast("string")
        return (
            self.nodes.select(F.lit("node").alias("kind"), F.col("label").alias("name"), "id", none.alias("src"), none.alias("dst"))
            .unionAll(self.edges.select(F.lit("edge"), "type", none, "src", "dst")).unionAll(self.warnings.select(F.lit("warning"), "warning", none, none, none))
        )
