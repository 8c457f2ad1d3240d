"""Classes of linked nodes: connected components, and one row for each document with its class and its number of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import materialise

_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, root) of a partition's spanning forest, by union-find; the root is the smallest member."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        xs = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array([root(x) for x in xs], pa.int64())], schema=_EDGE)


def components(pairs: DataFrame) -> DataFrame:
    """node, component (its smallest node) of an undirected graph of pairs a, b.

    Partitions first shrink to spanning forests; then minimum labels spread and shortcut, each round written to the
    shared folder, until no label changes. The number of rounds follows the logarithm of the longest path.
    """
    edges = pairs.select("a", "b").mapInArrow(_forest, "a long, b long")
    both = materialise(edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("x")).select("x.v", "x.u").distinct(), "edges")
    label = materialise(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("c")), "labels")
    while True:
        near = both.join(label.select(F.col("v").alias("u"), "c"), "u").select("v", "c")
        low = near.unionByName(label).groupBy("v").agg(F.min("c").alias("m"))
        jump = low.join(label.select(F.col("v").alias("m"), F.col("c").alias("up")), "m").select("v", F.least("m", "up").alias("c"))
        new = materialise(jump, "labels")
        changed = new.join(label.select("v", F.col("c").alias("old")), "v").filter("c <> old").limit(1).count()
        label = new
        if not changed:
            return label.select(F.col("v").alias("node"), F.col("c").alias("component"))


def counted(rows: DataFrame) -> DataFrame:
    """node, its number of rows (n) and their smallest id (least)."""
    return materialise(rows.filter("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")), "nodes")


def summary(rows: DataFrame, links: DataFrame, nodes: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """id, class_id, n_links of each of rows (id, node; distinct), given the pairs a, b of linked nodes. Where near says how many
    rows (linked) the others linked with a node have, links may be a spanning forest. nodes: ``counted`` rows, if known.

    Rows of one node are linked with each other, and with all rows of a linked node; they are counted, never expanded. class_id is
    the smallest id of all rows that chains of links reach. A row without a node has no link.
    """
    nodes = counted(rows) if nodes is None else nodes
    if near is None:
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("x")).select("x.*")
        near = ends.join(nodes.select(F.col("node").alias("other"), "n"), "other").groupBy("node").agg(F.sum("n").alias("linked"))
    part = components(links)
    least = part.join(nodes, "node").groupBy("component").agg(F.min("least").alias("class_least"))
    known = nodes.join(near, "node", "left").join(part.join(least, "component").select("node", "class_least"), "node", "left")
    known = known.filter("n > 1 OR linked IS NOT NULL").select("node", F.coalesce("class_least", "least").alias("class_id"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    found = rows.join(known, "node", "left")  # a node of very many rows is split by adaptive execution
    return found.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def classes_sql(rows: str, links: str) -> str:
    """CTEs up to ``summary`` over CTEs ``rows`` (id, node) and ``links`` (a, b; each pair once)."""
    return f"""
nodes_ AS (SELECT node, count(*) AS n, min(id) AS least FROM {rows} WHERE node IS NOT NULL GROUP BY node),
ends_ AS (SELECT a AS node, b AS other FROM {links} UNION ALL SELECT b, a FROM {links}),
near_ AS (SELECT ends_.node, sum(n) AS linked FROM ends_ JOIN nodes_ ON nodes_.node = other GROUP BY ends_.node),
reach_ AS (SELECT node, node AS other FROM nodes_ UNION SELECT reach_.node, ends_.other FROM reach_ JOIN ends_ ON ends_.node = reach_.other),
class_ AS (SELECT reach_.node, min(least) AS class_least FROM reach_ JOIN nodes_ ON nodes_.node = reach_.other GROUP BY reach_.node),
summary AS (
  SELECT id, coalesce(class_least, id) AS class_id, coalesce(coalesce(linked, 0) + n - 1, 0)::BIGINT AS n_links
  FROM {rows} r LEFT JOIN nodes_ USING (node) LEFT JOIN near_ USING (node) LEFT JOIN class_ USING (node))"""
