"""Scratch tables, schema helpers and graph components for the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import scratch_path, stash

#: Stands for a null doc_id inside an operator; sorts before every real id.
NO_ID = -(2**63)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def id_column(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(NO_ID))


def real_id(name: str = "did") -> Column:
    """The opposite of id_column."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells apart rows that share a doc_id; identical rows share it."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected edges; root is the smallest node of its component.

    Alternating large-star and small-star rounds; each round's edge list is written to the shared folder, and it stops
    when a round changes nothing. Every round keeps at most as many edges as there were.
    """
    e = stash(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges"
    )

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:  # larger neighbours point to the smallest one
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # smaller neighbours, and the node, point to the smallest one
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    sign = None
    while True:
        e = stash(star(star(e, True), False), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == sign:
            break
        sign = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def classes(reps: DataFrame, found: DataFrame, *carried: str) -> DataFrame:
    """node, class_id, class_node, links, and carried columns of those rows of reps (node, id, copies) that have links.

    found holds numbers of links (a: node, n) and edges (a, b: nodes) that tie together what is linked. A node's copies are linked to each other. A class's id
    and node are the smallest ones of its nodes.
    """
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null"))
    each = reps.select("node", "id", "copies", *carried).join(counts, "node", "left").join(roots, "node", "left")
    each = each.withColumns({"root": F.coalesce("root", "node"), "links": F.coalesce("n", F.lit(0)) + F.col("copies") - 1}).where("links > 0")
    first = each.groupBy("root").agg(F.min(F.struct("id", "node")).alias("first"))
    return each.join(first, "root").select("node", F.col("first.id").alias("class_id"), F.col("first.node").alias("class_node"), "links", *carried)


__all__ = ["NO_ID", "classes", "components", "free", "id_column", "real_id", "row_key", "scratch_path", "stash"]
