"""Undirected graphs as edges (u, v): canonical keys, degrees, balls, relabelling, contraction, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphfold.functions.sequences import replace_all
from graphfold.plans.lineage import cut


def canonical(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """The smaller end first."""
    return edges.withColumns({u: F.least(u, v), v: F.greatest(u, v)})


def neighbours(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, neighbour) in both directions, each once; a loop makes a node its own neighbour."""
    pairs = edges.select(F.col(u).alias("node"), F.col(v).alias("neighbour"))
    return pairs.unionByName(edges.select(F.col(v).alias("node"), F.col(u).alias("neighbour"))).distinct()


def degrees(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, degree); a loop counts twice."""
    ends = edges.select(F.explode(F.array(u, v)).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def ball(edges: DataFrame, depth: int, centres: DataFrame | None = None) -> DataFrame:
    """(node, member): all within depth steps of node, itself left out.

    Each step joins the frontier with the adjacency and is made distinct, so that it is bounded by the
    balls' own size. centres (node) restricts the balls that are worked out.
    """
    near = neighbours(edges)
    reach = near if centres is None else near.join(centres.select("node"), "node", "left_semi")
    reach = reach.withColumnRenamed("neighbour", "member")
    steps = near.select(F.col("node").alias("member"), F.col("neighbour").alias("next"))
    for _ in range(depth - 1):
        reach = reach.unionByName(reach.join(steps, "member").select("node", F.col("next").alias("member"))).distinct()
    return reach.where(F.col("node") != F.col("member"))


def bfs_levels(edges: DataFrame, sources: DataFrame, depth: int | None = None) -> DataFrame:
    """(source, node, level): the steps from each source (source) to all nodes that it reaches, itself at 0.

    Ordered by level and node, these are the nodes as a breadth-first walk meets them that goes through
    neighbours in order. Level by level: the frontier meets the adjacency, and what was met before goes.
    """
    near = cut(neighbours(edges).select(F.col("node").alias("at"), F.col("neighbour").alias("node")), "adjacency")
    frontier = cut(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("level")).distinct(), "frontier")
    met, level = frontier, 0
    while depth is None or level < depth:
        level += 1
        reached = frontier.select("source", F.col("node").alias("at")).join(near, "at").select("source", "node").distinct()
        frontier = cut(reached.join(met.select("source", "node"), ["source", "node"], "left_anti").withColumn("level", F.lit(level)), "frontier")
        if not frontier.limit(1).count():
            break
        met = met.unionByName(frontier)
    return met


#: What a list in a string is written with.
LIST_MARKS = {"[": "", "]": "", "'": ""}


def single_genome(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (attributes map<string,string>) of one genome's graph in the form that merges: its member is 0.

    Lists written into a string lose their marks, flags become 0 or 1.
    """
    value = lambda k: F.element_at("attributes", F.lit(k))
    flag = lambda k: F.when(F.lower(value(k)).isin("true", "1"), "1").otherwise("0")
    plain = {k: replace_all(F.coalesce(value(k), F.lit("")), LIST_MARKS) for k in ("centroid", "dna", "protein")}
    fixed = {"members": F.lit("0"), **plain, **{k: flag(k) for k in ("hasEnd", "mergedDNA", "paralog")}}

    def with_values(frame: DataFrame, values: dict) -> DataFrame:
        rest = F.map_filter("attributes", lambda k, v: ~k.isin(*values))
        return frame.withColumn("attributes", F.map_concat(rest, F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])))

    return with_values(nodes, fixed), with_values(edges, {"members": F.lit("0"), "genomeIDs": F.lit("0")})


def relabel(df: DataFrame, mapping: DataFrame, columns: list[str], old: str = "old", new: str = "new") -> DataFrame:
    """df with the columns' labels replaced where the mapping (old, new) has them."""
    for c in columns:
        to = mapping.select(F.col(old).alias(c), F.col(new).alias("gf_new"))
        rest = [F.col(x) if x != c else F.coalesce("gf_new", c).alias(c) for x in df.columns]
        df = df.join(to, c, "left").select(*rest)
    return df


def relabel_collisions(mapping: DataFrame, new: str = "new") -> DataFrame:
    """(new, n): labels that two or more old labels would get."""
    return mapping.groupBy(new).agg(F.count("*").alias("n")).where("n > 1")


def merge_edges(edges: DataFrame, member: str = "member") -> DataFrame:
    """(u, v, member), each once, under canonical keys: what upserting edges with set union comes to."""
    return canonical(edges).select("u", "v", member).distinct()


def contract(edge_members: DataFrame, mapping: DataFrame, keep_self_loops: bool = False, member: str = "member") -> DataFrame:
    """Edge members after nodes have been merged: both ends mapped at once, members united.

    An edge between merged nodes becomes a loop, which goes unless it is asked for.
    """
    mapped = merge_edges(relabel(edge_members, mapping, ["u", "v"]), member)
    return mapped if keep_self_loops else mapped.where("u <> v")


def delete_nodes(edge_members: DataFrame, nodes: DataFrame, member: str = "member") -> DataFrame:
    """Edge members without the nodes (node): of each member, the neighbours of a deleted node are joined.

    A bridge joins two neighbours that are not deleted themselves, for the members whose edges to the
    deleted node both have.
    """
    ends = neighbours_by_member(edge_members, member)
    around = ends.join(nodes.select("node").distinct(), "node", "left_semi").join(nodes.select(F.col("node").alias("neighbour")).distinct(), "neighbour", "left_anti")
    other = around.select("node", member, F.col("neighbour").alias("gf_other"))
    bridges = around.join(other, ["node", member]).where("neighbour < gf_other").select(F.col("neighbour").alias("u"), F.col("gf_other").alias("v"), member)
    gone_u, gone_v = (nodes.select(F.col("node").alias(x)).distinct() for x in ("u", "v"))
    rest = edge_members.select("u", "v", member).join(gone_u, "u", "left_anti").join(gone_v, "v", "left_anti")
    return merge_edges(rest.unionByName(bridges.select("u", "v", member)), member)


def remove_members(edge_members: DataFrame, removals: DataFrame, member: str = "member") -> DataFrame:
    """Edge members after each (node, member) of removals has left its node: bridged for that member only.

    An edge that has no member left is gone, for it has no row.
    """
    ends = neighbours_by_member(edge_members, member)
    gone = removals.select("node", member).distinct()
    around = ends.join(gone, ["node", member], "left_semi").join(gone.withColumnRenamed("node", "neighbour"), ["neighbour", member], "left_anti")
    other = around.select("node", member, F.col("neighbour").alias("gf_other"))
    bridges = around.join(other, ["node", member]).where("neighbour < gf_other").select(F.col("neighbour").alias("u"), F.col("gf_other").alias("v"), member)
    rest = edge_members.select("u", "v", member)
    for end in ("u", "v"):
        rest = rest.join(gone.withColumnRenamed("node", end), [end, member], "left_anti")
    return merge_edges(rest.select("u", "v", member).unionByName(bridges.select("u", "v", member)), member)


def neighbours_by_member(edge_members: DataFrame, member: str = "member") -> DataFrame:
    """(node, neighbour, member) in both directions."""
    one = edge_members.select(F.col("u").alias("node"), F.col("v").alias("neighbour"), member)
    return one.unionByName(edge_members.select(F.col("v").alias("node"), F.col("u").alias("neighbour"), member)).distinct()


def is_connected(edges: DataFrame, nodes: DataFrame) -> bool:
    """Whether the nodes (node) and the edges among them are one piece; so is a graph of no node or one."""
    from graphfold.operators.components import components

    inner = edges.join(nodes.select(F.col("node").alias("u")), "u", "left_semi").join(nodes.select(F.col("node").alias("v")), "v", "left_semi")
    found = components(inner.select(F.col("u").alias("a"), F.col("v").alias("b")))
    alone = nodes.join(found, "node", "left").select(F.coalesce("component", "node").alias("c"))
    return alone.distinct().limit(2).count() < 2


def export_attributes(nodes: DataFrame, lists: list[str], separator: str = ";") -> DataFrame:
    """Array columns as joined strings, a scalar as it is."""
    kinds = dict(nodes.dtypes)
    return nodes.withColumns({c: F.array_join(c, separator) for c in lists if kinds[c].startswith("array")})


def skeleton(nodes: DataFrame, key: str = "node_id", keep: tuple[str, ...] = ("degree",)) -> DataFrame:
    """Keys and the few attributes that the next step needs; what was cleared is in the store."""
    return nodes.select(key, *[c for c in keep if c in nodes.columns])


def present(column: str) -> Column:
    """Whether an attribute carries anything: not null, not blank, not an empty list."""
    return F.col(column).isNotNull() & (F.trim(F.col(column).cast("string")) != "") & (F.col(column).cast("string") != "[]")
