"""GML graphs: a reader and a writer of text, and a Python data source with one partition for each file."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TOKEN = re.compile(r'\s*(?:"((?:[^"])*)"|(\[)|(\])|([^\s\[\]"]+))')

NODE_SCHEMA = "graph_ord int, node_id long, label string, attributes map<string,string>"
EDGE_SCHEMA = "graph_ord int, u long, v long, attributes map<string,string>"


def tokens(text: str) -> Iterator[tuple[str, str]]:
    """Strings, brackets and bare words; lines that begin with # are comments."""
    text = re.sub(r"(?m)^\s*#.*$", "", text)
    for hit in _TOKEN.finditer(text):
        if hit[1] is not None:
            yield "string", html.unescape(hit[1])
        elif hit[2]:
            yield "open", "["
        elif hit[3]:
            yield "close", "]"
        else:
            yield "word", hit[4]


def parse(text: str) -> list[tuple[str, object]]:
    """A list of (key, value); a value is a string or such a list."""
    stack: list[list] = [[]]
    key = None
    for kind, value in tokens(text):
        if kind == "close":
            if len(stack) == 1:
                raise ValueError("a bracket closes that was not opened")
            stack.pop()
        elif key is None:
            if kind != "word":
                raise ValueError(f"a key was expected, not {value!r}")
            key = value
        elif kind == "open":
            inner: list = []
            stack[-1].append((key, inner))
            stack.append(inner)
            key = None
        else:
            stack[-1].append((key, value))
            key = None
    if len(stack) > 1 or key is not None:
        raise ValueError("the graph ends before its last bracket")
    return stack[0]


def attributes_of(entries: list, skip: tuple[str, ...]) -> dict[str, str]:
    """Attributes as strings; one that comes again is a list and joined by semicolons."""
    out: dict[str, str] = {}
    for key, value in entries:
        if key in skip:
            continue
        text = value if isinstance(value, str) else ";".join(x for _, x in value if isinstance(x, str))
        out[key] = f"{out[key]};{text}" if key in out else text
    return out


def graph_rows(text: str, order: int) -> tuple[list[tuple], list[tuple], dict[str, str]]:
    """Rows of nodes and edges, and the graph's own attributes."""
    graph = next((v for k, v in parse(text) if k == "graph" and isinstance(v, list)), None)
    if graph is None:
        raise ValueError("no graph in the file")
    nodes, edges = [], []
    for key, value in graph:
        if key == "node":
            own = dict((k, v) for k, v in value if isinstance(v, str))
            nodes.append((order, int(own["id"]), own.get("label", own["id"]), attributes_of(value, ("id", "label"))))
        elif key == "edge":
            own = dict((k, v) for k, v in value if isinstance(v, str))
            u, v = sorted((int(own["source"]), int(own["target"])))
            edges.append((order, u, v, attributes_of(value, ("source", "target"))))
    return nodes, edges, attributes_of([x for x in graph if x[0] not in ("node", "edge")], ())


def quote(value: object) -> str:
    """As GML writes it: numbers bare, strings quoted, with quotes and ampersands escaped."""
    text = str(value)
    if re.fullmatch(r"-?\d+", text):
        return text
    return '"' + text.replace("&", "&amp;").replace('"', "&#34;") + '"'


def render(nodes: list[tuple], edges: list[tuple], graph: dict[str, str] | None = None) -> str:
    """nodes: (id, label, attributes); edges: (u, v, attributes)."""
    lines = ["graph ["]
    lines += [f"  {k} {quote(v)}" for k, v in (graph or {}).items()]
    for i, label, attributes in nodes:
        lines += ["  node [", f"    id {i}", '    label "' + str(label).replace("&", "&amp;").replace('"', "&#34;") + '"', *(f"    {k} {quote(v)}" for k, v in sorted(attributes.items())), "  ]"]
    for u, v, attributes in edges:
        lines += ["  edge [", f"    source {u}", f"    target {v}", *(f"    {k} {quote(x)}" for k, x in sorted(attributes.items())), "  ]"]
    return "\n".join([*lines, "]"]) + "\n"


class GmlSource(DataSource):
    """spark.read.format("gml").option("paths", "a.gml,b.gml").option("part", "nodes"|"edges").

    Files must lie where executors can open them by name; read_graphs() goes through Spark's own readers.
    """

    @classmethod
    def name(cls) -> str:
        return "gml"

    def schema(self) -> str:
        return EDGE_SCHEMA if self.options.get("part", "nodes") == "edges" else NODE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GmlReader(self.options)


class GmlReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.part = options["paths"].split(","), options.get("part", "nodes")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i, p)) for i, p in enumerate(self.paths, 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        order, path = partition.value
        with open(path, encoding="utf-8") as file:
            nodes, edges, _ = graph_rows(file.read(), order)
        yield from (edges if self.part == "edges" else nodes)


def read_graphs(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of all files, in the order of the list, through Spark's binary reader.

    A path may be a folder of parts, as write_graph() leaves it; a graph is one text and so one task's.
    """
    order = spark.createDataFrame(list(enumerate(paths, 1)), "graph_ord int, given string")
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    strip = lambda c: F.regexp_replace(c, r"^[a-z]+:/+", "/")
    own, given = strip(F.col("path")), strip(F.regexp_replace("given", "/+$", ""))
    parts = files.join(F.broadcast(order), (own == given) | (F.regexp_replace(own, "/[^/]*$", "") == given))  # one row for each file of the list
    held = parts.groupBy("graph_ord").agg(F.array_sort(F.collect_list(F.struct("path", F.decode("content", "utf-8").alias("text")))).alias("parts"))
    texts = held.select("graph_ord", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"))

    def rows(part: int):
        def run(frames):
            import pandas as pd

            names = (("graph_ord", "node_id", "label", "attributes"), ("graph_ord", "u", "v", "attributes"))[part]
            for frame in frames:
                for order_, text in zip(frame["graph_ord"], frame["text"], strict=True):
                    yield pd.DataFrame(graph_rows(text, order_)[part], columns=names)

        return run

    return texts.mapInPandas(rows(0), NODE_SCHEMA), texts.mapInPandas(rows(1), EDGE_SCHEMA)


def gml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, text): the blocks of a GML file in sorted order, to be written as text by executors."""
    entry = lambda k, v: F.concat(F.lit("    "), k, F.lit(" "), F.when(F.rlike(v, F.lit(r"^-?\d+$")), v).otherwise(F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&#34;")), F.lit('"'))), F.lit("\n"))
    of = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: entry(e["key"], e["value"])), "")
    escaped = F.replace(F.replace(F.col("label"), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&#34;"))
    node = F.concat(F.lit("  node [\n    id "), F.col("node_id").cast("string"), F.lit('\n    label "'), escaped, F.lit('"\n'), of(F.col("attributes")), F.lit("  ]"))
    edge = F.concat(F.lit("  edge [\n    source "), F.col("u").cast("string"), F.lit("\n    target "), F.col("v").cast("string"), F.lit("\n"), of(F.col("attributes")), F.lit("  ]"))
    return nodes.select(F.lit(0).alias("part"), F.col("node_id").alias("key"), node.alias("text")).unionByName(edges.select(F.lit(1).alias("part"), F.col("u").alias("key"), edge.alias("text")))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder of text parts that, read in order, are one GML graph."""
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(-1, -1, "graph ["), (2, 0, "]")], "part int, key long, text string")
    gml_lines(nodes, edges).unionByName(ends).orderBy("part", "key", "text").select("text").write.mode("overwrite").text(path)
