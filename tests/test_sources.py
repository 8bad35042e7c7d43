"""Files read and written, and graphs that arrive as a stream."""

import pytest
from pyspark.sql import functions as F

from graphfold.operators.store import Store
from graphfold.sources import files, gml
from graphfold.streaming import arrivals

GML = """# a comment
graph [
  multigraph 0
  isolateNames "i1"
  isolateNames "i2"
  node [ id 0 label "n &amp; 0" size 2 seqIDs "0_0_1" seqIDs "1_0_2" ]
  node [ id 1 label "n1" ]
  edge [ source 1 target 0 size 1 ]
]
"""


def test_gml_text():
    nodes, edges, own = gml.graph_rows(GML, 3)
    assert nodes == [(3, 0, "n & 0", {"size": "2", "seqIDs": "0_0_1;1_0_2"}), (3, 1, "n1", {})]
    assert edges == [(3, 0, 1, {"size": "1"})]
    assert own == {"multigraph": "0", "isolateNames": "i1;i2"}
    again = gml.render([(i, label, a) for _, i, label, a in nodes], [(u, v, a) for _, u, v, a in edges], own)
    assert gml.graph_rows(again, 3) == (nodes, edges, own)
    with pytest.raises(ValueError, match="ends before"):
        gml.parse("graph [ node [ id 1 ]")


def test_gml_frames(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"g{i}.gml").write_text(GML)
    paths = [str(tmp_path / f"g{i}.gml") for i in (1, 2)]
    nodes, edges = gml.read_graphs(spark, paths)
    assert sorted((r.graph_ord, r.node_id) for r in nodes.collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert edges.count() == 2
    spark.dataSource.register(gml.GmlSource)
    loaded = spark.read.format("gml").option("paths", ",".join(paths)).option("part", "edges").load()
    assert loaded.count() == 2
    gml.write_graph(nodes.where("graph_ord = 1"), edges.where("graph_ord = 1"), str(tmp_path / "out"))
    text = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "out").glob("part-*")))
    assert gml.graph_rows(text, 3)[:2] == gml.graph_rows(GML, 3)[:2]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first\nACG\nTT\n>s2\nGG\n")
    found = files.read_fasta(spark, str(tmp_path / "a.fa"))
    assert sorted((r.id, r.seq) for r in found.collect()) == [("s1", "ACGTT"), ("s2", "GG")]
    files.write_fasta(found, str(tmp_path / "b"))
    assert sorted((r.id, r.seq) for r in files.read_fasta(spark, str(tmp_path / "b")).collect()) == [("s1", "ACGTT"), ("s2", "GG")]


def test_tables(spark, tmp_path):
    (tmp_path / "h.m8").write_text("query\ttarget\tfident\talnlen\tqlen\ttlen\tevalue\na\tb\t0.9\t10\tx\t12\t1e-5\n")
    hit = files.read_hits(spark, str(tmp_path / "h.m8")).first()
    assert (hit.fident, hit.qlen, hit.tlen) == (0.9, None, 12.0)
    (tmp_path / "c.clstr").write_text(">Cluster 0\n0\t5nt, >x1... *\n1\t5nt, >x2... at 1:5:1:5/100%\n>Cluster 1\n0\t4nt, >x3... *\n")
    found = files.read_clusters(spark, str(tmp_path / "c.clstr"))
    assert sorted((r.cluster, r.member, r.bounds) for r in found.collect()) == [(0, "x1", ""), (0, "x2", "1:5:1:5"), (1, "x3", "")]
    (tmp_path / "l.txt").write_text("a/b\n\n  \nc/d\n")
    assert files.read_graph_list(spark, str(tmp_path / "l.txt")) == ["a/b", "c/d"]
    assert files.read_list(spark, str(tmp_path / "l.txt")).count() == 2
    with pytest.raises(FileNotFoundError):
        files.require(spark, [str(tmp_path / "none")])


def test_arrivals(spark, tmp_path):
    rows = spark.createDataFrame([(1, "n1", "m1", "about"), (1, "n2", "m1", None)], arrivals.SUPPORT)
    rows.write.parquet(str(tmp_path / "in"))
    kept = Store(spark, str(tmp_path / "store"))
    for part in (None, rows.withColumns({"graph_ord": F.lit(2), "member": F.lit("m2"), "annotation": F.lit(None).cast("string")})):
        if part is not None:
            part.write.mode("append").parquet(str(tmp_path / "in"))
        arrivals.follow(spark, str(tmp_path / "in"), kept, str(tmp_path / "check")).awaitTermination(120)
    assert sorted((r.node_id, r.annotation, r.last_iteration) for r in kept.table("nodes").collect()) == [("n1", "about", 2), ("n2", None, 2)]
    assert kept.table("node_members").count() == 4
