"""Readers and writers of the files around a merge: FASTA, hit tables, gene tables, cluster files, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HITS = "query string, target string, fident string, alnlen string, qlen string, tlen string, evalue string"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, header, seq): records begin at lines with >; a sequence's lines are joined, blanks dropped."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>", "").alias("r"))
    header = F.substring_index("r", "\n", 1)
    seq = F.regexp_replace(F.substr("r", F.length(header) + 1, F.length("r")), r"\s+", "")
    return records.where(F.trim("r") != "").select(F.regexp_extract(header, r"^\S*", 0).alias("id"), header.alias("header"), seq.alias("seq"))


def fasta_lines(sequences: DataFrame, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """(value): a header line and a sequence line in one row each."""
    return sequences.where(F.col(seq_col).isNotNull()).select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), F.col(seq_col)).alias("value"))


def write_fasta(sequences: DataFrame, path: str, id_col: str = "id", seq_col: str = "seq") -> None:
    fasta_lines(sequences, id_col, seq_col).write.mode("overwrite").text(path)


def append_sequences(base: DataFrame, more: DataFrame) -> DataFrame:
    """Both, as they are."""
    return base.unionByName(more)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated hit table with a header; what is no number becomes null."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=HITS)
    return raw.withColumns({c: F.col(c).try_cast("double") for c in ("fident", "alnlen", "qlen", "tlen", "evalue")})


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """(annotation_id, clustering_id) of a gene table; rows without either go."""
    return spark.read.csv(path, header=True).select("annotation_id", "clustering_id").na.drop()


def read_list(spark: SparkSession, path: str, column: str = "path") -> DataFrame:
    """The lines that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias(column)).where(F.col(column) != "")


def read_graph_list(spark: SparkSession, path: str) -> list[str]:
    """The paths of a graph list in its order; it is as long as there are graphs to fold."""
    paths = [r["value"].split("\t")[0] for r in spark.read.text(path).collect() if r["value"].strip()]
    if not paths:
        raise ValueError(f"{path} lists no graph")
    return paths


def require(spark: SparkSession, paths: list[str]) -> None:
    """Refuse a plan over inputs that are not there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for p in paths:
        place = hadoop.Path(p)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            raise FileNotFoundError(p)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, member, bounds) of a cluster file, whose clusters begin at lines with >.

    bounds are the numbers after " at ", where an alignment was printed. A record is a whole cluster, so
    that no running number is needed.
    """
    blocks = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>", "").alias("b"))
    lines = blocks.select(F.regexp_extract("b", r"^Cluster\s+(\d+)", 1).try_cast("int").alias("cluster"), F.explode(F.split("b", "\n")).alias("line")).where(F.col("line").contains(">"))
    return lines.select("cluster", F.regexp_extract("line", r">(.+?)\.\.\.", 1).alias("member"), F.regexp_extract("line", r" at ([\d:]+)", 1).alias("bounds"))


def read_strain_clusters(spark: SparkSession, glob: str) -> DataFrame:
    """(sample, cluster) of all files of a pattern, each with a header."""
    return spark.read.csv(glob, header=True).toDF("sample", "cluster")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows of GFF files."""
    schema = "seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"
    return spark.read.csv(path, sep="\t", comment="#", schema=schema).where("type is not null")


def write_by_cluster(rows: DataFrame, path: str, cluster: str = "part", value: str = "path") -> None:
    """A folder of text for each cluster."""
    rows.select(F.col(cluster), F.col(value)).repartition(cluster, F.pmod(F.xxhash64(value), F.lit(8))).write.mode("overwrite").partitionBy(cluster).text(path)


def write_index(rows: DataFrame, path: str, column: str) -> None:
    """The distinct values in order."""
    rows.select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def running_clusters(lines: DataFrame, order: str, line: str = "line") -> DataFrame:
    """lines with cluster, the number of header lines so far; for one file's lines."""
    head = F.col(line).startswith(">").cast("int")
    return lines.withColumn("cluster", F.sum(head).over(Window.orderBy(order)) - 1)
