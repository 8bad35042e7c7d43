"""python -m graphfold --component-graphs LIST --outdir DIR [--mode test --graph-all DIR]"""

from __future__ import annotations

import argparse


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphfold", description="Fold component graphs into one.")
    parser.add_argument("--component-graphs", required=True, help="a file with the folder of one graph a line; their order matters")
    parser.add_argument("--outdir", required=True)
    parser.add_argument("--mode", choices=("run", "test"), default="run")
    parser.add_argument("--graph-all", help="the folder of the graph to compare with in test mode")
    parser.add_argument("--family-threshold", type=float, default=0.7)
    parser.add_argument("--context-threshold", type=float, default=0.7)
    parser.add_argument("--metadata-in-graph", action="store_true")
    parser.add_argument("--step-graphs", action="store_true", help="write the graph of every step, not of the last only")
    options = parser.parse_args(arguments)
    if options.mode == "test" and not options.graph_all:
        parser.error("--mode test needs --graph-all")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from graphfold.plans import run

    spark = SparkSession.builder.appName("graphfold").getOrCreate()
    test = options.mode == "test"
    chosen = run.RunOptions(options.family_threshold, options.context_threshold, metadata_in_graph=options.metadata_in_graph, step_graphs=options.step_graphs, truth=options.graph_all if test else None)
    _, seqids, _ = run.merge_graphs(spark, options.component_graphs, options.outdir, chosen)
    if test:
        truth = run.load(spark, options.graph_all, 0, options.graph_all).lists.where("kind = 'seqid'").select("node_id", F.col("value").alias("seqid"))
        scores = run.agreement(seqids, truth)
        scores.write.mode("overwrite").json(f"{options.outdir}/agreement")
        print(scores.first().asDict())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
