"""Command line: run, multiround, summary, info, split, merge, shuffle, from-smiles."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from .operators import analysis, cluster, metrics, pairs
from .sources import npy, smiles


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bitloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *outputs: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("input")
        for o in outputs:
            c.add_argument(o)
        c.add_argument("--overwrite", action="store_true")
        return c

    for name in ("run", "multiround"):
        c = command(name, "output")
        c.add_argument("--n-features", type=int)
        c.add_argument("--unpacked", action="store_true")
        c.add_argument("--threshold", type=float, default=0.30)
        c.add_argument("--branching-factor", type=int, default=254)
        c.add_argument("--merge-criterion", default="diameter")
        c.add_argument("--refine-merge-criterion", default="tolerance-diameter")
        c.add_argument("--tolerance", type=float, default=0.05)
        c.add_argument("--threshold-change", type=float, default=0.0)
        c.add_argument("--refine-rounds", type=int, default=0)
        c.add_argument("--refine-num", type=int, default=1)
        c.add_argument("--recluster-rounds", type=int, default=0)
        c.add_argument("--seed", type=int, help="shuffle summaries when reclustering")
        c.add_argument("--bin-size", type=int, default=10)
        c.add_argument("--midsection-rounds", type=int, default=1)
        c.add_argument("--max-fps", type=int)
        c.add_argument("--one-tree", action="store_true", help="one tree, whatever the number of rows")
        c.add_argument("--split-largest", action="store_true", help="take the largest clusters apart between rounds")
    c = command("summary")
    c.add_argument("fps", help="folder of fingerprint files")
    c.add_argument("--top", type=int, default=20)
    c.add_argument("--output", help="folder for the table as CSV")
    c.add_argument("--metrics", action="store_true")
    command("info")
    c = command("split", "output")
    c.add_argument("--parts", type=int)
    c.add_argument("--max-fps-per-file", type=int)
    c = command("merge", "output")
    c.add_argument("--max-fps-per-file", type=int, default=1_000_000)
    c = command("shuffle", "output")
    c.add_argument("--seed", type=int, required=True)
    c = command("from-smiles", "output")
    c.add_argument("--kind", default="substrings4")
    c.add_argument("--n-features", type=int, default=2048)
    c.add_argument("--skip-invalid", action="store_true")
    c.add_argument("--max-fps-per-file", type=int, help="write .npy files of so many rows instead of a table")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("bitloom").getOrCreate()
    mode = "overwrite" if a.overwrite else "errorifexists"
    began = time.time()
    if a.command in ("run", "multiround"):
        fps = npy.read_npy(spark, a.input, a.n_features, not a.unpacked, a.max_fps)
        width = a.n_features or 64 * fps.select(F.size("words")).first()[0]
        params = cluster.Params(a.threshold, a.branching_factor, a.merge_criterion, a.tolerance)
        if a.command == "run":
            steps = [cluster.Refine(a.refine_num, a.refine_merge_criterion, a.threshold_change, a.tolerance) for _ in range(a.refine_rounds)]
            steps += [cluster.Recluster(a.recluster_rounds, seed=a.seed)] if a.recluster_rounds else []
            found, members = cluster.fit_all(fps, width, params, steps, one_tree=a.one_tree)
            found = found.cache()
        else:
            files = fps.select("file").distinct().withColumn("part", F.row_number().over(Window.orderBy("file")).cast("long"))
            part = fps.join(pairs.small(files, 0), "file")  # one row per file
            rounds = cluster.Rounds(a.bin_size, a.midsection_rounds, a.refine_merge_criterion, None, a.threshold_change, tolerance=a.tolerance, split_largest=a.split_largest)
            found, members = cluster.multiround(part, width, params, rounds)
        found.write.mode(mode).parquet(f"{a.output}/clusters")
        fitted = time.time()
        cluster.cluster_centroids(found, width).select("label", "n", "words").write.mode(mode).parquet(f"{a.output}/centroids")
        members.write.mode(mode).parquet(f"{a.output}/assignments")
        smiles.write_run(spark, a.output, vars(a), {"read and fit": fitted - began, "total": time.time() - began})
        print(json.dumps(vars(a) | {"seconds": round(time.time() - began, 3)}))
    elif a.command == "summary":
        members = spark.read.parquet(f"{a.input}/assignments")
        fps = npy.read_npy(spark, a.fps)
        width = 64 * fps.select(F.size("words")).first()[0]
        analysis.size_stats(members).show(truncate=False)
        analysis.summary_ratios(members).show(truncate=False)
        table = analysis.cluster_analysis(members, fps, width, a.top).orderBy("rank").cache()
        table.show(a.top, truncate=False)
        if a.output:
            smiles.write_metrics(table, a.output)
        if a.metrics:
            largest = analysis.top_clusters(members, 100, 1).select("label")
            rows = members.join(F.broadcast(largest), "label", "left_semi").join(fps.select("fp_id", "words"), "fp_id").cache()
            metrics.chi(rows, width).crossJoin(metrics.dbi(rows, width)).crossJoin(metrics.dunn(rows, width)).show()
    elif a.command == "info":
        npy.file_info(spark, a.input).orderBy("path").show(1000, truncate=False)
    elif a.command == "split":
        npy.split(npy.read_npy(spark, a.input), a.parts, a.max_fps_per_file).write.mode(mode).partitionBy("part").parquet(a.output)
    elif a.command == "merge":
        # numbers run on over the files, by name
        npy.write_npy(npy.read_npy(spark, a.input), a.output, 64 * npy.read_npy(spark, a.input).select(F.size("words")).first()[0], a.max_fps_per_file)
    elif a.command == "shuffle":
        npy.shuffle(npy.read_npy(spark, a.input), a.seed).write.mode(mode).parquet(a.output)
    else:
        fps = smiles.fps_from_smiles(smiles.read_smiles(spark, a.input), a.kind, a.n_features, a.skip_invalid)
        fps = smiles.valid(fps)
        if a.max_fps_per_file:
            npy.write_npy(fps, a.output, a.n_features, a.max_fps_per_file)
        else:
            fps.write.mode(mode).parquet(a.output)


if __name__ == "__main__":
    main()
