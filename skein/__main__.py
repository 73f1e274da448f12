"""Localisation of named sets in networks from text files: largest components against random sets, classified, and the separation of pairs of sets.

python -m skein GRAPHS SETS OUT [SUFFIX] [--min 20] [--max 2000] [--pairs] [--distances] [--trials 1000]
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.scratch import materialise
from skein.operators import build, components, paths, search
from skein.plans.graph import classified
from skein.sources import files


def localise(spark: SparkSession, graphs: str, sets: str, least: int = 20, most: int = 2000, trials: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges, nodes, members and significance of the sets of ``least`` to ``most`` members in every layer of the folder ``graphs``."""
    raw = materialise(files.read_edge_lists(spark, graphs), "raw")
    edges, nodes = materialise(build.canonical(raw, by=("layer",)), "edges"), materialise(build.graph_nodes(raw, by=("layer",)), "nodes")
    members = materialise(files.read_memberships(spark, sets, least, most), "members")
    return edges, nodes, members, components.significance(edges, nodes, members, trials)


def main(argv: list[str] | None = None) -> None:
    parse = argparse.ArgumentParser(prog="skein", description=__doc__)
    for name in ("graphs", "sets", "out"):
        parse.add_argument(name)
    parse.add_argument("suffix", nargs="?", default="")
    for name, value in (("--min", 20), ("--max", 2000), ("--trials", 1000)):
        parse.add_argument(name, type=int, default=value)
    parse.add_argument("--pairs", action="store_true")
    parse.add_argument("--distances", action="store_true")
    at = parse.parse_args(argv)
    spark = SparkSession.builder.appName("skein").getOrCreate()
    edges, nodes, members, found = localise(spark, at.graphs, at.sets, at.min, at.max, at.trials)
    put = lambda df, name: files.write_table(df, os.path.join(at.out, f"{name}{at.suffix}"))
    found = materialise(found, "found")
    put(found, "localisation")
    put(classified(found), "significant")
    if at.distances:
        put(paths.closest_significance(edges, nodes, members, at.trials), "distances")
    if at.pairs:
        inside = materialise(nodes.join(members, "node").select("name", "layer", "node"), "inside")
        near, to_sets = search.closest(edges, inside)
        own = near.groupBy("name", "layer").agg(F.avg("near").alias("closest"), F.count("*").alias("n")).where("n >= 10")
        put(paths.separation(materialise(own, "within"), paths.between(to_sets, inside)), "pairs")


if __name__ == "__main__":
    main()
