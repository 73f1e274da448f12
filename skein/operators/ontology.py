"""Ontologies: closure of a relation and what rolls up along it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.draws import numbered_within
from skein.functions.scratch import materialise


#: Rounds after which a closure's parts are written as one table, so that no plan grows with the depth.
TOGETHER = 16


def closure(isa: DataFrame) -> DataFrame:
    """descendant, ancestor, all pairs reachable along (child, parent), at any depth: the frontier joins the relation until nothing is new. In a cycle all are each other's and their own ancestors."""
    edge = isa.select("child", "parent").distinct()
    reached = frontier = edge.select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor"))
    step = 0
    while True:
        step += 1
        up = frontier.join(edge, F.col("ancestor") == F.col("child")).select("descendant", F.col("parent").alias("ancestor")).distinct()
        frontier = materialise(up.join(reached, ["descendant", "ancestor"], "left_anti"), f"closure-{step}")
        if not frontier.limit(1).count():
            return reached
        reached = reached.unionByName(frontier)
        if step % TOGETHER == 0:
            reached = materialise(reached, "closure")


def group_genes(isa: DataFrame, genes: DataFrame, root: str) -> DataFrame:
    """group, gene: distinct genes of the descendants of each child of ``root``; a group's own genes count only below it. genes: term, gene."""
    groups = isa.where(F.col("parent") == root).select(F.col("child").alias("group"))
    below = closure(isa).join(groups, F.col("ancestor") == F.col("group")).select("group", F.col("descendant").alias("term"))
    return below.join(genes, "term").select("group", "gene").distinct()


def information_content(isa: DataFrame, genes: DataFrame) -> DataFrame:
    """term, ic: minus the logarithm of the share of all genes that a term and its descendants have."""
    own = genes.select("term", "gene")
    rolled = own.union(closure(isa).join(own, F.col("descendant") == F.col("term")).select(F.col("ancestor").alias("term"), "gene")).distinct()
    total = genes.agg(F.count_distinct("gene").alias("total"))
    return rolled.groupBy("term").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("term", (-F.log(F.col("n") / F.col("total"))).alias("ic"))


def _pairs_with_graphs(edge: DataFrame, genes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with x_own, x_above, x_parents of a and y_own, y_above, y_parents of b: a gene's small graph as three arrays of numbers. edge: child, parent, id; genes: term, gene; pairs: a, b.

    own holds the edges above the gene's own terms, above the edges above their ancestors, parents each parent once, by the least id of its edges. A gene's arrays are
    made once; a pair moves those of one end, and no row for each of its nodes.
    """
    own = genes.select("gene", "term").distinct()
    above = own.join(closure(edge), F.col("term") == F.col("descendant")).select("gene", F.col("ancestor").alias("node"))
    nodes = own.select("gene", F.col("term").alias("node"), F.lit(True).alias("own")).unionByName(above.withColumn("own", F.lit(False)))
    nodes = nodes.groupBy("gene", "node").agg(F.max("own").alias("own"))
    numbered = edge.join(edge.groupBy("parent").agg(F.min("id").alias("up")), "parent").select(F.col("child").alias("node"), "id", "up")
    held = nodes.join(numbered, "node").groupBy("gene").agg(
        F.array_sort(F.collect_list(F.when(F.col("own"), F.col("id")))).alias("own"), F.array_sort(F.collect_list(F.when(~F.col("own"), F.col("id")))).alias("above"), F.array_sort(F.collect_set("up")).alias("parents")
    )
    held = materialise(held, "gene-graphs")
    none = F.array().cast("array<int>")
    for end, side in (("a", "x"), ("b", "y")):
        pairs = pairs.join(held.select(F.col("gene").alias(end), *(F.col(c).alias(f"{side}_{c}") for c in ("own", "above", "parents"))), end, "left")
    return pairs.select("a", "b", *(F.coalesce(f"{side}_{c}", none).alias(f"{side}_{c}") for side in "xy" for c in ("own", "above", "parents")))


def _numbered_edges(isa: DataFrame) -> DataFrame:
    edge = numbered_within(isa.select("child", "parent").distinct().withColumn("all", F.lit(1)), ["all"], "child", "id")
    return materialise(edge.select("child", "parent", F.col("id").cast("int").alias("id")), "isa-edges")


def pair_subgraphs(isa: DataFrame, genes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, child, parent, label: for every pair of genes the relation among their terms and all ancestors of these. isa: child, parent; genes: term, gene; pairs: a, b.

    label says whose own term the child is: both, first, second, or none, which is an ancestor only. A gene's ancestors are found once, whatever its pairs;
    a pair's rows are the edges of its own small graph.
    """
    edge = _numbered_edges(isa)
    held = _pairs_with_graphs(edge, genes, pairs)
    every = held.withColumn("id", F.explode(F.array_distinct(F.concat("x_own", "x_above", "y_own", "y_above"))))
    first, second = (F.array_contains(f"{side}_own", F.col("id")) for side in "xy")
    label = F.when(first & second, "both").when(first, "first").when(second, "second").otherwise("none")
    return every.select("a", "b", "id", label.alias("label")).join(edge, "id").select("a", "b", "child", "parent", "label")


def pair_subgraph_counts(isa: DataFrame, genes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, n, both_n, first_n, second_n, parents: how many edges ``pair_subgraphs`` has, by label, and how many distinct parents, without making its rows."""
    held = _pairs_with_graphs(_numbered_edges(isa), genes, pairs)
    size = lambda c: F.size(c).cast("long")
    shared = lambda one, two: size(F.array_intersect(f"x_{one}", f"y_{two}"))
    held = held.withColumn("both_n", shared("own", "own"))
    common = F.col("both_n") + shared("own", "above") + shared("above", "own") + shared("above", "above")
    total = size("x_own") + size("x_above") + size("y_own") + size("y_above")
    counts = (total - common).alias("n"), F.col("both_n"), (size("x_own") - F.col("both_n")).alias("first_n"), (size("y_own") - F.col("both_n")).alias("second_n")
    return held.select("a", "b", *counts, (size("x_parents") + size("y_parents") - shared("parents", "parents")).alias("parents")).where("n > 0")


def set_overlaps(members: DataFrame) -> DataFrame:
    """name1, name2, shared, jaccard, overlap of the sets that share a member. members: name, node, distinct."""
    size = members.groupBy("name").agg(F.count("*").alias("size"))
    x, y = members.select(F.col("name").alias("name1"), "node"), members.select(F.col("name").alias("name2"), "node")
    shared = x.join(y, "node").where("name1 < name2").groupBy("name1", "name2").agg(F.count("*").alias("shared"))
    found = shared.join(size.select(F.col("name").alias("name1"), F.col("size").alias("n1")), "name1").join(size.select(F.col("name").alias("name2"), F.col("size").alias("n2")), "name2")
    return found.select("name1", "name2", "shared", (F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.least("n1", "n2")).alias("overlap"))


def set_similarity(tables: DataFrame, members: DataFrame) -> DataFrame:
    """name1, name2, layer, similarity: the mean score of the rows of a table between two sets, members in either order, and the mean of all rows as ``random``.

    tables: layer (the table's name), a, b, n (the score); members: name, node. A row that fits in both orders counts twice.
    """
    x, y = members.select(F.col("name").alias("x"), F.col("node").alias("a")), members.select(F.col("name").alias("y"), F.col("node").alias("b"))
    hit = tables.join(x, "a").join(y, "b").where("x <> y")
    pairs = hit.groupBy(F.least("x", "y").alias("name1"), F.greatest("x", "y").alias("name2"), "layer").agg(F.avg("n").alias("similarity"))
    return pairs.unionByName(tables.groupBy("layer").agg(F.avg("n").alias("similarity")).select(F.lit("random").alias("name1"), F.lit("random").alias("name2"), "layer", "similarity"))
