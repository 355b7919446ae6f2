"""The architecture of a repository: modules or files with their size, complexity, references and cycles.

    files       repo_id, path, lines, analysis        analysed as JavaScript or Python
    functions   repo_id, path, complexity
    edges       repo_id, src, dst, weight              between files, of imports.file_edges

A graph of modules is whole unless limits are asked for; the sizes up to which there is a graph of files are part of the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treegauge.functions import text as T
from treegauge.operators import graph as G
from treegauge.operators import imports as I
from treegauge.scratch import written

#: The limits of a graph of modules that is meant to be looked at.
MOST_MODULES, MOST_EDGES = 80, 120
MOST_FILES, MOST_FILE_EDGES = 100, 250


def file_nodes(files: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo_id, id, loc, complexity): the largest complexity among a file's functions, or 0."""
    worst = functions.groupBy("repo_id", "path").agg(F.max("complexity").alias("complexity"))
    own = files.join(worst, ["repo_id", "path"], "left")
    return own.select("repo_id", F.col("path").alias("id"), F.col("lines").alias("loc"), F.coalesce("complexity", F.lit(0)).alias("complexity"))


def module_nodes(files: DataFrame, functions: DataFrame, most: int | None = None) -> DataFrame:
    """(repo_id, id, loc, complexity) of all modules, or of the first `most` in file order."""
    m = file_nodes(files, functions).groupBy("repo_id", T.module_of(F.col("id")).alias("id")).agg(F.sum("loc").alias("loc"), F.max("complexity").alias("complexity"), F.min(T.file_order("id")).alias("first"))
    if most is not None:
        w = Window.partitionBy("repo_id").orderBy("first")
        m = m.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")
    return m.drop("first")


def module_graph(files: DataFrame, functions: DataFrame, edges: DataFrame, most: int | None = None, most_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All modules and the edges between them, or the first `most` modules and the `most_edges` heaviest edges between those."""
    nodes = module_nodes(files, functions, most)
    own = G.on_nodes(I.module_edges(edges), nodes)
    if most_edges is not None:
        return _decorated(nodes, G.top_edges(own, most_edges))
    return _decorated(nodes, written(own), G.strong_components)


def file_graph(files: DataFrame, functions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only of repositories of few files and edges; edges are not cut."""
    few = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= MOST_FILES)
    many = edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_FILE_EDGES)
    small = few.select("repo_id").join(many, "repo_id", "left_anti")
    return _decorated(file_nodes(files, functions).join(small, "repo_id", "left_semi"), edges.join(small, "repo_id", "left_semi"))


def _decorated(nodes: DataFrame, edges: DataFrame, cycles: Callable[[DataFrame], DataFrame] = G.cycles) -> tuple[DataFrame, DataFrame]:
    """nodes with fan_in, fan_out, in_cycle, and edges with in_cycle: both their ends are in cycles."""
    looped = cycles(edges).select("repo_id", "id").distinct().withColumn("loop", F.lit(True))
    n = nodes.join(G.fans(edges), ["repo_id", "id"], "left").join(looped, ["repo_id", "id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    n = n.select("repo_id", "id", "loc", "complexity", zero("fan_in"), zero("fan_out"), F.coalesce("loop", F.lit(False)).alias("in_cycle"))
    e = edges
    for end in ("src", "dst"):
        e = e.join(looped.select("repo_id", F.col("id").alias(end), F.col("loop").alias(f"_{end}")), ["repo_id", end], "left")
    return n, e.select("repo_id", "src", "dst", "weight", (F.col("_src").isNotNull() & F.col("_dst").isNotNull()).alias("in_cycle"))


def coloured(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes with fill, stroke and label, edges with stroke: the colours that tell what is in a cycle."""
    n = nodes.select("*", *[T.cycle_colour(F.col("in_cycle"), part).alias(part) for part in ("fill", "stroke", "label")])
    return n, edges.withColumn("stroke", T.cycle_colour(F.col("in_cycle"), "edge"))


def top_fan_in(nodes: DataFrame, most: int = 5) -> DataFrame:
    """(repo_id, place, id, fan_in); of equal ones the larger first."""
    w = Window.partitionBy("repo_id").orderBy(F.desc("fan_in"), F.desc("loc"), "id")
    return nodes.select("repo_id", F.row_number().over(w).alias("place"), "id", "fan_in").where(F.col("place") <= most)


def top_packages(refs: DataFrame, most: int = 15) -> DataFrame:
    """(repo_id, place, package, n) of the packages most imported."""
    w = Window.partitionBy("repo_id").orderBy(F.desc("n"), "package")
    return I.packages(refs).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def unresolved(found: DataFrame) -> DataFrame:
    """(repo_id, unresolved): references of imports.links that no file answers."""
    return found.groupBy("repo_id").agg(F.sum(F.when(F.col("target").isNull(), F.col("n")).otherwise(0)).alias("unresolved"))


def radii(nodes: DataFrame) -> DataFrame:
    """nodes with radius: how large each is drawn beside the largest of its repository."""
    most = F.greatest(F.max("loc").over(Window.partitionBy("repo_id")), F.lit(1))
    return nodes.withColumn("radius", 12 + F.sqrt(F.col("loc") / most * 26))
