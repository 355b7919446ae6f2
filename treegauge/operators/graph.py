"""Operators over module graphs: edges, fan-in and fan-out, cycles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treegauge.scratch import forget, met, written
from treegauge.workers import ship


def edge_weights(refs: DataFrame) -> DataFrame:
    """(repo_id, src, dst, weight) of references (repo_id, src, dst); self references are dropped."""
    return refs.where(F.col("src") != F.col("dst")).groupBy("repo_id", "src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def top_edges(edges: DataFrame, most: int = 120) -> DataFrame:
    w = Window.partitionBy("repo_id").orderBy(F.desc("weight"), "src", "dst")
    return edges.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")


def on_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among nodes (repo_id, id)."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select("repo_id", F.col("id").alias(end)), ["repo_id", end], "left_semi")
    return edges


def fans(edges: DataFrame) -> DataFrame:
    """(repo_id, id, fan_in, fan_out): weights that end and begin at a node; one shuffle of edge ends."""
    ends = edges.select("repo_id", F.explode(F.array(F.struct(F.col("dst").alias("id"), F.col("weight").alias("i"), F.lit(0).cast("long").alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).cast("long").alias("i"), F.col("weight").alias("o")))).alias("x"))
    return ends.groupBy("repo_id", F.col("x.id").alias("id")).agg(F.sum("x.i").alias("fan_in"), F.sum("x.o").alias("fan_out"))


def strongly_connected(nodes: list, edges: list[tuple]) -> list[list]:
    """Components of more than one node; iterative, in two passes over the edges."""
    forth: dict = {n: [] for n in nodes}
    back: dict = {n: [] for n in nodes}
    for a, b in edges:
        forth.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
        forth.setdefault(b, [])
        back.setdefault(a, [])
    order, seen = [], set()
    for root in forth:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(forth[root]))]
        while stack:
            node, rest = stack[-1]
            nxt = next((x for x in rest if x not in seen), None)
            if nxt is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(forth[nxt])))
    done, out = set(), []
    for root in reversed(order):
        if root in done:
            continue
        done.add(root)
        group, stack = [], [root]
        while stack:
            node = stack.pop()
            group.append(node)
            for x in back[node]:
                if x not in done:
                    done.add(x)
                    stack.append(x)
        if len(group) > 1:
            out.append(sorted(group))
    return sorted(out)


def cycles(edges: DataFrame) -> DataFrame:
    """(repo_id, cycle, id): members of the cycles of each repository's graph, which has at most 120 edges; see strong_components for others.

    A task's graphs follow each other, sorted, and it holds one of them: a call of Python takes a batch of edges, not a graph.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, out, kinds = None, [], [], None

        def settle() -> None:
            out.extend((at, g[0], n) for g in strongly_connected([], own) for n in g)
            own.clear()

        def shown() -> pa.RecordBatch:
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["repo_id", "cycle", "id"])

        for batch in batches:
            kinds = [batch.column(0).type, *[batch.column(1).type] * 2]
            for repo, src, dst in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if repo != at:
                    settle()
                    at = repo
                own.append((src, dst))
            if out:
                yield shown()
        settle()
        if out:
            yield shown()

    ship(edges.sparkSession)
    kind = dict(edges.dtypes)
    dealt = edges.select("repo_id", "src", "dst").repartition("repo_id").sortWithinPartitions("repo_id")
    return dealt.mapInArrow(run, f"repo_id {kind['repo_id']}, cycle {kind['src']}, id {kind['src']}")


def _spread(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of edges (a, b): the least of all nodes from which node can be reached, its own included.

    Labels go along edges, from nodes whose label moved in the round before, and then to the label of the label, since
    what reaches a node's label reaches the node. Each round is a written table; only whether anything moved comes back.
    """
    ends = F.explode(F.array(F.struct(F.col("b").alias("node"), F.col("a").alias("label")), F.struct(F.col("a").alias("node"), F.col("a").alias("label"))))
    label = written(edges.select(ends.alias("x")).select("x.*").groupBy("node").agg(F.min("label").alias("label")).select("node", F.least("node", "label").alias("label")))
    moved = label
    while True:
        at = moved.select(F.col("node").alias("a"), "label")
        near = edges.join(met(at), "a").select(F.col("b").alias("node"), "label", F.lit(None).cast("long").alias("was"))
        step = near.unionByName(label.withColumn("was", F.col("label"))).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        hop = label.select(F.col("node").alias("label"), F.col("label").alias("far"))
        nxt = written(step.join(met(hop), "label", "left").select("node", F.least("label", "far").alias("label"), "was"))
        forget(label)
        label, moved = nxt.select("node", "label"), nxt.where("label <> was").select("node", "label")
        label._treegauge_path = nxt._treegauge_path
        if moved.isEmpty():
            return label


def strong_components(edges: DataFrame, small: int = 10_000) -> DataFrame:
    """(repo_id, cycle, id): members of the cycles of graphs of any size; cycle is the least member.

    edges (repo_id, src, dst), src and dst strings. Nodes of one cycle have one forward label and, along
    edges within it, one backward label; a node whose two labels agree is in the cycle of the label's node, or
    alone in it. What is left goes on, in graphs that fall apart at random ranks, so the outer rounds follow the
    logarithm of the longest path and the inner ones the widest reach. A graph of at most `small` edges is one
    task's work at once, with the same result; no larger one is held by a task. Nodes of larger ones are numbered once, in the
    order of their hashes, so that rounds move two numbers an edge. Edges with a null end, and
    from a node to itself, are left out; edges may repeat.
    """
    every = written(edges.select("repo_id", "src", "dst").where("src <> dst").distinct())
    sizes = every.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.where(F.col("n") > small).select("repo_id"))
    if large.isEmpty():
        return cycles(every.where("repo_id is not null"))
    at_once = cycles(every.where("repo_id is not null").join(large, "repo_id", "left_anti"))
    own = every.join(large, "repo_id", "left_semi")
    ends = own.select("repo_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    name = written(ends.sortWithinPartitions(F.xxhash64("repo_id", "id")).withColumn("node", F.monotonically_increasing_id()))
    of = lambda c, node: met(name.select("repo_id", F.col("id").alias(c), F.col("node").alias(node)))
    live = written(own.join(of("src", "a"), ["repo_id", "src"]).join(of("dst", "b"), ["repo_id", "dst"]).select("a", "b"))
    found = []
    while not live.isEmpty():
        forth = _spread(live)
        to = lambda t, c, label: met(t.select(F.col("node").alias(c), F.col("label").alias(label)))
        inner = written(live.join(to(forth, "a", "x"), "a").join(to(forth, "b", "y"), "b").where("x = y").select("a", "b"))
        back = _spread(inner.select(F.col("b").alias("a"), F.col("a").alias("b")))
        settled = written(forth.join(to(back, "node", "other"), "node").where("label = other").select("node", F.col("label").alias("root")))
        found.append(settled)
        rest = None
        if settled.count() < back.count():
            rest = inner
            for end in ("a", "b"):
                rest = rest.join(met(settled.select(F.col("node").alias(end))), end, "left_anti")
            rest = written(rest.select("a", "b"))
        forget(live, inner, forth, back)
        if rest is None:
            break
        live = rest
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    held = out.join(met(name), "node")
    named = held.groupBy("root").agg(F.min("id").alias("cycle"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return at_once.union(held.join(named, "root").select("repo_id", "cycle", "id"))


def resolve(refs: DataFrame, files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """(repo_id, src, target, path): for each reference the first existing candidate target + suffix, without regard to case."""
    tried = refs.select("repo_id", "src", "target", F.posexplode(F.array(*[F.lower(F.concat("target", F.lit(s))) for s in suffixes])).alias("rank", "low"))
    known = files.select("repo_id", F.lower("path").alias("low"), "path")
    hit = tried.join(known, ["repo_id", "low"])
    return hit.groupBy("repo_id", "src", "target").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


