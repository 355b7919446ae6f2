"""Places for the nodes of a small graph by forces, the same on every run: one repository's graph is one group."""

from __future__ import annotations

from math import cos, pi, sin, sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treegauge.workers import ship

# fixed values: size of the drawing, its margins, rounds, and the strength of each force
WIDTH, HEIGHT, MARGIN_X, MARGIN_Y = 860, 560, 70, 50
ROUNDS, REPULSION, SPRING, LENGTH, GRAVITY = 260, 14000, 0.015, 110, 0.025


def settle(n: int, springs: list[tuple[int, int, float]]) -> list[tuple[float, float]]:
    """Where n nodes come to rest that start on a circle; moves take effect at once, in the order of nodes and springs."""
    ring = min(WIDTH, HEIGHT) / 4
    xs = [WIDTH / 2 + cos(2 * pi * i / n) * ring for i in range(n)]
    ys = [HEIGHT / 2 + sin(2 * pi * i / n) * ring for i in range(n)]

    def push(i: int, j: int, dx: float, dy: float, force: float) -> None:
        """Moves j along (dx, dy) and i against it."""
        xs[i], ys[i] = xs[i] - dx * force, ys[i] - dy * force
        xs[j], ys[j] = xs[j] + dx * force, ys[j] + dy * force

    for turn in range(ROUNDS):
        heat = 1 - turn / ROUNDS
        for i in range(n):
            for j in range(i + 1, n):
                dx, dy = xs[j] - xs[i], ys[j] - ys[i]
                if dx * dx + dy * dy < 1:
                    dx, dy = (i - j) * 0.7 + 0.3, (j - i) * 0.7 + 0.3
                square = dx * dx + dy * dy
                push(i, j, dx, dy, REPULSION / square / sqrt(square) * heat)
        for i, j, weight in springs:
            dx, dy = xs[j] - xs[i], ys[j] - ys[i]
            far = max(1.0, sqrt(dx * dx + dy * dy))
            push(i, j, dx, dy, -(far - LENGTH) * SPRING * min(2, weight) / far * heat)
        for at, size, margin in ((xs, WIDTH, MARGIN_X), (ys, HEIGHT, MARGIN_Y)):
            at[:] = [max(margin, min(size - margin, v + (size / 2 - v) * GRAVITY * heat)) for v in at]
    return list(zip(xs, ys, strict=True))


def layout(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, id, x, y) for nodes (repo_id, id, loc), the largest first, and edges (repo_id, src, dst, weight); its time goes with the square of a repository's nodes."""

    def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["repo_id", "id", "x", "y"])
        left = left.sort_values(["loc", "id"], ascending=[False, True])
        at = {v: i for i, v in enumerate(left["id"])}
        right = right.sort_values(["weight", "src", "dst"], ascending=[False, True, True])
        springs = [(at[a], at[b], w) for a, b, w in zip(right["src"], right["dst"], right["weight"], strict=True) if a in at and b in at]
        xy = settle(len(left), springs)
        return pd.DataFrame({"repo_id": left["repo_id"], "id": left["id"], "x": [p[0] for p in xy], "y": [p[1] for p in xy]})

    ship(nodes.sparkSession)
    kind = dict(nodes.dtypes)
    pair = nodes.select("repo_id", "id", "loc").groupBy("repo_id").cogroup(edges.select("repo_id", "src", "dst", F.col("weight").cast("double").alias("weight")).groupBy("repo_id"))
    return pair.applyInPandas(place, f"repo_id {kind['repo_id']}, id {kind['id']}, x double, y double")
