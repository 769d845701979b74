"""Call and link graphs: one hop, bounded trees, breadth-first search and shortest paths."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import settled

#: Bounds of depth, and of the nodes that a search may reach.
DEPTH, NODES = 10, 200_000


def callers(calls: DataFrame, symbol: str) -> DataFrame:
    """Edges into `symbol`."""
    return calls.filter(F.col("callee") == symbol)


def callees(calls: DataFrame, symbol: str) -> DataFrame:
    """Edges out of `symbol`."""
    return calls.filter(F.col("caller") == symbol)


def _levels(edges: DataFrame, start: str, depth: int, stop: str | None, terminal: str | None, most: int) -> tuple[list[DataFrame], bool, bool]:
    """Tables (dst, parent) of each level of a breadth-first search from `start`; whether depth or nodes ran out.

    edges: (src, dst, pick, ...), pick orders the edges to a node: its least (pick, src) is its parent. Each level is
    written once, so the plan doesn't grow. terminal: a flag of edges whose far end isn't expanded.
    """
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start,)], "node string")
    frontier, levels, reached = seen, [], 1
    rest = [F.col(c) for c in edges.columns if c not in ("src", "dst")]
    flag = F.col(terminal) if terminal else F.lit(False)
    for _ in range(depth):
        step = edges.join(frontier.withColumnRenamed("node", "src"), "src").join(seen.withColumnRenamed("node", "dst"), "dst", "left_anti")
        best = step.groupBy("dst").agg(F.min(F.struct(F.col("pick"), F.col("src"), F.struct(*rest).alias("edge"), flag.alias("closed"))).alias("parent"))
        level = settled(best.select("dst", "parent.src", "parent.edge", "parent.closed"), "bfs")
        count = level.count()
        if not count:
            return levels, False, False
        levels.append(level)
        reached += count
        if stop is not None and level.filter(F.col("dst") == stop).limit(1).count():
            return levels, False, False
        if reached >= most:
            return levels, False, True
        seen = seen.union(level.select("dst"))
        frontier = level.filter("NOT closed").select(F.col("dst").alias("node"))
    return levels, True, False


def depths(edges: DataFrame, start: str, depth: int, terminal: str | None = None, most: int = NODES) -> DataFrame:
    """(node, depth): each node that can be reached from `start` in at most `depth` steps, with the fewest."""
    levels, _, _ = _levels(edges, start, min(max(depth, 1), DEPTH), None, terminal, most)
    first = edges.sparkSession.createDataFrame([(start, 0)], "node string, depth long")
    return reduce(DataFrame.union, [first, *[x.select(F.col("dst").alias("node"), F.lit(i + 1).cast("long").alias("depth")) for i, x in enumerate(levels)]])


@dataclass(frozen=True)
class Walk:
    """A shortest path, and why none was found: the depth ran out while nodes were left to expand, or too many were reached."""

    rows: DataFrame
    depth_exhausted: bool = False
    nodes_capped: bool = False
    visited: int = 1


def path(edges: DataFrame, start: str, end: str, depth: int, terminal: str | None = None, most: int = NODES) -> DataFrame:
    """(step, src, dst, edge): a shortest path; no rows if there is none within `depth` or start is end."""
    return walk(edges, start, end, depth, terminal, most).rows


def walk(edges: DataFrame, start: str, end: str, depth: int, terminal: str | None = None, most: int = NODES) -> Walk:
    """A shortest path with the flags of its search. Walks back from the end over the levels: one row of each is looked at."""
    spark = edges.sparkSession
    rest = edges.select(F.struct(*[c for c in edges.columns if c not in ("src", "dst")]).alias("edge")).schema["edge"].dataType
    schema = f"step long, src string, dst string, edge {rest.simpleString()}"
    if start == end:
        return Walk(spark.createDataFrame([], schema))
    levels, deep, many = _levels(edges, start, min(max(depth, 1), DEPTH), end, terminal, most)
    visited = 1 + sum(level.count() for level in levels)
    rows, node = [], end
    for i in range(len(levels), 0, -1):
        found = levels[i - 1].filter(F.col("dst") == node).first()
        if found is None:
            return Walk(spark.createDataFrame([], schema), deep, many, visited)
        rows.append((i, found["src"], node, found["edge"]))
        node = found["src"]
    return Walk(spark.createDataFrame(rows[::-1], schema), deep and not rows, many and not rows, visited)


def tree(calls: DataFrame, root: str, direction: str = "callees", depth: int = 3, most: int = 200) -> DataFrame:
    """(depth, caller, callee, line, file_id): the edges of each level, once a level; the first `most` by depth, caller, callee.

    A node is expanded at every depth at which it is met, but once at each: a cycle ends with the depth.
    """
    near, far = ("caller", "callee") if direction == "callees" else ("callee", "caller")
    frontier = calls.sparkSession.createDataFrame([(root,)], "node string")
    out = []
    for d in range(1, min(max(depth, 1), DEPTH) + 1):
        level = calls.join(frontier, calls[near] == frontier["node"], "left_semi").distinct().withColumn("depth", F.lit(d).cast("long"))
        level = settled(level.select("depth", "caller", "callee", "line", "file_id"), "tree")
        out.append(level)
        frontier = level.select(F.col(far).alias("node")).distinct()
    return reduce(DataFrame.union, out).orderBy("depth", "caller", "callee", "line", "file_id").limit(min(max(most, 1), 5000))


def nested(edges: list[dict], root: str, direction: str = "callees") -> dict:
    """The edges of tree(), gathered, as a nested answer: a node met again at the same depth is marked repeated."""
    near, far = ("caller", "callee") if direction == "callees" else ("callee", "caller")
    below: dict[tuple[int, str], set[tuple[str, int]]] = {}
    for e in edges:
        below.setdefault((e["depth"], e[near]), set()).add((e[far], e["line"]))
    shown: set[tuple[int, str]] = set()

    def build(node: str, depth: int) -> dict:
        kids = below.get((depth + 1, node), set())
        if not kids:
            return {"name": node}
        if (depth, node) in shown:
            return {"name": node, "repeated": True}
        shown.add((depth, node))
        return {"name": node, "children": [build(child, depth + 1) | {"line": line} for child, line in sorted(kids)]}

    return build(root, 0)


def links(edges: DataFrame, start: str, direction: str = "out", depth: int = 1, limit: int = 100, whole: bool = False) -> DataFrame:
    """(depth, from_object, to_object, link_kind): edges met from an object, each once at its least depth.

    Links to universal objects are given but not followed. At most clamp(10 * limit, limit, 20000) edges, nearest first; `whole`: all
    of them, in no order.
    """
    src, dst = ("from_object", "to_object") if direction == "out" else ("to_object", "from_object")
    plain = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "link_kind", "is_universal")
    spark = edges.sparkSession
    seen = frontier = spark.createDataFrame([(start,)], "node string")
    out = []
    for d in range(1, min(max(depth, 1), 4) + 1):
        level = plain.join(frontier, plain["src"] == frontier["node"], "left_semi").withColumn("depth", F.lit(d).cast("long"))
        level = settled(level, "links")
        out.append(level)
        fresh = level.filter("NOT is_universal").select(F.col("dst").alias("node")).distinct()
        frontier = settled(fresh.join(seen, "node", "left_anti"), "links-next")
        seen = seen.union(frontier)
    cap = min(max(10 * limit, limit), 20_000)
    every = reduce(DataFrame.union, out).select("depth", F.col("src").alias(src), F.col("dst").alias(dst), "link_kind")
    if whole:
        return every.select("depth", "from_object", "to_object", "link_kind")
    return every.select("depth", "from_object", "to_object", "link_kind").orderBy("depth", "from_object", "to_object", "link_kind").limit(cap)
