"""The order in which formulas could be evaluated: each node's level in the reference graph, and what hangs on a cycle.

A node without references has level 0, any other one more than the highest level it refers to; a node in a cycle, or that
reaches one, has none. Edges are trimmed in rounds, each a written table of the edges that are left with their nodes'
states. A round settles the nodes whose references are all settled, and then lets every edge whose target has
one open reference left jump over that target: an edge carries the steps it stands for, a node the level that its settled
references alone give it, so nothing is lost by a jump. Chains such as running totals, however long, take a number of
rounds that grows with the logarithm of their length; other graphs take as many as they have levels of nodes with several
open references. The joins are by (workbook, node) over plain scans, so that the planner can split a node that a third of
all formulas refer to.

An edge also carries the least node that it leads to or has jumped over. Where that is its own source, the source is in a
cycle, and so is all that leads to it or over it: these go at once, so a cycle takes rounds by the logarithm of its own
length and not of the graph's size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.sources.tables import written

KEY = ["sha256", "id"]


def node_levels(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(sha256, id, level, cyclic) of each node of edges (sha256, source, target). Equal edges count once; rows without a
    source or target are no edges; max_rounds is for tests."""
    pairs = edges.where("source is not null and target is not null").selectExpr("sha256", "source as s", "target as t").distinct()
    left = written(pairs.selectExpr("*", "1L as w", "1L as base", "t as low"))
    targets, sources = left.selectExpr("sha256", "t as id").distinct(), left.selectExpr("sha256", "s as id")
    settled = written(targets.join(sources, KEY, "left_anti").selectExpr("sha256", "id", "0L as level"))
    done, circling, dead, idle, rounds = settled, [], None, 0, 0
    while True:
        # what is settled gives its sources a level at least; the edges to it go. A node has as many rows as open references
        met = left.join(settled.selectExpr("sha256", "id as t", "level"), ["sha256", "t"], "left")
        own = "over (partition by sha256, s)"
        state = met.selectExpr(
            "sha256", "s", "t", "w", "low", "level", f"max(greatest(base, coalesce(level + w, 0))) {own} as b", f"sum(if(level is null, 1, 0)) {own} as open", "row_number() over (partition by sha256, s order by t) as nth",
        )
        state = written(state.where("level is null or open = 0 and nth = 1").drop("nth"))
        settled = state.where("open = 0").selectExpr("sha256", "s as id", "b as level")
        done = done.unionByName(settled)
        # a node with one open reference is passed: its own level is at least b, and w more than its reference's
        rest = state.where("open > 0")
        passed = rest.where("open = 1").selectExpr("sha256", "s as t", "t as t2", "w as w2", "b as b2", "low as low2")
        jumped = rest.join(passed, ["sha256", "t"], "left").selectExpr("sha256", "s", "coalesce(t2, t) as t", "w + coalesce(w2, 0) as w", "greatest(b, coalesce(b2 + w, 0)) as base", "least(low, low2) as low", "open")
        jumped = written(jumped)
        several = jumped.where("open > 1").groupBy("sha256", "s", "t").agg(F.max("w").alias("w"), F.max("base").alias("base"), F.min("low").alias("low"))
        left = jumped.where("open = 1").drop("open").unionByName(several)  # only references of one node can have become equal
        # what leads to or over a node that leads to itself, or to what was found so in the round before, has no level
        marks = jumped.where("low = s").selectExpr("sha256", "s as id")
        marks = marks if dead is None else marks.unionByName(dead)
        dead = None
        if not marks.isEmpty():
            marks = written(marks.distinct())
            ends = jumped.selectExpr("sha256", "s", "explode(array_distinct(array(t, low))) as id")
            dead = written(ends.join(marks, KEY, "left_semi").selectExpr("sha256", "s as id").distinct())
            circling.append(dead)
            left = written(left.join(dead.withColumnRenamed("id", "s"), ["sha256", "s"], "left_anti"))
            dead = None if dead.isEmpty() else dead
        rounds += 1
        n = left.count() if circling else jumped.count()  # of a written table: its footers say
        if not n or rounds == max_rounds:
            break
        # chains halve with each round; if nothing has been settled for so many, what is left turns in circles
        idle = 0 if dead is not None or not settled.isEmpty() else idle + 1
        if idle > 2 + math.log2(n + 1):
            break
    out = done.selectExpr(*KEY, "level", "false as cyclic")
    for nodes in (*circling, left.selectExpr("sha256", "s as id").distinct()):
        out = out.unionByName(nodes.selectExpr(*KEY, "cast(null as bigint) as level", "true as cyclic"))
    return out
