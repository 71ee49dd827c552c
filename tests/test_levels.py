import random

from gridspark.operators import levels
from gridspark.operators.levels import node_levels
from gridspark.sources.tables import temporary_tables


def brute(edges):
    out = {}
    for b, s, t in edges:
        if s is not None and t is not None:
            out.setdefault((b, s), set()).add((b, t))
            out.setdefault((b, t), set())
    level = {n: 0 for n, ts in out.items() if not ts}
    while True:
        more = {n: 1 + max(level[t] for t in ts) for n, ts in out.items() if n not in level and all(t in level for t in ts)}
        if not more:
            return {n: level.get(n) for n in out}
        level |= more


def got(spark, edges, **more):
    with temporary_tables(spark):
        rows = node_levels(spark.createDataFrame(edges, "sha256 string, source string, target string"), **more).collect()
    assert all(r.cyclic == (r.level is None) for r in rows)
    return {(r.sha256, r.id): r.level for r in rows}


def test_random_graphs(spark):
    rng = random.Random(1)
    edges = []
    for b in range(12):
        n = rng.randint(2, 14)
        for _ in range(rng.randint(1, 2 * n)):
            i, j = rng.randrange(n), rng.randrange(n)
            if b % 3 and i <= j:
                i, j = j + 1, i  # two of three books have no cycle
            edges.append((f"b{b}", f"n{i}", f"n{j}"))
    edges += edges[:5] + [("b0", None, "n1"), ("b0", "n1", None)]
    assert got(spark, edges) == brute(edges)


def test_chains_take_few_rounds_and_hot_nodes_none_more(spark):
    chain = [("a", f"c{i}", f"c{i - 1}") for i in range(1, 600)]
    hot = [("a", f"c{i}", "rate") for i in range(600)] + [("a", f"h{i}", "c599") for i in range(300)]
    side = [("a", f"c{i}", f"x{i}") for i in range(0, 600, 7)] + [("a", "x70", "y"), ("a", "y", "z")]
    edges = chain + hot + side
    assert got(spark, edges, max_rounds=16) == brute(edges)


def test_cycles_and_small_tables(spark):
    edges = [("a", "1", "2"), ("a", "2", "1"), ("a", "0", "1"), ("a", "1", "leaf"), ("a", "self", "self"), ("b", "1", "2"), ("b", "2", "3")]
    want = brute(edges)
    assert want["a", "0"] is None and want["a", "self"] is None and want["b", "1"] == 2
    assert got(spark, edges) == want
    assert got(spark, [("a", None, None)]) == {}


def test_small_circles_take_rounds_by_their_own_length(spark):
    """Circles of many lengths, with tails and nodes that refer to several of them, are all told in few rounds, whatever else there is."""
    edges = []
    for k in range(60):
        n = 1 + k % 13
        edges += [("a", f"c{k}-{i}", f"c{k}-{(i + 1) % n}") for i in range(n)] + [("a", f"t{k}-{i}", f"t{k}-{i + 1}") for i in range(5)] + [("a", f"t{k}-5", f"c{k}-0"), ("a", f"both{k}", f"t{k}-0"), ("a", f"both{k}", f"c{k}-0"), ("a", f"c{k}-0", "rate")]
    edges += [("b", str(i), str(j)) for i in range(4) for j in range(4) if i != j] + [("b", "5", "0"), ("b", "5", "6")]
    calls = []
    real = levels.written

    def counted(df):
        calls.append(1)
        return real(df)

    levels.written = counted
    try:
        assert got(spark, edges) == brute(edges)
        only = [e for e in edges if e[0] == "a"]
        calls.clear()
        assert got(spark, only) == brute(only)
        pairs = [("a", f"{i}{x}", f"{i}{y}") for i in range(500) for x, y in ("xy", "yx")]
        calls.clear()
        assert set(got(spark, pairs).values()) == {None}
        assert len(calls) < 20  # tables written: a round of a thousand edges' logarithm takes more
    finally:
        levels.written = real
