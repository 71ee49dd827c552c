import hashlib
import math
from collections import Counter

import pytest

from gridspark.llm import mixing as m
from tests.llm.helpers import collect, docs, odd_rows


def brute_count(ident, rate, seed=42):
    pieces = max(1, math.ceil(rate / m.PIECE))
    total = 0
    for piece in range(1, pieces + 1):
        u = (int(hashlib.md5(f"{ident}|{seed}|{piece}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        term = cdf = math.exp(-rate / pieces)
        k = 0
        while cdf <= u and k < 200:
            k += 1
            term *= rate / pieces / k
            cdf += term
            total += 1
    return total


def test_counts_against_brute_force(spark):
    rows = [(i, f"text {i}") for i in range(900)]
    source = lambda k: None if k % 9 == 0 else "hot" if k % 3 else f"s{k % 5}"
    table = docs(spark, rows, source)
    sources = Counter(source(k) for k in range(900))
    weights = {s: math.sqrt(n) for s, n in sources.items()}
    rates = {s: weights[s] / sum(weights.values()) * 900 / sources[s] for s in sources}
    got = collect(m.mix(table, m.source_rates(table)))
    assert Counter(r["doc_id"] for r in got) == Counter({i: n for i, _ in rows if (n := brute_count(i, rates[source(i)]))})
    assert [r["mix_key"] for r in got] == sorted(r["mix_key"] for r in got)
    assert {(r["doc_id"], r["copy_no"]) for r in got} == {(i, c) for i, n in Counter(r["doc_id"] for r in got).items() for c in range(1, n + 1)}
    joined = collect(m.mix(table, m.source_rates(table), broadcast_sources=2))
    assert Counter(map(str, joined)) == Counter(map(str, got))


def test_weights_and_large_rates(spark):
    rows = [(i, "x") for i in range(400)]
    table = docs(spark, rows, lambda k: "rare" if k < 4 else "common" if k % 2 else "unwanted")
    got = collect(m.mix(table, m.source_rates(table, weights={"rare": 0.5, "common": 0.5, "unwanted": 0, "absent": 3.0}, size=2.0)))
    count = Counter(r["source"] for r in got)
    rate = 800 * (0.5 / 1.0) / 4
    assert count["rare"] == sum(brute_count(i, rate) for i in range(4)) and rate > m.PIECE
    assert abs(count["common"] - 400) < 80 and "unwanted" not in count


def test_poisson_cdf(spark):
    (row,) = spark.range(1).select(m.poisson_cdf(m.F.lit(3.5)).alias("c")).collect()
    assert row.c[:6] == pytest.approx([sum(math.exp(-3.5) * 3.5**j / math.factorial(j) for j in range(k + 1)) for k in range(6)])


def test_odd_rows(spark):
    table = docs(spark, odd_rows(), lambda k: None)
    got = collect(m.mix(table, m.source_rates(table, size=5.0)))
    each = Counter((r["doc_id"], r["text"]) for r in got)
    assert each[(4, odd_rows()[5][1])] == 2 * brute_count(4, 5.0)
    empty = table.where("false")
    assert m.mix(empty, m.source_rates(empty)).count() == 0
