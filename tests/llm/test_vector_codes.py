import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from gridspark.llm import vector_codes as v

TABLE = "vec_id long, embedding array<float>, label int, vec string, code string, error int, part int, entry int, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "v", "c", 1, 2, 3, 4) for r in rows], TABLE).repartition(3)


def brute(rows, size=None):
    """The same by full scans with Python's integers."""
    sound = [(i, [float(np.float32(x)) for x in e], k) for i, e, k in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not sound:
        return []
    size = len(sound[0][1])
    kept = [(i, [(Fraction(x) * 256).__floor__() for x in e], k) for i, e, k in sound if len(e) == size]
    w = size // 16
    parts = [[q[p * w : (p + 1) * w] for p in range(16)] for _, q, _ in kept]
    books = [[parts[r][p] for r in range(min(64, len(kept)))] for p in range(16)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))
    for _ in range(2):
        found = [[near(p, x)[1] for p, x in enumerate(row)] for row in parts]
        for p in range(16):
            for j in range(len(books[p])):
                own = [row[p] for row, f in zip(parts, found) if f[p] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    last = [[near(p, x) for p, x in enumerate(row)] for row in parts]
    errors = [sum(d for d, _ in row) for row in last]
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    labels = {}
    for (_, _, k), e in zip(kept, errors):
        labels[k] = labels.get(k, 0) + e
    return sorted(str((i, "".join(f"{j:02x}" for _, j in row), e, labels[k], digest)) for (i, _, k), row, e in zip(kept, last, errors))


def rows(n=150, width=32, seed=1, spread=1.0):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, spread) for _ in range(width)] for _ in range(7)]
    out = [(i * 3 - 40, [c + rng.gauss(0, 0.1) for c in centre[i % 7]], rng.choice([0, 0, 0, 1, 2, None])) for i in range(n)]
    same = out[5][1]
    odd = [(None, same, 1), (None, centre[0], None), (7, same, 0), (7, same, 0), (7, centre[1], 0), (8, None, 1), (9, [*same[:-1], None], 1), (10, [*same[:-1], float("nan")], 1), (11, [*same[:-1], float("-inf")], 1), (12, [], 1), (13, same[:16], 1)]
    return out + odd


def got(df):
    return sorted(str(tuple(r)) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


@pytest.mark.parametrize("data", [rows(), rows(40, 16, 2), rows(90, 48, 3, 0.01)])
def test_against_full_scans(spark, data):
    assert got(v.code_report(table(spark, data))) == brute(data)


def test_ties_and_grids(spark):
    rng = random.Random(4)
    data = [(i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(32)], i % 2) for i in range(120)]  # many equal distances and entries
    assert got(v.code_report(table(spark, data))) == brute(data)


def test_huge_components(spark):
    data = rows(70, 16, 5) + [(1000 + i, [1e9 * i + 0.5] * 16, 1) for i in range(5)]
    want, found = brute(data), got(v.code_report(table(spark, data)))
    assert len(want) == len(found)
    small = lambda rows: sorted(r.split(",")[1] for r in rows)
    assert small(want) == small(found)
    assert got(v.code_report(table(spark, rows(10, 16) + [(1, [3e38] * 16, 1)]))) == brute(rows(10, 16))


def test_few_rows_none_and_other_lengths(spark):
    one = [(5, [0.25] * 16, None)]
    assert got(v.code_report(table(spark, one))) == brute(one)
    assert v.code_report(table(spark, one).where("false")).collect() == []
    assert v.code_report(table(spark, [(1, [1.0] * 17, 0)])).collect() == []
    assert v.code_report(table(spark, [(1, [], 0)])).collect() == []


def test_radius_saves_work_and_codes_decode(spark):
    rng = np.random.default_rng(1)
    x = v.integers(rng.normal(0, 1, (2000, 64))).reshape(2000, 16, 4)
    book = v.Codebooks(np.ascontiguousarray(x[:64].transpose(1, 0, 2)))
    full, d = book.nearest(x, np.zeros((2000, 16), dtype=np.int64))
    again, d2 = book.nearest(x, full)  # from the right entry
    assert (full == again).all() and (d == d2).all()
    near = book.apart[(full + np.arange(16) * 64).reshape(-1)]
    assert (near <= 4 * d.reshape(-1)[:, None]).sum(axis=1).mean() < 32
    assert (v.integers(np.array([[-0.001, 0.001, -1.0, 0.999]])) == [[-1, 0, -256, 255]]).all()
    kept, smallest, size = v.usable(table(spark, rows(30, 16)))
    books = v.fit_codebooks(kept, smallest)
    vecs = {r.vec_id: r.vec for r in v.decoded(v.with_codes(kept, books), books[-1]).collect()}
    assert size == 16 and all(len(x) == 16 for x in vecs.values())
    close = [sum((a - b) ** 2 for a, b in zip(vecs[i], e)) for i, e, _ in rows(30, 16)[:30]]
    assert sum(close) / 30 < 0.1
