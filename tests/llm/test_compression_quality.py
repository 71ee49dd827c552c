import math
import random
import zlib

import numpy as np
import pytest
import zstandard

from gridspark.llm import compression_quality as c
from tests.llm.helpers import collect, docs, odd_rows, prose


def test_held_out_accuracy_and_range(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 80)) for i in range(200)] + [(1000 + i, prose(rng, 60).upper().replace(" ", "!! ")) for i in range(200)]
    table = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows], "doc_id long, quality int")
    model = c.fit_size_model(table, labels)
    got = collect(c.with_fold(c.quality_scores(table, model, carry=["doc_id"])))
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["predicted"] == int(r["doc_id"] < 1000) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    odd = collect(c.quality_scores(docs(spark, odd_rows()), model))
    assert len(odd) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert c.fit_size_model(table, labels) == model


def test_held_out_labels_are_not_used(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 40)) for i in range(60)]
    table = docs(spark, rows)
    fold = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    a = [(i, i % 2) for i, _ in rows]
    b = [(i, 1 - y if fold(i) else y) for i, y in a]
    make = lambda x: c.fit_size_model(table, spark.createDataFrame(x, "doc_id long, quality int"))
    assert make(a) == make(b)


def test_without_labels(spark):
    table = docs(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r["score"], 9) for r in collect(c.quality_scores(table, c.fit_size_model(table, none)))} == {0.5}
    assert c.quality_scores(table.where("false"), c.fit_size_model(table, none)).count() == 0


def test_every_piece_counts():
    pair = c.compressors(c.dictionary(["good words here. " * 400]), c.dictionary(["BAD!! ### $$$ " * 400]))
    start = "good words here. " * 40
    assert c.difference(start, *pair) > c.difference(start + "BAD!! ### $$$ " * 400, *pair)
    assert c.difference("", *pair) == c.difference(None, *pair) == 0


def test_scores_are_what_the_model_says(spark):
    """Sizes by fresh compressors, one for each piece, and the curve by its formula."""
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice([5, 80, 400]))) for i in range(60)] + [(1000 + i, "!! ".join(prose(rng, 60).split())) for i in range(60)]
    table = docs(spark, rows)
    model = c.fit_size_model(table, spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows], "doc_id long, quality int"))
    got = {r["doc_id"]: r for r in collect(c.quality_scores(table, model, carry=["doc_id"]))}

    def size(raw, data):
        make = lambda: zstandard.ZstdCompressor(level=c.LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(make().compress(raw[i : i + c.PIECE])) for i in range(0, len(raw), c.PIECE))

    for i, text in rows[::7] + rows[60::9]:
        good, bad = size(text.encode(), model.good), size(text.encode(), model.bad)
        assert got[i]["size_difference"] == pytest.approx((bad - good) / (bad + good), abs=0.01)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-(model.slope * got[i]["size_difference"] + model.offset))))


def test_the_curve_is_the_most_likely_one():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.2, 500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(6 * x - 0.5)))).astype(float)
    weight = np.where(y > 0, 0.7, 1.3)
    scale = np.abs(x).max()

    def worth(slope, offset):
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        return (weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() - (1e-2 * (slope * scale) ** 2 + 1e-4 * offset**2) / 2

    slope, offset = c.logistic(x, y, weight)
    assert 4 < slope < 9
    assert all(worth(slope, offset) >= worth(slope + a, offset + b) for a, b in ((0.05, 0), (-0.05, 0), (0, 0.02), (0, -0.02), (0.05, 0.02)))
