"""Quality classifier by compression: zstandard dictionaries from good and from bad text.

A text is compressed twice, once with a dictionary built from good labelled text and once with one from bad. The
normalised difference of the sizes, (bad - good) / (bad + good), says which it resembles; a logistic curve fitted on
labelled text that no dictionary has seen turns it into a calibrated score. Long texts are compressed in pieces of
``PIECE`` bytes, all of them, as a dictionary only helps at a frame's start.

The dictionaries and the curve are fitted on a bounded sample (``FIT_DOCS`` labelled documents of each class, by a
hash of doc_id, outside the fold where crc32(doc_id) mod 4 is 2, of each at most ``FIT_CHARS`` code points, spread over
a longer one); every document is scored, and by its whole text.

Defined results: a null or empty text has difference 0 and the curve's score for it; repeated rows score alike; a
null doc_id is held in (its remainder is unknown); without labels of both classes every score is the share of good
labels, 0.5 without any; an empty table gives an empty table; carried columns named as the new ones are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import add_columns
from gridspark.llm.quality_rules import FIT_CHARS, in_fold, labelled_sample

FIT_DOCS, PIECE, DICTIONARY, LEVEL, KEEP_AT = 1500, 512, 112_640, 3, 0.7


@dataclass(frozen=True)
class SizeModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def pieces(raw: bytes, size: int = PIECE) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, len(raw), size)]


@lru_cache(4)
def compressors(good: bytes, bad: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    out = []
    for data in (good, bad):
        dictionary = zstandard.ZstdCompressionDict(data)
        dictionary.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=dictionary, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out[0], out[1]


def difference(text: str | None, by_good: zstandard.ZstdCompressor, by_bad: zstandard.ZstdCompressor) -> float:
    parts = pieces((text or "").encode("utf-8", "surrogatepass"))
    if not parts:
        return 0.0
    good, bad = (sum(len(c.compress(p)) for p in parts) for c in (by_good, by_bad))
    return (bad - good) / (bad + good)


def dictionary(texts: list[str]) -> bytes:
    samples = [p for t in texts for p in pieces(t.encode("utf-8", "surrogatepass")) if p]
    room = max(1024, min(DICTIONARY, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(room, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the text itself serves
        return b"".join(samples)[-room:] or b" "


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the most likely logistic curve, by Newton steps; a weak prior keeps separable data finite."""
    scale = float(np.abs(x).max()) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    theta, ridge = np.zeros(2), np.diag([1e-2, 1e-4])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        theta = theta + np.clip(np.linalg.solve(hessian, z.T @ (weight * (y - p)) - ridge @ theta), -5, 5)
    return round(float(theta[0] / scale), 9), round(float(theta[1]), 9)


def fit_size_model(docs: DataFrame, labels: DataFrame, per_class: int = FIT_DOCS) -> SizeModel:
    rows = labelled_sample(docs, labels, per_class, most_chars=FIT_CHARS)
    good, bad = ([t for y, t in rows if y == c] for c in (1, 0))
    if not good or not bad:
        share = len(good) / len(rows) if rows else 0.5
        share = min(max(share, 0.01), 0.99)
        return SizeModel(b"", b"", 0.0, math.log(share / (1 - share)))
    # one in three is left for the curve
    seen, kept = lambda x: [t for i, t in enumerate(x) if i % 3 or len(x) < 6], lambda x: x[::3]
    model = SizeModel(dictionary(seen(good)), dictionary(seen(bad)), 1.0, 0.0)
    pair = compressors(model.good, model.bad)
    x = np.array([difference(t, *pair) for t in [*kept(good), *kept(bad)]])
    y = np.array([1.0] * len(kept(good)) + [0.0] * len(kept(bad)))
    # the sample holds as many of each class; the curve is to hold for the classes as frequent as they are
    counts = {r.y: r["count"] for r in in_fold(labels, "quality").groupBy("y").count().collect()}
    weight = np.where(y > 0, counts[1] / y.sum(), counts[0] / (1 - y).sum()) * len(y) / (counts[0] + counts[1])
    return SizeModel(model.good, model.bad, *logistic(x, y, weight))


def quality_scores(docs: DataFrame, model: SizeModel, carry: list[str] | None = None, keep_at: float = KEEP_AT) -> DataFrame:
    """docs' `carry` columns (default: all but the text) with size_difference, score and predicted."""

    def compute(columns: dict[str, list]) -> dict[str, list]:
        if not model.good:
            gaps = [0.0] * len(columns["text"])
        else:
            pair = compressors(model.good, model.bad)
            gaps = [difference(t, *pair) for t in columns["text"]]
        scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * g + model.offset)))) for g in gaps]
        return {"size_difference": gaps, "score": scores, "predicted": [int(s >= keep_at) for s in scores]}

    return add_columns(docs, [c for c in docs.columns if c != "text"] if carry is None else carry, "size_difference double, score double, predicted int", compute, ["text"])


def with_fold(df: DataFrame) -> DataFrame:
    return df.withColumn("held_out", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False)))
