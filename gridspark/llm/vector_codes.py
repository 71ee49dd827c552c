"""Vector code compression: product codes of integer vectors, with exact Exponion search of the nearest entry.

Each component becomes floor(256 * x), a vector is cut into `PARTS` equal consecutive parts, and each part is replaced by
the number of the nearest of at most `ENTRIES` codebook entries of its position. Codebooks begin as the parts of the
smallest vec_ids and are moved `ROUNDS` times to the floored means of their parts.

The search begins at a part's previous entry a, at the squared distance u. An entry j that is as near as that is, by the
triangle inequality, at most twice as far from a as the part is, so its squared distance from a is 4u at most: of a's
list of entries by distance only that beginning is scanned. All distances are exact integers; of equally near entries
the lower number wins, and the radius includes equals, so nothing but the order of work differs from a full scan.

Vectors are never shuffled: a round is one pass in which each task repeats the rounds before (that gives each part its
previous entry without a table of them) and sums its parts by entry; only these sums, 16 x 64 a task, are exchanged,
and only the codebooks (16 x 64 entries, by the parameters) reach the driver. Codes are written once, and the errors by
label are joined from a table that the planner broadcasts while it is small.

Defined results: rows whose vector is null, or holds a null, NaN or infinite component, are dropped, and so are vectors
that can't be cut like the others: of another length than the vector of the smallest vec_id, or of a length that isn't a
positive multiple of `PARTS`, or with a component of 10^24 or more. A null vec_id counts as the greatest; equal vec_ids
are ordered by their vectors; repeated rows are coded each; fewer than `ENTRIES` rows give as many entries; an empty table
gives an empty table; other columns are not read. An error that no long can hold is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components and distances below these are exact in 64 bits; beyond, Python's integers are used.
EXACT = 1 << 28
TOO_LARGE = 10.0**24
BATCH = 4096


# ------------------------------------------------------------------------------------------------ search


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite numbers, as int64, or as Python's integers where some are too large for exact squares."""
    scaled = np.asarray(vectors, dtype=np.float64) * SCALE  # a power of two: exact
    if not scaled.size or np.abs(scaled).max() < EXACT:
        return np.floor(scaled).astype(np.int64)
    flat = [Fraction(float(x)) for x in np.asarray(vectors, dtype=np.float64).ravel()]
    return np.array([(x * SCALE).__floor__() for x in flat], dtype=object).reshape(scaled.shape)


class Codebooks:
    """The entries of all part positions, (parts, entries, width), and of each entry the others by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.parts, self.count, self.width = entries.shape
        apart = self.between(entries[:, :, None, :], entries[:, None, :, :])
        number = np.broadcast_to(np.arange(self.count), apart.shape)
        if apart.dtype == object:
            order = np.array([[sorted(range(self.count), key=lambda j, row=row: (row[j], j)) for row in part] for part in apart]).reshape(apart.shape)
        else:
            order = np.lexsort((number, apart), axis=-1)
        self.order = order.reshape(-1, self.count)  # by part * count + entry
        self.apart = np.take_along_axis(apart, order, axis=-1).reshape(-1, self.count)
        self.flat = entries.reshape(-1, self.width)

    @staticmethod
    def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = a - b
        return (d * d).sum(axis=-1)

    def nearest(self, parts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, squared distances) of parts (rows, parts, width), searched from the entries `start` (rows, parts)."""
        offset = np.tile(np.arange(self.parts) * self.count, len(parts))
        x, first = parts.reshape(-1, self.width), start.reshape(-1) + offset
        u = self.between(x, self.flat[first])
        near = self.apart[first]
        reach = (near <= (4 * u)[:, None]).sum(axis=1)  # lists are sorted, so these are their beginnings
        by_reach = np.argsort(-reach, kind="stable")
        x, first, offset, u, reach = x[by_reach], first[by_reach], offset[by_reach], u[by_reach], reach[by_reach]
        best, found = first - offset, u.copy()
        for k in range(self.count):
            n = int(np.searchsorted(-reach, -k, side="left"))  # the rows whose lists are longer than k
            if not n:
                break
            entry = self.order[first[:n], k]
            d = self.between(x[:n], self.flat[entry + offset[:n]])
            closer = (d < found[:n]) | (d == found[:n]) & (entry < best[:n])
            best[:n] = np.where(closer, entry, best[:n])
            found[:n] = np.where(closer, d, found[:n])
        back = np.empty_like(by_reach)
        back[by_reach] = np.arange(len(by_reach))
        return best[back].reshape(start.shape), found[back].reshape(start.shape)


def assigned(parts: np.ndarray, books: list[Codebooks]) -> tuple[np.ndarray, np.ndarray]:
    """The entries and distances in the last of the codebooks, searched round by round from the entry of the one before."""
    entry = np.zeros(parts.shape[:2], dtype=np.int64)
    for book in books:
        entry, error = book.nearest(parts, entry)
    return entry, error


def cut(column: pa.Array, parts: int) -> np.ndarray:
    """An Arrow column of lists of equal length as (rows, parts, width) integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return integers(flat.reshape(len(column), -1)).reshape(len(column), parts, -1)


# ------------------------------------------------------------------------------------------------ rounds


def usable(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, list[list[float]], int]:
    """(the kept rows with vec_id, vec, label; the vectors of the smallest vec_ids; their length)."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    sound = rows.where(f"vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) * {SCALE} < {TOO_LARGE})")
    smallest = lambda df, n: [r.vec for r in df.orderBy(F.asc_nulls_last("vec_id"), "vec").limit(n).select("vec").collect()]
    first = smallest(sound, 1)
    size = len(first[0]) if first else 0
    kept = sound.where(F.size("vec") == size) if size and size % parts == 0 else sound.where("false")
    return kept, smallest(kept, ENTRIES), size


def part_sums(kept: DataFrame, books: list[Codebooks]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(count, sums) by part position and entry. Tasks send sums of their parts; as decimals no sum is too large."""
    parts, count, width = books[-1].entries.shape
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * count, dtype=np.int64), np.zeros((parts * count, width), dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                x = cut(batch.column(0)[at : at + BATCH], parts)
                entry = assigned(x, books)[0] + np.arange(parts) * count
                own = np.zeros((parts * count, width), dtype=x.dtype)
                np.add.at(own, entry.reshape(-1), x.reshape(-1, width))
                n += np.bincount(entry.reshape(-1), minlength=parts * count)
                sums += own.astype(object)
        rows = [{"part": int(i // count), "entry": int(i % count), "n": int(n[i]), "sums": [Decimal(int(s)) for s in sums[i]]} for i in np.flatnonzero(n)]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    each = kept.select("vec").mapInArrow(run, "part int, entry int, n long, sums array<decimal(38,0)>")
    total = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)])
    return {(r.part, r.entry): (r.n, [int(r[f"s{k}"]) for k in range(width)]) for r in total.collect()}


def fit_codebooks(kept: DataFrame, smallest: list[list[float]], parts: int = PARTS, rounds: int = ROUNDS) -> list[Codebooks]:
    """The codebooks before the first and after each round."""
    first = integers(np.array(smallest)).reshape(len(smallest), parts, -1).transpose(1, 0, 2)
    books = [Codebooks(np.ascontiguousarray(first))]
    for _ in range(rounds):
        entries = books[-1].entries.astype(object)
        for (part, entry), (n, sums) in part_sums(kept, books).items():
            entries[part, entry] = [s // n for s in sums]  # rounds down
        small = max((abs(int(x)) for x in entries.ravel()), default=0) < EXACT
        books.append(Codebooks(entries.astype(np.int64) if small else entries))
    return books


def codebooks_digest(book: Codebooks) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in book.entries.ravel()).encode()).hexdigest()


def with_codes(kept: DataFrame, books: list[Codebooks]) -> DataFrame:
    """(vec_id, label, code, error) of each kept row."""
    parts = books[-1].parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                piece = batch.slice(at, BATCH)
                entry, error = assigned(cut(piece.column(1), parts), books)
                total = [int(e) for e in error.sum(axis=1)]
                codes = [bytes(row).hex() for row in entry.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(codes), pa.array([e if e < 1 << 63 else None for e in total], pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = dict(kept.dtypes)
    return kept.select("vec_id", "vec", "label").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decoded(codes: DataFrame, book: Codebooks, scale: int = SCALE) -> DataFrame:
    """codes with `vec`: the vector that a code stands for."""
    table = [[[float(x) / scale for x in e] for e in part] for part in book.entries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = [[x for p, e in enumerate(bytes.fromhex(c)) for x in table[p][e]] for c in batch.column(batch.schema.get_field_index("code")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vecs, pa.list_(pa.float64()))], names=[*batch.schema.names, "vec"])

    return codes.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema if f.name != "vec") + ", vec array<double>")


def code_report(vectors: DataFrame, parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept row of (vec_id, embedding, label)."""
    kept, smallest, _ = usable(vectors, parts)
    shape = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if not smallest:
        return vectors.sparkSession.createDataFrame([], shape)
    books = fit_codebooks(kept, smallest, parts, rounds)
    codes = written(with_codes(kept, books))
    by_label = written(codes.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.bool_or(F.col("error").isNull()).alias("lost")))
    sums = by_label.select(F.col("label").alias("of"), F.when(~F.col("lost"), F.col("label_error")).alias("label_error"))
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books[-1])).alias("codebooks_sha256"))


def _oracle() -> str:
    """Every part against all entries, round by round."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"a{r} as (select v.rn, v.part, arg_min(b.entry, (d, b.entry)) as entry, min(d) as d from v join b{r} b on v.part = b.part, "
            f"lateral (select list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))::bigint as d) group by v.rn, v.part)"
        )
        if r < ROUNDS:
            steps.append(f"s{r} as (select part, entry, pos, floor(sum(c) / count(*))::bigint as c from (select a.part, a.entry, unnest(range(1, len(v.x) + 1)) as pos, unnest(v.x) as c from a{r} a join v using (rn, part)) group by all)")
            steps.append(f"m{r} as (select part, entry, list(c order by pos) as x from s{r} group by all)")
            steps.append(f"b{r + 1} as (select b.part, b.entry, coalesce(m.x, b.x) as x from b{r} b left join m{r} m using (part, entry))")
    return f"""
with k as (
  select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as q, row_number() over (order by vec_id nulls last, embedding) as rn from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), v as (
  select rn, p as part, list_slice(q, (p * (len(q) // {PARTS}) + 1)::bigint, ((p + 1) * (len(q) // {PARTS}))::bigint) as x from k, range({PARTS}) t(p)
), b0 as (
  select part, rn - 1 as entry, x from v where rn <= {ENTRIES}
), {", ".join(steps)}, c as (
  select rn, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a{ROUNDS} group by rn
), h as (
  select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from b{ROUNDS}
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from k join c using (rn), h
"""


ORACLE = _oracle()
