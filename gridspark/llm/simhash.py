"""SimHash near-dedup: fingerprints, links by pivot distance tables, connected components.

A fingerprint bit is 1 if it is set in over half of the XXH64 values (seed 42) of the document's word shingles. Two
fingerprints link if at most ``MAX_BITS`` bits differ; a component is what links join.

Links are searched among distinct fingerprints only, so copies cost nothing. The 64 bits are five blocks; if three
bits differ, at least two blocks are the same, so each fingerprint is dealt to ten buckets, one for each pair of
blocks, and no link is lost. Inside a bucket the pivot table decides: for each fingerprint the Hamming distances to
``PIVOTS`` reference fingerprints are computed once, and by the triangle inequality two fingerprints can only link if
no coordinate differs by more than MAX_BITS. Pairs are discarded by the largest coordinate difference, and only what
survives is verified by the differing bits themselves.

A bucket of more than ``BUCKET_ROWS`` fingerprints (a very large family of near copies) is not paired up: each member
marks the points of the Hamming ball of radius two around it (within the blocks that are not the bucket's). Two
fingerprints link if and only if a point lies within one bit of the one and two bits of the other, so every point
joins its near members and its far ones to one of the near ones. That is exact, and linear in the bucket's rows.

Components come from repeated minimum exchange over the links with pointer jumping, each round written to the shared
folder.

``drop_near_copies`` is the stage of the corpus pipeline and has a rule of its own: texts whose sets of five-word
shingles have a Jaccard similarity of 0.8 or more. The method is the same with wider fingerprints: ``NEAR_BITS`` bits of
the set's shingle hashes differ in 15 % of the bits at that similarity, and two of them link if no more differ than that
and ``DEVIATIONS`` standard deviations. Blocks of bits are no buckets for such a radius, so bands of MinHash values are.
First each text meets a pivot, the most central text of its buckets (the one whose buckets hold the most texts). Only
buckets that are then still more than one component are searched in full, inside tasks and in cells of bounded size: a
pair is looked at in the first bucket that it shares, discarded by the table of distances to ``PIVOTS`` reference
fingerprints, then by the differing bits. What fingerprints link is verified by the shingles themselves. Its rows are documents by doc_id and text: rows without a doc_id have nothing to do with one
another, and of equal rows one stays.

Defined results: a null or empty text has fingerprint zero and links like any other; rows with the same doc_id have one
row each and their texts are linked through that id; rows without a doc_id are documents of their own, linked by their
fingerprints only, and a component without any doc_id has the component_id null; other columns are ignored, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import add_columns, written
from gridspark.llm.decontaminate import MULTIPLIER, shingle_hashes, shingles_of, word_hashes

SHINGLE, SEED, MAX_BITS, PIVOTS, BUCKET_ROWS = 3, 42, 3, 32, 256
LAST_ID = 2**63 - 1
#: (first bit, number of bits) of each block.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PAIRS = tuple(combinations(range(len(BLOCKS)), 2))
BIT_TABLE = np.array([[b >> k & 1 for k in range(8)] for b in range(256)], np.int64)
#: Reference fingerprints: hashes of the first numbers.
REFERENCES = np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(PIVOTS)], np.uint64)

#: The near-copy stage: words in a shingle, least Jaccard similarity, bands and least hash values in a band. A pair at
#: the least similarity shares no band in one of 13,000 cases (1 - 0.8**5)**24, a pair of 0.85 in 7 of 10 million.
NEAR_SHINGLE, NEAR_LEAST, BANDS, BAND_ROWS = 5, 0.8, 24, 5
#: Bits of a fingerprint, the share of them that differs at the least similarity and what small sets add to it (over their
#: size), standard deviations beyond it at which a pair still links (a similar pair is lost in one of thirty thousand cases
#: at most), and rows of a bucket that are compared in one cell.
NEAR_BITS, NEAR_SHARE, SMALL_SHARE, DEVIATIONS, CELL_ROWS = 1024, float(np.arccos(2 * NEAR_LEAST / (1 + NEAR_LEAST)) / np.pi), 0.15, 4.0, 4096
NEAR_SEEDS = np.array([xxhash.xxh64_intdigest(f"bits {i}".encode(), SEED) | 1 for i in range(NEAR_BITS // 64)], np.uint64)
NEAR_REFERENCES = np.array([[xxhash.xxh64_intdigest(f"{i} {k}".encode(), SEED) for k in range(NEAR_BITS // 64)] for i in range(PIVOTS)], np.uint64)
FACTORS = np.array([xxhash.xxh64_intdigest(f"band {i}".encode(), SEED) | 1 for i in range(BANDS * BAND_ROWS)], np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)])) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    values = np.array([digest(s, SEED) for s in shingles], "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(values[:, k], minlength=256) @ BIT_TABLE for k in range(8)])
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(values)).tolist())


def fingerprints(docs: DataFrame, carry: list[str], width: int = SHINGLE) -> DataFrame:
    """docs' `carry` columns and fp, the fingerprint's bits as a signed long."""

    def compute(columns: dict[str, list]) -> dict[str, list]:
        return {"fp": [f - (f >> 63 << 64) for f in (fingerprint(t, width) for t in columns["text"])]}

    return add_columns(docs, carry, "fp long", compute, ["text"])


def bucket_keys(fps: np.ndarray) -> np.ndarray:
    """One row per fingerprint, one column per pair of blocks: the bits of both, under the pair's number."""
    part = [(fps >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in BLOCKS]
    return np.stack([(np.uint64(k) << np.uint64(32)) | (part[i] << np.uint64(13)) | part[j] for k, (i, j) in enumerate(PAIRS)], 1)


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, node = batch.column("fp").to_numpy(zero_copy_only=False), batch.column("node").to_numpy(zero_copy_only=False)
        keys = bucket_keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_pydict({"key": keys.ravel().astype(np.int64), "fp": np.repeat(fp, len(PAIRS)), "node": np.repeat(node, len(PAIRS))})


def pivot_pairs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of linked fingerprints among rows sorted by key. Rows at the same distance in the order are
    compared all at once, from neighbours on, until no bucket is as long."""
    table = np.bitwise_count(fp[:, None] ^ REFERENCES).astype(np.int8)
    left, right = [], []
    at = np.arange(len(key))
    for gap in range(1, len(key)):
        at = at[at + gap < len(key)]
        at = at[key[at] == key[at + gap]]
        if not len(at):
            break
        i = at
        for c in range(0, PIVOTS, 8):  # a few coordinates at a time: most pairs fall at the first
            i = i[np.abs(table[i, c : c + 8] - table[i + gap, c : c + 8]).max(1) <= MAX_BITS] if len(i) else i
        i = i[np.bitwise_count(fp[i] ^ fp[i + gap]) <= MAX_BITS]
        left.append(i)
        right.append(i + gap)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among sorted (key, fp, node) rows; the last bucket of a batch waits for the next one."""
    held: tuple[np.ndarray, ...] | None = None

    def links(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        key, fp, node = rows
        i, j = pivot_pairs(key, fp.view(np.uint64))
        return pa.RecordBatch.from_pydict({"a": node[i], "b": node[j]})

    for batch in batches:
        rows = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "node"))
        if held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held, rows))
        if not len(rows[0]):
            continue
        last = np.searchsorted(rows[0], rows[0][-1])
        held = tuple(x[last:] for x in rows)
        yield links(tuple(x[:last] for x in rows))
    if held is not None and len(held[0]):
        yield links(held)


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, point, near, node): the points within two bits of each fingerprint, outside the blocks of its bucket."""
    masks = []
    for i, j in PAIRS:
        free = [1 << (at + b) for k, (at, n) in enumerate(BLOCKS) if k not in (i, j) for b in range(n)]
        one = np.array([0, *free], np.uint64)
        masks.append((np.concatenate([one, np.array([x | y for x, y in combinations(free, 2)], np.uint64)]), len(one)))
    for batch in batches:
        key, fp, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "node"))
        for k, f, n in zip(key.tolist(), fp.view(np.uint64), node.tolist()):
            mask, near = masks[k >> 32]
            yield pa.RecordBatch.from_pydict({"key": np.full(len(mask), k, np.int64), "point": (mask ^ f).view(np.int64), "near": np.arange(len(mask)) < near, "node": np.full(len(mask), n, np.int64)})


def links(nodes: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b) node pairs such that components of linked fingerprints are components of the pairs. nodes: (fp, node),
    each fingerprint once."""
    keyed = nodes.select("fp", "node").mapInArrow(_bucketed, "key long, fp long, node long")
    hot = written(keyed.groupBy("key").count().where(F.col("count") > bucket_rows).select("key"))
    if hot.isEmpty():
        return _cold(keyed)
    balls = keyed.join(hot, "key").mapInArrow(_balls, "key long, point long, near boolean, node long")
    points = balls.groupBy("key", "point").agg(F.min(F.when(F.col("near"), F.col("node"))).alias("a"), F.collect_set("node").alias("all")).where("a is not null and size(all) > 1")
    joined = points.select("a", F.explode("all").alias("b")).where("a <> b").distinct()
    return _cold(keyed.join(hot, "key", "left_anti")).unionByName(joined)


def _cold(keyed: DataFrame) -> DataFrame:
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_linked, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node that can be reached."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        nearest = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        closer = labels.join(nearest, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = written(closer.join(jump, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"), "was"))
        labels = step.select("node", "root")
        if step.where("root <> was").isEmpty():
            return labels


def simhash_components(docs: DataFrame, width: int = SHINGLE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document."""
    prints = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], width))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    # rows that share a doc_id but not the fingerprint are joined through the id
    same = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("high")).where("a <> high").select("doc_id", "a")
    ids = prints.join(same, "doc_id").select("a", F.col("fp").alias("b")).where("a <> b").distinct()
    roots = components(links(nodes.select("fp", F.col("fp").alias("node")), bucket_rows).unionByName(ids))
    rooted = written(nodes.join(roots, F.col("fp") == F.col("node")).select("fp", "low", "root"))
    named = written(rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id"))
    lone = nodes.join(named, "fp", "left_anti").select("fp", F.col("low").alias("component_id"))
    out = prints.join(written(named.unionByName(lone)), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The key of each band: a hash of its least hash values under BAND_ROWS multipliers."""
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for low in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[low : low + 2048, None] * FACTORS).min(0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ column) * MULTIPLIER
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, keys = [], []
        for text in batch.column("text").to_pylist():
            words = near_words(text)
            hashes = np.unique(shingle_hashes(words, word_hashes(words), NEAR_SHINGLE)) if words else np.empty(0, np.uint64)
            node.append(xxhash.xxh3_64_intdigest(hashes.tobytes()) - 2**63)
            keys.append(band_keys(hashes) if words else [])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "text_key", "node", "keys"])


def near_print(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of shingle hashes: NEAR_BITS bits in 64-bit words, each 1 if over half the hashes have it."""
    ones = np.zeros(NEAR_BITS, np.int64)
    for low in range(0, len(hashes), 1024):
        mixed = hashes[low : low + 1024, None] ^ NEAR_SEEDS
        for _ in range(2):
            mixed = (mixed ^ (mixed >> np.uint64(32))) * NEAR_SEEDS
        mixed ^= mixed >> np.uint64(32)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def near_radius(small: np.ndarray) -> np.ndarray:
    """The most bits in which fingerprints of sets differ that link; small: the smaller set's size."""
    share = NEAR_SHARE + SMALL_SHARE / small
    return NEAR_BITS * share + DEVIATIONS * np.sqrt(NEAR_BITS * share * (1 - share))


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """The distances of each fingerprint to the reference fingerprints."""
    return np.stack([np.bitwise_count(prints ^ r).sum(1, dtype=np.int16) for r in NEAR_REFERENCES], 1)


def linked_prints(prints: np.ndarray, table: np.ndarray, sizes: np.ndarray, i: int, rest: np.ndarray) -> np.ndarray:
    """Those of the rows `rest` whose fingerprints link to that of row i: by the triangle inequality over the pivot table,
    a few pivots at a time, then by the bits."""
    small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
    fits = small >= NEAR_LEAST * large - 1e-9  # sets of more unequal sizes can't be similar
    rest, radius = rest[fits], near_radius(small[fits])
    for c in range(0, PIVOTS, 8):
        if not len(rest):
            return rest
        near = np.abs(table[rest, c : c + 8] - table[i, c : c + 8]).max(1) <= radius
        rest, radius = rest[near], radius[near]
    return rest[np.bitwise_count(prints[rest] ^ prints[i]).sum(1, dtype=np.int64) <= radius]


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (a, b) that link by their fingerprints and whose texts have a Jaccard similarity of NEAR_LEAST or more, by the
    shingles themselves."""
    last, have = None, set()
    for batch in batches:
        pairs = []
        sig = {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1)[:, BANDS:] for c in ("sig_a", "sig_b")}
        sizes = np.array([batch.column(c).to_pylist() for c in ("n_a", "n_b")], np.int64).reshape(2, -1).min(0)
        links = np.bitwise_count(sig["sig_a"] ^ sig["sig_b"]).sum(1, dtype=np.int64) <= near_radius(sizes)
        for link, a, b, x, y in zip(links.tolist(), *[batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")]):
            if not link:
                continue
            if last != b:  # rows often share the pivot
                last, have = b, set(shingles_of(near_words(y), NEAR_SHINGLE))
            mine = set(shingles_of(near_words(x), NEAR_SHINGLE))
            both = len(mine & have)
            if both >= NEAR_LEAST * (len(mine) + len(have) - both) - 1e-9:
                pairs.append((a, b))
        a, b = zip(*pairs) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text, n, sig): sig is the keys of the bands, 8 bytes each, and the fingerprint."""
    for batch in batches:
        size, sig = [], []
        for text in batch.column("text").to_pylist():
            words = near_words(text)
            hashes = np.unique(shingle_hashes(words, word_hashes(words), NEAR_SHINGLE))
            size.append(len(hashes))
            sig.append(band_keys(hashes).tobytes() + near_print(hashes).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("text"), pa.array(size, pa.int32()), pa.array(sig, pa.binary())], names=["node", "text", "n", "sig"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose fingerprints link and that are in different components, among rows sorted by cell (key, i, j)."""
    held: list[tuple] = []

    def found(rows: list[tuple]) -> pa.RecordBatch:
        key, i, j, part, node, root, n, sig = zip(*rows)
        node, root, part, sizes = np.array(node), np.array(root), np.array(part), np.array(n, np.int64)
        raw = np.frombuffer(b"".join(sig), np.uint64).reshape(len(rows), -1)
        keys, prints = raw[:, :BANDS].view(np.int64), np.ascontiguousarray(raw[:, BANDS:])
        table = pivot_table(prints)
        band, left, right = int(np.flatnonzero(keys[0] == key[0])[0]), [], []
        for x in range(len(rows) - 1):
            rest = x + 1 + np.flatnonzero((root[x + 1 :] != root[x]) & ((part[x + 1 :] != part[x]) | (i[0] == j[0])))
            rest = linked_prints(prints, table, sizes, x, rest)
            if band:
                rest = rest[~(keys[rest, :band] == keys[x, :band]).any(1)]
            left.append(np.full(len(rest), node[x]))
            right.append(node[rest])
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("key", "i", "j", "part", "node", "root", "n", "sig")]):
            if held and held[-1][:3] != row[:3]:
                if len(held) > 1:
                    yield found(held)
                held = []
            held.append(row)
    if len(held) > 1:
        yield found(held)


def row_keys(docs: DataFrame) -> DataFrame:
    """docs with __row_id (the greatest long for none) and __row_text, a hash of the text. Equal rows have equal keys;
    differing texts are distinct documents, also under one doc_id or none."""
    return docs.withColumns({"__row_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "__row_text": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})


def pivot_pairs_of(members: DataFrame) -> DataFrame:
    """(a, b): each node with the pivot that it meets first, the most central node of all that share a bucket with it.
    members: (key, node), written."""
    sizes = written(members.groupBy("key").count())
    central = written(members.join(sizes, "key").groupBy("node").agg(F.sum("count").alias("weight")))
    rank = F.struct("weight", "node")
    pivots = written(members.join(central, "node").groupBy("key").agg(F.max(rank).alias("pivot")))
    met = members.join(pivots, "key").groupBy(F.col("node").alias("a")).agg(F.max("pivot").alias("pivot"))
    return met.select("a", F.col("pivot.node").alias("b")).where("a <> b")


def mixed_cells(members: DataFrame, roots: DataFrame, texts: DataFrame, cell_rows: int) -> DataFrame | None:
    """The rows of the buckets that hold more than one component, dealt to cells (key, i, j); None if no bucket does. A bucket
    of more than cell_rows rows is cut into parts, and each pair of parts is a cell, so that no task gets it whole."""
    labelled = written(members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("parts")).where("low <> high")
    rows = written(labelled.join(written(mixed.select("key", "parts")), "key"))
    if rows.isEmpty():
        return None
    part = rows.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    cells = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return cells.join(texts.select("node", "n", "sig"), "node").select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "root", "n", "sig")


def near_components(keyed: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, text_key, root) of each row of row_keys(): rows of one root are joined by chains of similar texts. Equal
    shingle sets are one node."""
    rows = keyed.select(F.col("__row_id").alias("id"), F.col("__row_text").alias("text_key"), "text")
    prints = written(rows.mapInArrow(_sketched, "id long, text_key long, node long, keys array<long>"))
    dealt = prints.select("node", F.explode("keys").alias("key"))
    shared = written(dealt.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key"))
    if shared.isEmpty():
        return prints.select("id", "text_key", F.col("node").alias("root"))
    members = written(dealt.join(shared, "key").distinct())
    places = prints.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "text_key")).alias("at"))
    texts = rows.join(written(places.select("node", "at.id", "at.text_key")), ["id", "text_key"]).select("node", "text").dropDuplicates(["node"])
    texts = written(texts.mapInArrow(_signed, "node long, text string, n int, sig binary"))

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = texts.toDF("a", "text_a", "n_a", "sig_a"), texts.toDF("b", "text_b", "n_b", "sig_b")
        return written(pairs.join(left, "a").join(right, "b").mapInArrow(_similar, "a long, b long"))

    roots = components(verified(written(pivot_pairs_of(members))))
    done = prints.join(roots, "node", "left").select("id", "text_key", F.coalesce("root", "node").alias("root"))
    cells = mixed_cells(members, roots, texts, cell_rows)
    if cells is None:
        return done
    maybe = written(cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_searched, "a long, b long"))
    if maybe.isEmpty():
        return done
    # what was found later joins whole components: only these are merged, not their nodes once more
    later = verified(maybe)
    for end in ("a", "b"):
        later = later.join(roots.toDF(end, "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    merged = components(later).toDF("root", "least")
    return done.join(merged, "root", "left").select("id", "text_key", F.coalesce("least", "root").alias("root"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near copies, the one with the smallest doc_id. Columns are docs' own."""
    keyed = row_keys(docs)
    found = written(near_components(keyed))
    place = F.struct("id", "text_key")
    firsts = found.groupBy("root").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("root", "first")
    gone = written(found.join(written(firsts), "root").where(place != F.col("first")).select(F.col("id").alias("__row_id"), F.col("text_key").alias("__row_text")).distinct())
    keys = ["__row_id", "__row_text"]
    kept = keyed.join(gone, keys, "left_anti")  # a written table: the planner broadcasts it while it is small
    again = written(found.groupBy("id", "text_key").count().where("count > 1").select(F.col("id").alias("__row_id"), F.col("text_key").alias("__row_text")))
    if not again.isEmpty():  # equal rows: one stays
        kept = kept.join(again, keys, "left_anti").unionByName(kept.join(again, keys, "left_semi").dropDuplicates(keys))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
