"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items and documents are sets of five-word shingles of their words (letters, digits and marks between white space and
ASCII punctuation, in lower case). A document leaks an item if it holds at least ``THRESHOLD`` of the item's shingles.

An ordinary MinHash of a long document says nothing about a short item inside it. Therefore items are partitioned by
size, and every partition has a bottom-k MinHash sketch whose length suits its size: of n shingles, those k with the
smallest hash values, k = n - ceil(THRESHOLD * n) + 1. A document that lacks all k of them lacks too many to reach
the threshold, so looking up a document's shingle hashes in the sketches loses no pair. The lookup runs over whole
documents, a filter of hash prefixes first, with vectorised hashes; what it finds is verified with the shingles
themselves, not their hashes.

Items are a stated query set: they are sent to the tasks in blocks of at most ``BLOCK_SHINGLES`` shingles, each block
one pass over the documents, so that a benchmark of any size never has to fit at once.

Defined results: an item or document without words has no shingles and never matches; one with fewer than five words
is a single shingle, the whole sequence; null texts are empty; rows of the benchmark with the same item_id and text
give one match, with differing texts each counts on its own and the best is given; rows with a null id match like any
others; repeated documents match alike; other columns are ignored, whatever their names; without documents or items
there is no match.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import written

SHINGLE, THRESHOLD, BLOCK_SHINGLES, FILTER_BITS = 5, 0.8, 2_000_000, 20
#: ASCII punctuation counts as white space.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TO_SPACE = bytes.maketrans(PUNCTUATION.encode(), b" " * len(PUNCTUATION))
MATCHES = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(TO_SPACE).split()


def shingles_of(words: list[bytes], width: int = SHINGLE) -> list[bytes]:
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(width)])))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """A hash of each shingle from its words' hashes; a sequence below the width is one shingle."""
    n, span = (len(words) - width + 1, width) if len(words) >= width else (1, len(words))
    key = np.zeros(n, np.uint64)
    for j in range(span):
        key = (key ^ hashes[j : j + n]) * MULTIPLIER
        key ^= key >> np.uint64(29)
    return key * MULTIPLIER


class Sketches:
    """The sketches of a block of items and the items' shingles for the verification."""

    def __init__(self, items: list[tuple[int | None, str]], threshold: float, width: int) -> None:
        self.threshold, self.width = threshold, width
        self.items: list[tuple[int | None, frozenset[bytes]]] = []
        pairs: dict[int, list[int]] = {}
        by_size: dict[int, list[int]] = {}
        for item_id, text in items:
            words = words_of(text)
            shingles = frozenset(shingles_of(words, width))
            if shingles:
                by_size.setdefault(len(shingles), []).append(len(self.items))
                self.items.append((item_id, shingles))
        for size, members in by_size.items():
            k = size - math.ceil(threshold * size - 1e-9) + 1
            for i in members:
                hashes = sorted(int(shingle_hashes(w := s.split(b" "), word_hashes(w), width)[0]) for s in self.items[i][1])
                for h in hashes[:k]:
                    pairs.setdefault(h, []).append(i)
        self.keys = np.array(sorted(pairs), np.uint64)
        self.owners = [pairs[int(h)] for h in self.keys]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, words: list[bytes], hashes: np.ndarray) -> set[int]:
        if not words or not len(self.keys):
            return set()
        key = shingle_hashes(words, hashes, self.width)
        key = key[self.filter[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]]
        if not len(key):
            return set()
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return set(chain.from_iterable(self.owners[i] for i in np.unique(at[self.keys[at] == key]).tolist()))

    def matches(self, words: list[bytes], hashes: np.ndarray) -> Iterator[tuple[int | None, int, int]]:
        """(item_id, shared, size) of each item that the document contains."""
        found = self.candidates(words, hashes)
        if not found:
            return
        have = set(shingles_of(words, self.width))
        for i in sorted(found):
            item_id, shingles = self.items[i]
            shared = len(shingles & have)
            if shared >= self.threshold * len(shingles) - 1e-9:
                yield item_id, shared, len(shingles)


#: The sketches of the block that this worker has searched last.
_SKETCHED: dict[str, Sketches] = {}


def sketched(name: str, make: Callable[[], Sketches]) -> Sketches:
    """What `make` gives, made once in each worker and not for each task."""
    if name not in _SKETCHED:
        _SKETCHED.clear()
        _SKETCHED[name] = make()
    return _SKETCHED[name]


def item_blocks(benchmark: DataFrame, most: int = BLOCK_SHINGLES) -> Iterator[list[tuple[int | None, str]]]:
    """The items, block by block; only one block is on the driver at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    for row in rows.toLocalIterator():
        n = len(row.text) // 2 + 1  # no text has more words
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += n
    if block:
        yield block


def containment_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of each pair at or above the threshold."""
    spark, found = docs.sparkSession, None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    for block in item_blocks(benchmark, block_shingles):
        block.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            sketches = sketched(name, lambda: Sketches(shared.value, threshold, width))
            for batch in batches:
                out: list[tuple] = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    words = words_of(text)
                    out += [(doc_id, i, s, n, s / n) for i, s, n in sketches.matches(words, word_hashes(words))]
                columns = list(zip(*out)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "n_shared", "n_shingles", "containment"])

        part = texts.mapInArrow(search, MATCHES)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], MATCHES)
    best = F.max_by(F.struct("n_shared", "n_shingles"), F.struct("containment", "n_shared"))
    return (
        found.groupBy("doc_id", "item_id").agg(best.alias("best"), F.max("containment").alias("containment"))
        .select("doc_id", "item_id", "best.n_shared", "best.n_shingles", "containment")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item. What a row holds depends on its text alone, so a hash of the text
    finds it again: other rows with the same doc_id, or with none, stay."""
    keyed = docs.withColumn("__text_key", F.xxhash64("text"))
    gone = written(containment_matches(keyed.select(F.col("__text_key").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__text_key")).distinct())
    kept = keyed.join(gone, "__text_key", "left_anti")  # a written table: the planner broadcasts it while it is small
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
with item as (
  select item_id, string_split_regex(trim(regexp_replace(lower(text), '[[:punct:]\x20\x09-\x0D]+', ' ', 'g')), ' +') as w from benchmark where text is not null
), doc as (
  select doc_id, string_split_regex(trim(regexp_replace(lower(text), '[[:punct:]\x20\x09-\x0D]+', ' ', 'g')), ' +') as w from documents where text is not null
), i as (
  select distinct item_id, unnest([array_to_string(w[j:j + 4], ' ') for j in range(1, greatest(len(w) - 3, 2))]) as s from item where w <> ['']
), d as (
  select distinct doc_id, unnest([array_to_string(w[j:j + 4], ' ') for j in range(1, greatest(len(w) - 3, 2))]) as s from doc where w <> ['']
), n as (
  select item_id, count(*) as n from i group by item_id
), m as (
  select doc_id, item_id, count(*) as n_shared from d join i using (s) group by doc_id, item_id
)
select doc_id, item_id, n_shared::bigint as n_shared, n::bigint as n_shingles, n_shared / n as containment
from m join n using (item_id) where n_shared >= 0.8 * n - 1e-9
"""
