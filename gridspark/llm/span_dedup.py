"""Substring dedup: sliding sentence spans that occur elsewhere before are removed.

A text is cut into sentences: after closing punctuation followed by white space, at line ends, and inside sentences
of over ``LONG`` words after words whose hash is the least among their neighbours (and in runs of one word), so that
equal passages are cut alike wherever they stand, and into parts of much the same size. From every sentence on a span
is taken: at least ``MIN_SENTENCES`` sentences and at least ``MIN_WORDS`` words. All spans are hashed (words in lower
case A-Z, one blank between them) to 96 bits and joined globally. A span's first occurrence, by doc_id and position,
stays; the sentences covered by any other occurrence are removed, with the white space that follows them.

Only hashes take part in the join. The repeated hashes come from an aggregation that combines before the exchange and
are written to the shared folder; the join with all spans can then be split by the planner where one span is held by
very many documents.

Defined results: null and empty texts have no sentences; a null doc_id counts as the greatest; rows with the same
or no doc_id and differing texts are distinct documents, in the order of a hash of the text; equal rows are one
document, and equal positions of it are both first; an empty table gives an empty table; columns of the input named
first_doc_ids, n_sentences or n_removed are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import add_columns, written

#: Words of a sentence that isn't cut further; words on either side among which a cut has the least hash, so that 2 * NEAR + 1
#: words are between cuts on average; words between cuts of a run of one word.
MIN_SENTENCES, MIN_WORDS, LONG, NEAR, RUN, LAST_ID = 2, 24, 10, 4, 8, 2**63 - 1
#: Words whose hashes a worker remembers, and what stands for a sentence's edge: less than any hash, so that no part is cut
#: off with fewer than NEAR words.
KEPT_HASHES, EDGE = 100_000, -1
#: What ends a sentence, with the white space after it. Runs are only looked at from their start and never given back, so
#: that long runs of marks or blanks cost no more than any other text.
END = re.compile(
    r"[.!?。！？ \t-\r](?:(?<=[.!?])(?<![.!?][.!?])[.!?]*+[\"')\]]*+[ \t-\r]++|(?<=[。！？])[。！？]*+[ \t-\r]*+"
    r"|(?<![ \t-\r][ \t-\r])(?:(?<=\n)|(?<=[ \t\x0b-\r])[ \t\x0b-\r]*+\n)[ \t-\r]*+)"
)
WORD = re.compile(r"[^ \t-\r]+[ \t-\r]*")


def sentences(text: str | None) -> list[str]:
    """The sentences with the white space after each; joined they are the text."""
    if not text:
        return []
    out, at = [], 0
    for m in END.finditer(text):
        if m.end() > at:
            out.append(text[at : m.end()])
            at = m.end()
    if at < len(text):
        out.append(text[at:])
    if not any(len(s) > 2 * LONG for s in out):
        return out
    # split() finds as many words or more, as it knows more kinds of white space
    words = {i: w for i, s in enumerate(out) if len(s) > 2 * LONG and len(s.split()) > LONG and len(w := WORD.findall(s)) > LONG}
    if not words:
        return out
    cuts, short, done = cut_points(words.values()), [], 0
    for i, ws in words.items():
        s = out[i]
        short += out[done:i]
        done = i + 1
        at, part = 0, s[: len(s) - sum(map(len, ws))]  # white space that leads the text
        for k in next(cuts):
            short.append(part + "".join(ws[at : k + 1]))
            at, part = k + 1, ""
        if at < len(ws):
            short.append(part + "".join(ws[at:]))
    return short + out[done:]


class _Hashes(dict):
    """The hash of each word, white space after it aside; words come again and again."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_HASHES:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word.strip().encode("utf-8", "surrogatepass"))
        return value


_HASHES = _Hashes()


def cut_points(sentences: Iterable[list[str]]) -> Iterator[list[int]]:
    """The words after which each long sentence is cut: where the word's hash is the least of NEAR words before and after
    it in the sentence, which depends on nothing but these words, and after every RUN words of a run of one word."""
    hashes, begins = [EDGE] * NEAR, []
    for words in sentences:
        begins.append(len(hashes))
        hashes += map(_HASHES.__getitem__, words)
        hashes += [EDGE] * NEAR
    h = np.array(hashes)
    least = np.full(len(h), 2**32)
    for k in range(1, NEAR + 1):
        np.minimum(least[k:], h[:-k], out=least[k:])
        np.minimum(least[:-k], h[k:], out=least[:-k])
    at = np.arange(len(h))
    run = np.maximum.accumulate(np.where(np.append(True, h[1:] != h[:-1]), at, 0))
    cut = np.flatnonzero(((h < least) | ((at - run) % RUN == RUN - 1)) & (h > EDGE))
    edges = np.searchsorted(cut, [*begins, len(h)]).tolist()
    cut = cut.tolist()
    for begin, low, high in zip(begins, edges, edges[1:]):
        yield [x - begin for x in cut[low:high]]


def spans(parts: list[str]) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, 12-byte hash) of the span from each sentence on that has one."""
    words = [p.encode("utf-8", "surrogatepass").lower().split() for p in parts]
    filled = [i for i, w in enumerate(words) if w]
    joined = [b" ".join(words[i]) for i in filled]
    for k, end in windows([len(words[i]) for i in filled]):
        yield filled[k], filled[end - 1] - filled[k] + 1, xxhash.xxh3_128_digest(b" ".join(joined[k:end]))[:12]


def windows(sizes: list[int], min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int]]:
    """(first, end) of the shortest window from each sentence on with enough sentences and words. sizes: the words of
    each sentence that has any."""
    end, total = 0, 0
    for k in range(len(sizes)):
        if k:
            total -= sizes[k - 1]
        while end < len(sizes) and (end - k < min_sentences or total < min_words):
            total += sizes[end]
            end += 1
        if end - k < min_sentences or total < min_words:
            return
        yield k, end


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def span_rows(docs: DataFrame) -> DataFrame:
    """(doc, text_key, pos, h1, h2) of every span. doc is the doc_id, the greatest long for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text"), list(zip(batch.column("doc").to_pylist(), batch.column("text_key").to_pylist()))
            for low in range(0, len(ids), 512):
                doc, pos, digest = [], [], []
                for d, t in zip(ids[low : low + 512], texts.slice(low, 512).to_pylist()):
                    before = len(pos)
                    for i, _, h in spans(sentences(t)):
                        pos.append(i)
                        digest.append(h)
                    doc += [d] * (len(pos) - before)
                h = np.frombuffer(b"".join(digest), np.dtype([("h1", "<i8"), ("h2", "<i4")]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in doc], pa.int64()), pa.array([k for _, k in doc], pa.int64()), pa.array(pos, pa.int32()), pa.array(h["h1"].copy()), pa.array(h["h2"].copy())],
                    names=["doc", "text_key", "pos", "h1", "h2"],
                )

    return docs.select(doc_key().alias("doc"), text_key().alias("text_key"), "text").where("text <> ''").mapInArrow(run, "doc long, text_key long, pos int, h1 long, h2 int")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc, text_key, starts, first_docs): the first sentences of each document's spans to remove, and the documents that
    hold their first occurrences."""
    rows = written(span_rows(docs))  # read twice; texts are split and hashed once
    place = F.struct("doc", "text_key", "pos")
    firsts = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = written(firsts.select("h1", "h2", F.col("first.doc").alias("first_doc"), F.col("first.text_key").alias("first_key"), F.col("first.pos").alias("first_pos")))
    later = rows.join(firsts, ["h1", "h2"]).where("doc <> first_doc or text_key <> first_key or pos <> first_pos")
    return later.groupBy("doc", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("starts"), F.sort_array(F.collect_set("first_doc")).alias("first_docs"))


def cut_spans(text: str | None, starts: list[int]) -> tuple[str, int, int]:
    """The text without the spans that begin at `starts`, the number of sentences, and how many were removed."""
    parts = sentences(text)
    if not starts:
        return "".join(parts), len(parts), 0
    gone, wanted = [False] * len(parts), set(starts)
    sizes = [len(p.encode("utf-8", "surrogatepass").split()) for p in parts]
    filled = [i for i, n in enumerate(sizes) if n]
    for k, end in windows([sizes[i] for i in filled]):
        if filled[k] in wanted:
            for i in range(filled[k], filled[end - 1] + 1):
                gone[i] = True
    return "".join(p for p, g in zip(parts, gone) if not g), len(parts), sum(gone)


def span_dedup(docs: DataFrame, changed_only: bool = False) -> DataFrame:
    """docs with the repeated sentences cut out of text, and n_sentences, n_removed, first_doc_ids. changed_only: only
    the documents that lose sentences."""
    found = repeated_ranges(docs).select(F.col("doc").alias("__sd_doc"), F.col("text_key").alias("__sd_text"), F.col("starts").alias("__sd_starts"), F.col("first_docs").alias("first_doc_ids"))
    keep = [c for c in docs.columns if c not in ("text", "n_sentences", "n_removed", "first_doc_ids")]
    keyed = docs.select(*[F.col(f"`{c}`") for c in [*keep, "text"]]).withColumns({"__sd_doc": doc_key(), "__sd_text": text_key()})
    joined = keyed.join(found.hint("shuffle_hash"), ["__sd_doc", "__sd_text"], "inner" if changed_only else "left")

    def compute(columns: dict[str, list]) -> dict[str, list]:
        done = [cut_spans(t, r or []) for t, r in zip(columns["text"], columns["__sd_starts"])]
        return {"text": [None if t is None else x[0] for t, x in zip(columns["text"], done)], "n_sentences": [x[1] for x in done], "n_removed": [x[2] for x in done]}

    out = add_columns(joined, [*keep, "first_doc_ids"], "text string, n_sentences long, n_removed long", compute, ["text", "__sd_starts"])
    return out.where("n_removed > 0") if changed_only else out


def span_report(docs: DataFrame) -> DataFrame:
    """(doc_id, first_doc_ids, n_sentences, n_removed, kept_chars, kept_sha256) of each document that loses sentences."""
    out = span_dedup(docs.select("doc_id", "text"), changed_only=True)
    return out.select("doc_id", "first_doc_ids", "n_sentences", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
