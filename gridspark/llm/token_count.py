"""Token counts by a finite-state tokenizer: byte-level BPE compiled into deterministic transducers.

Two transducers run one after the other.

*Splitter.* The pattern that cuts a text into pieces before BPE is compiled into a transducer over 13 character
classes. Its transitions say whether a piece begins at the character just read, or earlier: a piece can end one to
three characters before this is known (contractions, the last blank of a run), so an output is a small number of
cut positions relative to the character. All texts of a batch, each closed by a reset character, form one sequence,
which is cut into equal chunks. Each chunk yields a state map, the exit state for every entry state, for all chunks at
once; the maps compose by a parallel prefix scan (composition is associative), which gives every chunk its true entry
state; then all chunks emit. Nothing is carried over from chunk to chunk in a loop, so a very long text costs what
many short ones do.

*Merger.* A BPE encoding is the one token sequence whose neighbours are all compatible (the pair's bytes encode to
just this pair). So the encoding of a prefix has one last token, which depends on a bounded number of bytes before it,
and the token count of a piece is what a deterministic transducer over bytes adds up. Its states are the last tokens
of the recent prefixes, as far back as a vocabulary entry may still reach; a transition emits the change of the token
count. It is determinised on demand, in every worker, and dropped when it outgrows ``MAX_STATES``, also in the midst of a
piece, whose state is carried over; so is the table of pieces already counted (``MAX_PIECES``).

The vocabulary is read from a `tokenizers` JSON file of a byte-level BPE; one with any setting that isn't implemented here
is refused. Special strings in texts count as the library's default has it: an added special token is one token, found
before anything else.

Defined results: a null or empty text has no bytes and no tokens; repeated rows count alike; a null doc_id is carried
along; an empty table gives an empty table; carried columns named as the new ones are replaced.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from gridspark.llm.common import add_columns

LIMIT = 512
MAX_STATES, MAX_PIECES, CHUNK = 200_000, 1_000_000, 256

# Classes of the splitter: the letters of the contractions, other letters, numbers, blank, other white space, the
# apostrophe, the rest, and the end of a text.
C_S, C_T, C_R, C_E, C_V, C_M, C_L, C_D, C_LETTER, C_NUMBER, C_BLANK, C_SPACE, C_QUOTE, C_OTHER, C_END = range(15)
#: White space outside the separator categories (fixed by Unicode's White_Space).
OTHER_SPACE = "\t\n\x0b\x0c\r\x85"


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point; the one after the last stands for the end of a text."""
    out = np.full(sys.maxunicode + 2, C_OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))
        if kind[0] == "L":
            out[i] = C_LETTER
        elif kind[0] == "N":
            out[i] = C_NUMBER
        elif kind[0] == "Z" or chr(i) in OTHER_SPACE:
            out[i] = C_SPACE
    for ch, c in zip("strevmld' ", (C_S, C_T, C_R, C_E, C_V, C_M, C_L, C_D, C_QUOTE, C_BLANK)):
        out[ord(ch)] = c
    out[-1] = C_END
    return out


# States of the splitter, by what the piece that is open holds. HELD_*: white space whose last character may still
# belong to the next piece. ONE: a single blank, which joins what follows. QUOTE: an apostrophe that began a piece;
# QUOTE_R/V/L: the same and a letter that may complete 're, 've, 'll.
NEW, LETTERS, NUMBERS, OTHERS, ONE_BLANK, ONE_SPACE, MANY_BLANK, MANY_SPACE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, DONE = range(13)
STATES = 13
#: Outputs are sets of cut positions: bit j says that a piece begins j characters before the character read.
AT, BEFORE, BEFORE2 = 1, 2, 4


def _opened(c: int) -> int:
    """The state after a piece that begins with a character of class c."""
    if c <= C_LETTER:
        return LETTERS
    return {C_NUMBER: NUMBERS, C_BLANK: ONE_BLANK, C_SPACE: ONE_SPACE, C_QUOTE: QUOTE, C_OTHER: OTHERS, C_END: NEW}[c]


def _step(state: int, c: int) -> tuple[int, int]:
    """The next state and the cuts, when a character of class c is read."""
    white, end = c in (C_BLANK, C_SPACE), c == C_END
    kind = LETTERS if c <= C_LETTER else NUMBERS if c == C_NUMBER else OTHERS if c in (C_QUOTE, C_OTHER) else None
    if end:
        return NEW, AT
    if state in (NEW, DONE):
        return _opened(c), AT
    if state in (LETTERS, NUMBERS, OTHERS):
        return (state, 0) if kind == state else (_opened(c), AT)
    if state in (ONE_BLANK, ONE_SPACE, MANY_BLANK, MANY_SPACE):
        if white:
            return (MANY_BLANK if c == C_BLANK else MANY_SPACE), 0
        if state == ONE_BLANK:
            return kind, 0
        if state == MANY_BLANK:
            return kind, BEFORE
        # the run's last character is no blank: it stays a piece of its own, or by itself
        return _opened(c), AT | (BEFORE if state == MANY_SPACE else 0)
    if state == QUOTE:
        if c in (C_S, C_T, C_M, C_D):
            return DONE, 0
        if c in (C_R, C_V, C_L):
            return {C_R: QUOTE_R, C_V: QUOTE_V, C_L: QUOTE_L}[c], 0
        return (OTHERS, 0) if kind == OTHERS else (_opened(c), AT)
    # QUOTE_R, QUOTE_V, QUOTE_L: the contraction is complete, or the letter began a piece after the apostrophe
    if (state, c) in ((QUOTE_R, C_E), (QUOTE_V, C_E), (QUOTE_L, C_L)):
        return DONE, 0
    return (LETTERS, BEFORE) if kind == LETTERS else (_opened(c), AT | BEFORE)


NEXT = np.array([[_step(s, c)[0] for c in range(15)] for s in range(STATES)], np.uint8)
CUTS = np.array([[_step(s, c)[1] for c in range(15)] for s in range(STATES)], np.uint8)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Row i: the composition of the state maps 0 to i, in about log2(n) rounds of composing all pairs at a distance."""
    maps, gap = maps.copy(), 1
    while gap < len(maps):
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap], axis=1)
        gap *= 2
    return maps


def piece_starts(codes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where the pieces of a sequence of classes begin; each C_END begins a piece of its own."""
    n = len(codes)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, C_END, np.uint8)
    grid[:n] = codes
    columns = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    # state * 15 + class indexes the flat table
    flat, cuts = (NEXT.astype(np.uint8) * 15).ravel(), CUTS.ravel()
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8) * 15, (rows, STATES)).copy()
    for column in columns:
        np.take(flat, maps + column[:, None], out=maps)
        if (maps == maps[:, :1]).all():  # every entry state has led to the same state: no map tells more from here on
            maps = _rest(maps[:, 0], columns, column, flat)
            break
    scanned = prefix_scan(maps // 15)
    state = np.empty(rows, np.uint8)
    state[0], state[1:] = NEW * 15, scanned[:-1, NEW] * 15
    out = np.empty((chunk, rows), np.uint8)
    for j, column in enumerate(columns):
        at = state + column
        np.take(cuts, at, out=out[j])
        state = flat[at]
    marks = np.ascontiguousarray(out.T).ravel()[:n]
    starts = (marks & AT) > 0
    for back, bit in ((1, BEFORE), (2, BEFORE2)):
        starts[:-back] |= (marks[back:] & bit) > 0
    return np.flatnonzero(starts)


def _rest(state: np.ndarray, columns: np.ndarray, column: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The maps of chunks whose state no longer depends on the entry state, run to the chunk's end."""
    done = next(j for j in range(len(columns)) if columns[j] is column or np.shares_memory(columns[j], column))
    for later in columns[done + 1 :]:
        state = flat[state + later]
    return np.repeat(state[:, None], STATES, axis=1)


def refuse_unknown(spec: dict) -> None:
    """Raises where the file asks for anything but what is implemented: no normalizer, the byte-level splitter with its
    pattern and without a prefix blank, plain BPE, and added tokens that are found as they stand."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [
        *(k for k in ("normalizer", "truncation", "padding") if spec.get(k)),
        *(k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)),
        *(k for k in ("lstrip", "rstrip", "single_word", "normalized") if any(t.get(k) for t in spec.get("added_tokens", ()))),
    ]
    if model.get("type", "BPE") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        wrong.append("pre_tokenizer or model type")
    if wrong:
        raise ValueError(f"the vocabulary file has settings that aren't implemented: {', '.join(wrong)}")


def byte_letters() -> dict[str, int]:
    """The printable letter by which a byte-level vocabulary writes each byte (fixed by the file format)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Merger:
    """The byte transducer of one vocabulary. A state is the tuple of (last token, tokens since) of the recent
    prefixes, the newest last; its transitions are kept as they are found."""

    tokens: dict[bytes, int]
    ranks: dict[tuple[int, int], tuple[int, int]]
    specials: tuple[str, ...] = ()
    spell: dict[int, bytes] = field(default_factory=dict)
    longest: int = 0
    compatible: dict[tuple[int, int], bool] = field(default_factory=dict)
    states: list[tuple[bytes, tuple[int, ...], tuple[int, ...]]] = field(default_factory=list)
    known: dict[tuple, int] = field(default_factory=dict)
    moves: list[dict[int, tuple[int, int]]] = field(default_factory=list)
    pieces: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.spell = {i: b for b, i in self.tokens.items()}
        self.longest = max(map(len, self.tokens))
        self.prefixes = {b[:k] for b in self.tokens for k in range(1, len(b) + 1)}
        self.reset()

    @staticmethod
    def load(path: str) -> Merger:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse_unknown(spec)
        letters = byte_letters()
        raw = lambda word: bytes(letters[ch] for ch in word)
        specials = tuple(t["content"] for t in spec.get("added_tokens", ()))
        vocabulary = {w: i for w, i in spec["model"]["vocab"].items() if w not in specials}
        tokens = {raw(w): i for w, i in vocabulary.items()}
        ranks = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            ranks[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        return Merger(tokens, ranks, specials)

    def reset(self, at: int = 0) -> int:
        """Only the initial state, no byte read, and the state `at`, whose new number is given back. A state: the bytes that
        may still be part of a longer token, and for each of their prefixes, the empty one first, the last token (-1: none)
        and the token count, counted from the last."""
        kept = [(b"", (-1,), (0,))] + ([self.states[at]] if at else [])
        self.states, self.moves, self.known = kept, [{} for _ in kept], {s: i for i, s in enumerate(kept)}
        self.compatible.clear()
        return len(kept) - 1

    def merge(self, ids: list[int]) -> list[int]:
        """Plain BPE: the pair of the lowest rank is merged, leftmost first, until none is left."""
        while len(ids) > 1:
            best = min(((self.ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.ranks), default=None)
            if best is None:
                break
            ids[best[1] : best[1] + 2] = [self.ranks[ids[best[1]], ids[best[1] + 1]][1]]
        return ids

    def fits(self, a: int, b: int) -> bool:
        """Whether a, b is how BPE encodes the bytes of both."""
        if a < 0:
            return True
        found = self.compatible.get((a, b))
        if found is None:
            found = self.merge([self.tokens[bytes((x,))] for x in self.spell[a] + self.spell[b]]) == [a, b]
            self.compatible[a, b] = found
        return found

    def whole(self, token: int) -> bool:
        """Whether BPE can make the token at all from its own bytes."""
        found = self.compatible.get((token, -1))
        if found is None:
            found = self.merge([self.tokens[bytes((x,))] for x in self.spell[token]]) == [token]
            self.compatible[token, -1] = found
        return found

    def move(self, at: int, byte: int) -> tuple[int, int]:
        """The state after one more byte and the change of the token count."""
        recent, last, counts = self.states[at]
        text = recent + bytes((byte,))
        for start in range(len(text)):
            token = self.tokens.get(text[start:])
            if token is not None and self.whole(token) and self.fits(last[start], token):
                break
        else:
            raise ValueError("the vocabulary lacks single bytes")
        last, count = (*last, token), counts[start] + 1
        delta = count - counts[-1]
        # what no vocabulary entry can continue from is forgotten
        keep = next((k for k in range(len(text)) if text[k:] in self.prefixes), len(text))
        state = (text[keep:], last[keep:], tuple(c - count for c in (*counts, count)[keep:]))
        if state not in self.known:
            self.known[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        out = self.moves[at][byte] = (self.known[state], delta)
        return out

    def count(self, piece: bytes) -> int:
        at = total = 0
        for byte in piece:
            step = self.moves[at].get(byte)
            if step is None:
                if len(self.states) > MAX_STATES or len(self.compatible) > 4 * MAX_STATES:
                    at = self.reset(at)
                step = self.move(at, byte)
            at = step[0]
            total += step[1]
        return total

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            whole = [text]
            for special in self.specials:
                if special in text:
                    cut = [x.split(special) for x in whole]
                    extra[i] += sum(len(x) - 1 for x in cut)
                    whole = [y for x in cut for y in x]
            for x in whole:
                if x:
                    parts.append(x)
                    owner.append(i)
        if not parts:
            return extra.tolist()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        text = "\0".join(parts) + "\0"
        ends = np.cumsum(sizes) - 1
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = classes()[points]
        codes[ends] = C_END
        starts = piece_starts(codes)
        del points, codes
        stops = np.append(starts[1:], len(text))
        real = ~np.isin(starts, ends, assume_unique=True)
        starts, stops = starts[real], stops[real]
        pieces = self.pieces
        if len(pieces) > MAX_PIECES:
            pieces.clear()
        cut = [text[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
        each = list(map(pieces.get, cut))
        if None in each:
            fresh = {p: self.count(p.encode("utf-8", "surrogatepass")) for p in {p for p, n in zip(cut, each) if n is None}}
            each = [fresh[p] if n is None else n for p, n in zip(cut, each)]
            pieces.update((p, n) for p, n in fresh.items() if len(p) <= 64)
        each = np.array(each, np.int64)
        totals = np.add.reduceat(each, np.searchsorted(starts, ends - sizes + 1)) if len(each) else []
        np.add.at(extra, owner, totals)
        return extra.tolist()


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger.load(path)


def _file(name: str) -> str:
    """The vocabulary file of that name on this machine; a path stays what it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_counts(docs: DataFrame, vocabulary: str, carry: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """docs' `carry` columns (default: all but the text) with n_bytes, n_tokens and over_limit. One pass, no shuffle.
    vocabulary: a path that every executor can read, or the name of a file of the public_tokenizers package."""

    def compute(columns: dict[str, list]) -> dict[str, list]:
        texts, model, n_tokens, batch, size = columns["text"], merger(_file(vocabulary)), [], [], 0
        for t in texts:
            batch.append(t)
            size += len(t or "")
            if size > 2_000_000:
                n_tokens += model.counts(batch)
                batch, size = [], 0
        n_tokens += model.counts(batch)
        return {"n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n_tokens, "over_limit": [n > limit for n in n_tokens]}

    return add_columns(docs, [c for c in docs.columns if c != "text"] if carry is None else carry, "n_bytes long, n_tokens long, over_limit boolean", compute, ["text"])
