"""Quality rules: a linear-chain conditional random field labels each line content or boilerplate.

Every line of a document is described by a set of binary features. A two-state chain (boilerplate, content) with
emission weights per feature and transition weights is decoded by Viterbi; the share of word characters that lie in
content lines decides whether the document is retained. Hard base rules (too few words, too much repetition inside
the text) reject a document before the chain is asked.

The weights are fitted here, by gradient ascent on the conditional likelihood, on a bounded sample of labelled
documents (``FIT_DOCS`` per class, and of each at most ``FIT_CHARS`` code points and ``FIT_WINDOWS`` windows of
``FIT_LINES`` lines, spread evenly over a longer one): the lines of a document marked good count as content, those of a document marked bad as boilerplate.
The sample is drawn by a hash of doc_id, so that a run can be repeated. Every document is judged by all its lines.

Defined results: a null or empty text has no words, fails the base rules and is not kept; a null doc_id is carried
along; repeated rows are judged one by one, alike; an empty table gives an empty table; without labels of both classes
the default weights ``DEFAULT`` are used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import SPACE, add_columns

SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS, LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_BYTES = SPACE.encode()
#: Labelled documents of each class that the fit may use, windows of each and lines of a window, and gradient steps.
FIT_DOCS, FIT_WINDOWS, FIT_LINES, FIT_STEPS = 300, 8, 64, 100
#: Code points of a labelled document that a fit may use; a longer one gives slices spread over all of it.
FIT_CHARS = 100_000
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT_SHARE = 10, 20, 0.5

FEATURES = (
    "no_word", "few_words", "many_words", "mostly_upper", "some_upper", "symbols_5", "symbols_15", "shouting",
    "bars", "word_repeats", "many_repeats", "line_repeats", "ends_sentence", "starts_upper", "digits", "markup", "long_words",
)


@dataclass(frozen=True)
class LineCrf:
    """emission: weight of each feature for content against boilerplate; bias; transition[a][b]: from state a to b;
    state 0 is boilerplate, 1 content."""

    emission: tuple[float, ...]
    bias: float
    transition: tuple[tuple[float, float], tuple[float, float]]


#: Used where no labels exist.
DEFAULT = LineCrf(
    (-0.5, -0.2, 0.3, -3.0, -1.0, -1.5, -2.0, -2.0, -1.5, -0.5, -2.5, -1.0, 0.6, 0.3, -0.3, -1.0, -0.3), 0.8, ((0.6, -0.6), (-0.6, 0.6))
)


def line_mask(line: bytes, seen: bool) -> int:
    """The features of a line as bits, in the order of FEATURES. seen: an earlier line of the document is the same."""
    words = line.split()
    n = len(words)
    if not n:
        return 1
    size = len(line)
    letters = size - len(line.translate(None, LETTERS))
    upper = size - len(line.translate(None, UPPER))
    symbols = size - len(line.translate(None, SYMBOLS))
    distinct = len(set(words))
    repeats = sum(map(bytes.__eq__, words, words[1:])) if distinct < n else 0
    last = words[-1]
    mask = 0
    for bit, on in enumerate((
        False, n < 3, n >= 8, 2 * upper > letters, 5 * upper > letters, 20 * symbols > size, 20 * symbols > 3 * size, 2 * line.count(b"!") > n,
        4 * line.count(b"|") > n, repeats > 0, distinct * 3 < n or 4 * repeats > n, seen, last[-1:] in (b".", b"!", b"?", b'"'), words[0][:1].isupper(), 10 * (size - len(line.translate(None, DIGITS))) > size,
        line.count(b"</") > 0, size > 14 * n,
    )):
        if on:
            mask |= 1 << bit
    return mask


def line_masks(lines: list[bytes]) -> list[int]:
    seen: set[bytes] = set()
    masks = []
    for line in lines:
        masks.append(line_mask(line, line in seen))
        seen.add(line)
    return masks


def emissions(model: LineCrf) -> dict[int, float]:
    """The content score of each feature set, worked out when first asked for; there are at most 2**17."""

    class Scores(dict):
        def __missing__(self, mask: int) -> float:
            value = self[mask] = model.bias + sum(w for i, w in enumerate(model.emission) if mask >> i & 1)
            return value

    return Scores()


def viterbi(scores: list[float], transition: tuple[tuple[float, float], tuple[float, float]]) -> list[int]:
    """The best state sequence of a two-state chain where state 0 scores 0 and state 1 scores[i]; ties go to content."""
    (a00, a01), (a10, a11) = transition
    bad, good, back = 0.0, 0.0, []
    for i, s in enumerate(scores):
        if i:
            to_bad, to_good = (bad + a00 > good + a10), (bad + a01 > good + a11)
            back.append((to_bad, to_good))
            bad, good = (bad + a00 if to_bad else good + a10), (bad + a01 if to_good else good + a11) + s
        else:
            good = s
    states = [int(good >= bad)] if scores else []
    for to_bad, to_good in reversed(back):
        states.append(int(not (to_good if states[-1] else to_bad)))
    return states[::-1]


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in a window of `width` words that is found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    index = dict.fromkeys(words)
    size = len(index)
    if size == len(words):
        return 0
    for i, w in enumerate(index):
        index[w] = i
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    key, top = ids[:n].copy(), size
    for j in range(1, width):
        if top > 2**62 // size:  # keeps the packed window exact for any vocabulary
            key = np.unique(key, return_inverse=True)[1]
            top = n
        key = key * size + ids[j : j + n]
        top *= size
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[width : width + n] -= twice
    return int((np.cumsum(edge) > 0).sum())


def judge(text: str | None, scores: dict[int, float], model: LineCrf) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, n_content_lines, kept."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    dups = 0
    for line in lines:
        if line in seen:
            dups += bool(line.strip())
        else:
            seen.add(line)
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    states = viterbi([scores[m] for m in line_masks(lines)], model.transition)
    sizes = [len(x) - x.count(b" ") for x in lines]
    content, total = sum(s for s, z in zip(sizes, states) if z), sum(sizes)
    share = content / total if total else 0.0
    return (
        len(words), len(text) - (len(raw) - len(raw.translate(None, SPACE_BYTES))), len(raw) - len(raw.translate(None, SYMBOLS)),
        dups, repeats, failed, share, sum(states), not failed and share >= MIN_CONTENT_SHARE,
    )


COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, "
    "n_content_lines long, kept boolean"
)


def quality_rules(docs: DataFrame, model: LineCrf, carry: list[str] | None = None) -> DataFrame:
    """docs' `carry` columns (default: all but the text) with the counts and the verdict `kept`. One pass, no shuffle."""
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def compute(columns: dict[str, list]) -> dict[str, list]:
        scores = emissions(model)
        rows = [judge(t, scores, model) for t in columns["text"]]
        return dict(zip(names, map(list, zip(*rows))))

    return add_columns(docs, [c for c in docs.columns if c != "text"] if carry is None else carry, COLUMNS, compute, ["text"])


def fit_line_crf(docs: DataFrame, labels: DataFrame, per_class: int = FIT_DOCS, steps: int = FIT_STEPS) -> LineCrf:
    """Weights from at most per_class labelled documents of each quality, chosen by a hash of doc_id."""
    chosen = labelled_sample(docs, labels, per_class)
    rows = [(int(q), w) for q, t in chosen for w in windows(line_masks(t.encode("utf-8", "surrogatepass").split(b"\n")))]
    if len({q for q, _ in rows}) < 2:
        return DEFAULT
    return fit(rows, steps)


def windows(lines: list[int], size: int = FIT_LINES, most: int = FIT_WINDOWS) -> list[list[int]]:
    """The lines in windows of at most `size`; of a document with more than `most` windows, that many at even distances."""
    if len(lines) <= size * most:
        return [lines[i : i + size] for i in range(0, len(lines), size)]
    return [lines[i : i + size] for i in (k * (len(lines) - size) // (most - 1) for k in range(most))]


def in_fold(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y) of the labelled rows that a fit may use."""
    return labels.where(f"doc_id is not null and `{column}` in (0, 1) and crc32(cast(doc_id as string)) % 4 != 2").select("doc_id", F.col(column).cast("int").alias("y"))


def excerpt(text: Column, most: int, slices: int = 8) -> Column:
    """The text if it has at most `most` code points, else as many in equal slices at even distances, from its start to its
    end, a line each."""
    size = most // slices
    at = lambda k: F.floor((F.length(text) - size) * k / (slices - 1)).cast("int") + 1
    return F.when(F.length(text) <= most, text).otherwise(F.concat_ws("\n", *[F.substring(text, at(k), F.lit(size)) for k in range(slices)]))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, column: str = "quality", most_chars: int = FIT_CHARS) -> list[tuple[int, str]]:
    """(label, text) of at most per_class documents of each label 0 and 1, of each at most most_chars code points, so that the
    sample is bounded in bytes too. Only labelled rows outside the fold that is held out (crc32 of doc_id modulo 4 is 2)
    are used. The ids are a bounded set, so the texts are found by one scan."""
    good = in_fold(labels, column)
    picked = [good.where(f"y = {y}").distinct().orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(per_class) for y in (0, 1)]
    ids = {(r.doc_id, r.y) for p in picked for r in p.collect()}
    if not ids:
        return []
    wanted = docs.sparkSession.createDataFrame(sorted(ids), "doc_id long, y int")
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(wanted), "doc_id").select("doc_id", "y", "text")
    rows = found.groupBy("doc_id", "y").agg(F.min(excerpt(F.col("text"), most_chars)).alias("text")).collect()
    return [(r.y, r.text) for r in sorted(rows, key=lambda r: (r.doc_id, r.y))]


def fit(rows: list[tuple[int, list[int]]], steps: int = FIT_STEPS, rate: float = 0.15, decay: float = 1e-3) -> LineCrf:
    """Adam on the mean conditional log-likelihood of the state sequences (every line of a row has the row's state)."""
    longest, k = max(len(m) for _, m in rows), len(FEATURES)
    masks, there = np.zeros((len(rows), longest), np.int64), np.zeros((len(rows), longest), bool)
    truth = np.array([q for q, _ in rows], float)
    for i, (_, m) in enumerate(rows):
        masks[i, : len(m)], there[i, : len(m)] = m, True
    x = (masks[..., None] >> np.arange(k) & 1).astype(float) * there[..., None]
    # each class weighs the same, however many documents it has
    weight = np.where(truth > 0, 0.5 / max(1, truth.sum()), 0.5 / max(1, (1 - truth).sum()))
    sizes = there.sum(1)
    weight = weight / np.maximum(1, sizes)
    theta, m1, m2 = np.zeros(k + 1 + 4), np.zeros(k + 5), np.zeros(k + 5)
    for step in range(1, steps + 1):
        w, bias, a = theta[:k], theta[k], theta[k + 1 :].reshape(2, 2)
        s = x @ w + bias
        unary = np.stack([np.zeros_like(s), s], -1)
        forward, backward = np.zeros((len(rows), longest, 2)), np.zeros((len(rows), longest, 2))
        forward[:, 0] = unary[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + a, axis=1) + unary[:, t]
            forward[:, t] = np.where(there[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(a + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(there[:, t + 1, None], new, 0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        p1 = np.exp(forward[..., 1] + backward[..., 1] - z[:, None]) * there
        gap = (truth[:, None] * there - p1) * weight[:, None]
        grad = np.zeros(k + 5)
        grad[:k], grad[k] = np.tensordot(gap, x, ([0, 1], [0, 1])), gap.sum()
        if longest > 1:
            pair = forward[:, :-1, :, None] + a + (unary[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]
            p = np.exp(np.minimum(pair, 0)) * there[:, 1:, None, None]
            seen = np.zeros((len(rows), 2, 2))
            seen[:, 0, 0], seen[:, 1, 1] = (1 - truth) * (sizes - 1), truth * (sizes - 1)
            grad[k + 1 :] = ((seen - p.sum(1)) * weight[:, None, None]).sum(0).ravel()
        grad -= decay * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        theta[k + 1 :] = np.clip(theta[k + 1 :], -1.0, 1.0)  # lines of one label only would make the chain never change its state
    t = theta.round(6).tolist()
    return LineCrf(tuple(t[:k]), t[k], ((t[k + 1], t[k + 2]), (t[k + 3], t[k + 4])))
