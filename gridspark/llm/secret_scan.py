r"""Secret scan: fixed patterns and a randomness test battery, by DataFrame functions only.

*Patterns.* assign (a key word, a sign and a value of 12 or more characters), access (an AKIA identifier of 18 or more)
and hex (16 or more hexadecimal digits). Matches are found leftmost first and non-overlapping within each kind; spans
are in code points. As regular expression functions give no positions, a text is also split by the pattern: the
lengths of what lies between and of the matches add up to the positions.

*Battery.* Tested are the values of the pattern matches and the candidates: what the matches leave uncovered of a run
of [A-Za-z0-9+/_-], if it has ``MIN_RUN`` or more characters with a letter and a digit, as a whole and, between
separators, each letter-and-digit segment of that size. The smallest fitting encoding (hex, base32, base36 of either
case, base62, base64) numbers the characters, and four p-values ask whether they look random:

- chi-squared uniformity over the alphabet. With fewer than five characters a letter the statistic has no
  chi-squared tail; it is the number of equal pairs, which then is Poisson distributed;
- chi-squared over five classes of letters (digits and signs, letters common in English and other letters of either
  case), which has power on short runs;
- the runs test above and below the middle of the alphabet;
- the serial correlation of neighbours, over quarters of the alphabet.

The combined p-value is four times the least. *Decision.* Something is ruled out as not random only where the
Benjamini-Hochberg procedure rejects randomness, over all that was tested of its length class in all documents, at level
``LEVEL``. So of what is ruled out, at most that share is expected to be random, whatever the length: that is the share
of secrets lost, and it is what the level controls. The share of ordinary text among what is flagged is not bounded by
it; tests measure it. Candidates that are not ruled out are spans of kind random (segments only where the whole is
ruled out); pattern matches stay whatever the verdict, which is reported with them.

p-values are counted in bins of a twentieth of a decade, down to 1e-20, so the table that decides the procedure has
a fixed size however much is tested. Matches and candidates are rows: a document's are put together again by a number
given to its row in a written table.

Defined results: a null or empty text has no spans; repeated rows get equal spans; a null doc_id is carried along; an
empty table gives an empty table; carried columns named as the columns made here are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import let, prefix_sums, written

#: Fixed patterns of the base kinds, in the order of their rank, and the least code points of the group that counts.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
#: One of these is in every text that ASSIGN matches.
WORDS = ("passw", "secret", "token", "apikey", "api_key")
MIN_VALUE = 12
KINDS = ("assign", "access", "hex", "random")
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
SEGMENT = r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}"
MIN_RUN, LEVEL, BINS, BINS_PER_DECADE = 20, 0.05, 400, 20
#: Length classes: a run of n code points is in class min(floor(log2(n)), LAST_CLASS).
LAST_CLASS = 12

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings by the pattern that fits, the smallest alphabet first; - and _ stand for + and / in the last.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("BASE36", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", "", UPPER + LOWER + DIGITS + "+/"),
)
COMMON, CLASSES = "etaoinshr", 5


def letter_class(ch: str) -> int:
    """0: digits and signs; 1, 2: common and other small letters; 3, 4: the same of capitals."""
    return 0 if not ch.isalpha() else (1 if ch in COMMON else 2) if ch.islower() else (3 if ch.lower() in COMMON else 4)


def quarter(i: int, size: int) -> int:
    return 4 * i // size


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the pattern's matches; value: the group."""

    def place(both: Column) -> Column:
        sizes = F.transform(both["all"], lambda m: F.length(m).cast("long"))
        steps = F.zip_with(F.transform(F.slice(both["gaps"], 1, F.size(both["all"])), lambda g: F.length(g).cast("long")), sizes, lambda g, m: g + m)
        starts = F.zip_with(prefix_sums(steps), both["gaps"], lambda p, g: p + F.length(g))
        return F.zip_with(F.zip_with(starts, both["all"], lambda s, m: F.struct(s.alias("s"), F.length(m).alias("n"))), both["values"], lambda p, v: F.struct(p["s"].alias("start"), (p["s"] + p["n"]).alias("end"), v.alias("value")))

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("all"), values.alias("values"))
    return F.filter(let(found, place), lambda m: m["value"].isNotNull())


def where_any(test: Column, found: Column) -> Column:
    """found for those few texts that pass a cheap test, else an empty array."""
    return F.when(test, found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))


def matches(text: Column) -> Column:
    """array<struct<start, rank, end, value>> of the fixed patterns, in the order of start and kind."""
    lowered = F.lower(text)
    words = lowered.contains(WORDS[0])
    for word in WORDS[1:]:
        words = words | lowered.contains(word)
    assign = F.filter(where_any(words & text.rlike(ASSIGN), located(text, ASSIGN, 2)), lambda m: F.length(m["value"]) >= MIN_VALUE)
    access = where_any(text.contains("AKIA"), located(text, ACCESS))
    digits = where_any(text.rlike(HEX), located(text, HEX))
    return F.array_sort(F.concat(*[ranked(found, k) for k, found in enumerate((assign, access, digits))]))


def ranked(found: Column, rank: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), m["value"].alias("value")))


def count_of(spans: Column | str, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def uncovered(rows: DataFrame) -> DataFrame:
    """(row, run, start, end, value) of each stretch of a run that no match covers. rows: row, found (matches) and runs.
    Starts of matches and runs are put in order: a stretch begins where the last of either, or the match that reaches
    furthest, lets it, and ends at the next start or the run's end."""
    none, event = F.lit(None), "struct<at:bigint,cover:bigint,run:bigint,stop:bigint,value:string>"
    starts = F.concat(
        F.transform("found", lambda m: F.struct(m["start"].alias("at"), m["end"].alias("cover"), none.alias("run"), none.alias("stop"), none.alias("value")).cast(event)),
        F.transform("runs", lambda r: F.struct(r["start"].alias("at"), none.alias("cover"), r["start"].alias("run"), r["end"].alias("stop"), r["value"].alias("value")).cast(event)),
    )
    events = rows.where("size(runs) > 0").select("row", F.explode(starts).alias("e")).select("row", "e.*")
    order = Window.partitionBy("row").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    placed = events.select("row", F.max("cover").over(so_far).alias("cover"), F.lead("at").over(order).alias("next"), last("run").alias("run"), last("stop").alias("stop"), last("value").alias("value"))
    free = placed.withColumns({"start": F.greatest("run", "cover"), "end": F.least("next", "stop")}).where(f"run is not null and end - start >= {MIN_RUN}")
    return free.select("row", "run", "start", "end", F.substring("value", (F.col("start") - F.col("run") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("value"))


def candidates(rows: DataFrame) -> DataFrame:
    """(row, start, end, value, whole, stretch, rank) of what may be random besides the matches: whole stretches and segments
    of them; stretch is where the stretch begins, of which a row is the whole or a segment."""
    free = uncovered(rows)
    whole = free.select("row", "start", "end", "value", F.lit(True).alias("whole"), F.col("start").alias("stretch"))
    parts = free.where(r"value rlike '[+/_-]'").select("row", "start", F.explode(located(F.col("value"), SEGMENT)).alias("s"))
    parts = parts.select("row", (F.col("start") + F.col("s.start")).alias("start"), (F.col("start") + F.col("s.end")).alias("end"), F.col("s.value").alias("value"), F.lit(False).alias("whole"), F.col("start").alias("stretch"))
    return whole.unionByName(parts).where("value rlike '[0-9]' and value rlike '[A-Za-z]'").withColumn("rank", F.lit(KINDS.index("random")))


def upper_tail(z: Column) -> Column:
    """The probability that a standard normal number exceeds z, by the rational approximation 26.2.17 of Abramowitz
    and Stegun (fixed coefficients; error below 1e-7)."""

    def above_zero(x: Column) -> Column:
        t = F.lit(1.0) / (x * 0.2316419 + 1.0)
        poly = t * (t * (t * (t * (t * 1.330274429 - 1.821255978) + 1.781477937) - 0.356563782) + 0.319381530)
        return F.exp(-x * x / 2.0) * 0.3989422804014327 * poly

    return F.when(z >= 0, above_zero(F.abs(z))).otherwise(F.lit(1.0) - above_zero(F.abs(z)))


def chi_squared_z(x: Column, freedom: Column) -> Column:
    """The normal number of the same tail, by the cube root of Wilson and Hilferty."""
    spread = F.lit(2.0) / (freedom * 9.0)
    return (F.cbrt(x / freedom) - (F.lit(1.0) - spread)) / F.sqrt(spread)


def poisson_z(count: Column, mean: Column) -> Column:
    """The normal number whose upper tail is that of `count` or more, by the same cube root: the tail of a Poisson number
    is that of a chi-squared one with twice the count as its freedom."""
    k = F.greatest(count, F.lit(1e-9))
    return -(F.cbrt(mean / k) - (F.lit(1.0) - F.lit(1.0) / (k * 9.0))) * F.sqrt(k) * 3.0


def removed(text: Column, pattern: str) -> Column:
    """How many characters the pattern takes out of the text."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def battery(rows: DataFrame) -> DataFrame:
    """rows with encoding and p, the combined p-value of `value` against the hypothesis that it is random."""
    number = F.lit(len(ENCODINGS) - 1)
    for k in reversed(range(len(ENCODINGS) - 1)):
        number = F.when(F.col("value").rlike(ENCODINGS[k][1]), k).otherwise(number)
    kinds = []
    for name, _, letters in ENCODINGS:
        classes = "".join(str(letter_class(ch)) for ch in letters)
        kinds.append(F.struct(
            F.lit(name).alias("name"), F.lit(letters).alias("letters"), F.lit(classes).alias("classes"), F.lit("".join(str(quarter(i, len(letters))) for i in range(len(letters)))).alias("quarters"),
            F.lit(len(letters)).alias("size"), F.array(*[F.lit(float(classes.count(str(c)))) for c in range(CLASSES)]).alias("share"),
        ))
    e = lambda field: F.col(f"__e.{field}")
    coded = rows.withColumn("__e", F.element_at(F.array(*kinds), number + 1)).withColumn("__v", F.translate("value", "-_", "+/"))
    coded = coded.withColumns({"__classes": F.call_function("translate", F.col("__v"), e("letters"), e("classes")), "__quarters": F.call_function("translate", F.col("__v"), e("letters"), e("quarters")), "__n": F.length("__v").cast("double")})
    n, size, quarters = F.col("__n"), e("size").cast("double"), F.col("__quarters")
    # uniformity over the alphabet
    squares = F.aggregate(F.sequence(F.lit(1), e("size")), F.lit(0.0), lambda s, i: s + F.pow(n - F.length(F.replace(F.col("__v"), F.substring(e("letters"), i, F.lit(1)), F.lit(""))), F.lit(2.0)))
    # uniformity over the classes
    gap = lambda c: removed(F.col("__classes"), str(c)) - n * F.element_at(e("share"), c + 1) / size
    share = lambda c: F.element_at(e("share"), c + 1)
    classes = sum((F.when(share(c) > 0, gap(c) * gap(c) * size / (n * F.greatest(share(c), F.lit(1.0)))).otherwise(0.0) for c in range(CLASSES)), F.lit(0.0))
    freedom = sum((F.when(share(c) > 0, 1.0).otherwise(0.0) for c in range(CLASSES)), F.lit(-1.0))
    # runs above and below the middle
    halves = F.translate(quarters, "0123", "0011")
    turns = F.length(F.regexp_replace(F.regexp_replace(halves, "0+", "0"), "1+", "1")).cast("double")
    # products of neighbours, each quarter counted as -3, -1, 1, 3
    product = (
        (removed(quarters, "0(?=0)|3(?=3)") - removed(quarters, "0(?=3)|3(?=0)")) * 9.0 + (removed(quarters, "0(?=1)|1(?=0)|2(?=3)|3(?=2)") - removed(quarters, "0(?=2)|2(?=0)|1(?=3)|3(?=1)")) * 3.0
        + removed(quarters, "1(?=1)|2(?=2)") - removed(quarters, "1(?=2)|2(?=1)")
    )
    counted = coded.withColumns({"__squares": squares, "__class_x": classes, "__free": freedom, "__high": removed(halves, "1"), "__turns": turns, "__product": product})
    high = F.col("__high")
    mean = high * (n - high) * 2.0 / n + 1.0
    spread = (mean - 1.0) * (mean - 2.0) / (n - 1)
    tests = counted.withColumns({
        "__letters_z": F.when(n >= size * 5, chi_squared_z(F.col("__squares") * size / n - n, size - 1)).otherwise(poisson_z((F.col("__squares") - n) / 2, n * (n - 1) / 2 / size)),
        "__classes_z": chi_squared_z(F.col("__class_x"), F.col("__free")),
        "__runs_z": F.abs(F.when(spread > 0, (F.col("__turns") - mean) / F.sqrt(F.greatest(spread, F.lit(1e-12)))).otherwise(F.sqrt(n))),
        "__serial_z": F.abs(F.col("__product") / (F.sqrt(n - 1) * 5.0)),
    })
    least = F.least(upper_tail(F.col("__letters_z")), upper_tail(F.col("__classes_z")), upper_tail(F.col("__runs_z")) * 2.0, upper_tail(F.col("__serial_z")) * 2.0)
    return tests.withColumn("p", F.least(F.lit(1.0), least * 4.0)).select(*rows.columns, e("name").alias("encoding"), "p")


def length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(n.cast("double"))).cast("int"), F.lit(LAST_CLASS))


def p_bin(p: Column) -> Column:
    """0 for p of about 1, more for less."""
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS_PER_DECADE).cast("int"), F.lit(BINS))


def rejected_bins(scored: DataFrame, level: float = LEVEL) -> dict[int, int]:
    """For each length class the first bin that Benjamini-Hochberg rejects, with the bins after it. scored: rows with
    `class` and `bin`. At most 13 classes of 401 bins come out of the aggregation, and 13 numbers to the driver."""
    counts = scored.groupBy("class", "bin").count()
    tail = Window.partitionBy("class").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"rank": F.sum("count").over(tail), "all": F.sum("count").over(Window.partitionBy("class"))})
    largest_p = F.pow(F.lit(10.0), -F.col("bin") / F.lit(float(BINS_PER_DECADE)))
    passed = ranked.where(largest_p * F.col("all") <= F.col("rank") * level)
    return {r["class"]: r["bin"] for r in passed.groupBy("class").agg(F.min("bin").alias("bin")).collect()}


def secret_spans(docs: DataFrame, carry: list[str], level: float = LEVEL) -> DataFrame:
    """docs' `carry` columns, base_spans, spans and tests. Spans are arrays of struct<start, rank, end> (rank: the place in
    KINDS), tests an array of struct<start, rank, end, encoding, p, random> for each of the spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    carry = [c for c in carry if c not in ("base_spans", "spans", "tests", "text") and not c.startswith("__ss_")]
    names = [F.col(f"`{c}`") for c in carry]
    runs = where_any(text.rlike(RUN), located(text, RUN))
    table = written(docs.select(*names, F.monotonically_increasing_id().alias("__ss_row"), matches(text).alias("__ss_found"), runs.alias("__ss_runs")))
    some = table.where("size(__ss_found) + size(__ss_runs) > 0").select(F.col("__ss_row").alias("row"), F.col("__ss_found").alias("found"), F.col("__ss_runs").alias("runs"))
    base = some.select("row", F.explode("found").alias("m")).select("row", "m.start", "m.end", "m.value", F.lit(True).alias("whole"), F.col("m.start").alias("stretch"), "m.rank")
    tested = battery(base.unionByName(candidates(some)))
    tested = written(tested.select("row", "start", "end", "whole", "stretch", "rank", "encoding", "p", length_class(F.length("value")).alias("class"), p_bin(F.col("p")).alias("bin")))
    cut = rejected_bins(tested, level)
    limits = F.array(*[F.lit(cut.get(k, BINS + 1)) for k in range(LAST_CLASS + 1)])
    decided = tested.withColumn("random", F.col("bin") < F.element_at(limits, F.col("class") + 1))
    # segments count where the whole stretch is ruled out
    stretch = F.max(F.col("whole") & F.col("random")).over(Window.partitionBy("row", "rank", "stretch"))
    kept = decided.withColumn("above", stretch).where(f"rank < {KINDS.index('random')} or random and (whole or not above)")
    found = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "encoding", "p", "random"))).alias("tests"))
    joined = table.select(*names, "__ss_row", "__ss_found").join(found.withColumnRenamed("row", "__ss_row"), "__ss_row", "left")
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    tests = F.coalesce("tests", F.array().cast(found.schema["tests"].dataType))
    return joined.select(*names, plain(F.col("__ss_found")).alias("base_spans"), plain(tests).alias("spans"), tests.alias("tests"))


def span_text(spans: Column, *more: str) -> Column:
    """kind:start:end and any further fields, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), *[s[c].cast("string") for c in ("start", "end", *more)])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, verdicts) of each document. verdicts: each span with its
    encoding and whether the battery takes it for random."""
    found = secret_spans(docs, ["doc_id"])
    counts = [count_of("base_spans", k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select(
        "doc_id", *counts, F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
        span_text(F.col("tests"), "encoding", "random").alias("verdicts"),
    )
