"""Secret scan: fixed patterns, and character Markov models of random strings.

Two first-order character models, one of random strings and one of ordinary
identifiers, are trained from labelled samples. A candidate run whose log-likelihood
ratio exceeds the log of the prior odds is a secret. All of it is Spark expressions:
positions come from the lengths of what a pattern splits and matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upwell.llm._common import fresh_name

Step = Callable[[Column, Column], Column]

#: Patterns by contract (fixed values); only ASCII letters of the key words vary in case.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: What the models judge: runs of 16 or more characters that encoded secrets use (the hyphen last, as in a class).
CHARS = "A-Za-z0-9+/_=-"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Private characters that stand for those of ``ALPHABET`` within base spans.
MARKED = "".join(chr(0xE000 + i) for i in range(len(ALPHABET)))

#: Natural log of the odds that a candidate is an ordinary string.
PRIOR_LOG_ODDS = math.log(1000.0)
#: Bound of the labelled sample: documents for ordinary words, and random strings.
SAMPLE_DOCUMENTS, SAMPLE_RANDOM = 512, 4096
KINDS = ["assign", "access", "hex", "random"]
SPAN = "struct<start:int,ord:int,end:int>"
#: Arrays grow within blocks of 2**BLOCK_BITS items; texts are cut by blocks of 2**CUT_BITS characters.
BLOCK_BITS, CUT_BITS = 6, 10


def _either(first: str, last: str | None = None) -> str:
    """Regex class content: the characters from ``first`` to ``last``, plain and marked."""
    last = last or first
    return f"{first}-{last}{MARKED[ALPHABET.index(first)]}-{MARKED[ALPHABET.index(last)]}"


_MARKED_ACCESS = "".join(f"[{_either(c)}]" for c in "AKIA") + f"[{_either('A', 'Z')}{_either('0', '9')}]+"
_MARKED_HEX = f"[{_either('0', '9')}{_either('a', 'f')}]{{16,}}"


def labelled_samples(docs: DataFrame, n_docs: int = SAMPLE_DOCUMENTS, n_random: int = SAMPLE_RANDOM) -> DataFrame:
    """``sample string, label int``: 1 random, 0 ordinary.

    Random strings are encodings of digests of a counter. Ordinary ones are letter runs
    of about ``n_docs`` documents, taken by the hash of doc_id (rows without one or without
    a text aren't taken), and identifiers made of neighbours among them in the usual styles.
    """
    digest = lambda salt: F.unhex(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))
    size = (16 + F.col("id") % 25).cast("int")
    b64 = lambda salt: F.substring(F.base64(digest(salt)), F.lit(1), size)
    plain = lambda c: F.translate(c, "+/=", "xYz")
    rand = docs.sparkSession.range(0, n_random, numPartitions=4).select(
        F.explode(
            F.array(b64("a"), plain(b64("b")), F.lower(plain(b64("c"))), F.upper(plain(b64("d"))), F.substring(F.lower(F.hex(digest("e"))), F.lit(1), size))
        ).alias("sample"),
        F.lit(1).alias("label"),
    )
    unit = 1 << 40
    usable = docs.filter("doc_id is not null and text is not null")
    total = max(1, usable.count())
    share = min(unit, unit * n_docs // total)
    # few documents make many samples, so they are dealt to all cores
    some = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(unit)) < share).select("text").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    runs = some.select(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,}(?![A-Za-z0-9+/_=-])"), F.lit(0)).alias("w"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))),
        lambda i: F.struct(F.get(F.col("w"), i - 1).alias("a"), F.coalesce(F.get(F.col("w"), i), F.lit("of")).alias("b"), i.alias("i")),
    )
    p = runs.filter(F.size("w") > 0).select(F.explode(pairs).alias("p")).select("p.*")
    a, b, n = F.col("a"), F.col("b"), F.col("i").cast("string")
    styles = F.array(
        a, a, F.concat_ws("_", a, b), F.concat_ws("-", a, b), F.concat_ws("/", a, b), F.concat(a, F.initcap(b)), F.concat(F.initcap(a), F.initcap(b)),
        F.upper(F.concat_ws("_", a, b)), F.concat_ws("_", a, n), F.concat(a, n), F.concat_ws("-", n, b), F.concat(F.lit("--"), a, F.lit("=="), b),
    )
    return rand.unionByName(p.select(F.explode(styles).alias("sample"), F.lit(0).alias("label")))


def fit_models(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log ratios of the transition probabilities, at 128 * first code + second code.

    The counts that reach the driver are at most one per label and pair of ``ALPHABET``.
    Samples that are null or hold other characters count with their known pairs only.
    """
    ahead = lambda chars, by: F.slice(chars, F.lit(by), F.size(chars) - 1)
    pairs = _let(F.split("sample", ""), lambda chars: F.zip_with(ahead(chars, 1), ahead(chars, 2), lambda a, b: F.concat(a, b)))
    grouped = samples.filter(F.length("sample") > 1).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n"))
    known = grouped.filter(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))
    counts = {(r["label"], r["pair"]): r["n"] for r in known.collect()}
    table = [0.0] * (128 * 128)
    k = len(ALPHABET)
    for first in ALPHABET:
        rows = {y: [counts.get((y, first + second), 0) + smoothing for second in ALPHABET] for y in (0, 1)}
        total = {y: sum(rows[y]) for y in (0, 1)}
        for j in range(k):
            table[128 * ord(first) + ord(ALPHABET[j])] = math.log(rows[1][j] / total[1]) - math.log(rows[0][j] / total[0])
    return table


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _walk(items: Column, first: Column, state: Step, keep: Step, item: Step, none: Column) -> Column:
    """``struct<s, out>``: the last state, and ``item(state, x)`` of the items that ``keep`` takes.

    Arrays are extended within blocks of items only, so the time is linear in their number.
    """

    def block(s: Column, part: Column) -> Column:
        step = lambda acc, x: F.struct(
            state(acc["s"], x).alias("s"), F.when(keep(acc["s"], x), F.array_append(acc["out"], item(acc["s"], x))).otherwise(acc["out"]).alias("out")
        )
        return F.aggregate(part, F.struct(s.alias("s"), none.alias("out")), step)

    def over(all_items: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.shiftright(F.greatest(F.size(all_items) - 1, F.lit(0)), BLOCK_BITS))
        blocks = F.transform(numbers, lambda b: F.slice(all_items, b * (1 << BLOCK_BITS) + 1, F.lit(1 << BLOCK_BITS)))
        more = lambda acc, part: _let(block(acc["s"], part), lambda got: F.struct(got["s"].alias("s"), F.array_append(acc["out"], got["out"]).alias("out")))
        walked = F.aggregate(blocks, F.struct(first.alias("s"), F.slice(F.array(none), 1, 0).alias("out")), more)
        return _let(walked, lambda w: F.struct(w["s"].alias("s"), F.flatten(w["out"]).alias("out")))

    return _let(items, over)


def _matches(text: Column, pattern: str, ok: Callable[[Column], Column]) -> Column:
    """Array of ``m, gap, good``: the leftmost matches, what lies before each, and whether it counts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(found, F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap"), F.coalesce(m.isNotNull() & ok(m), F.lit(False)).alias("good")))


def _placed(matches: Column) -> Column:
    """Array of ``start, m, end`` of the matches that count, in code points."""
    start = lambda pos, x: pos + F.length(x["gap"])
    end = lambda pos, x: start(pos, x) + F.coalesce(F.length(x["m"]), F.lit(0))
    place = lambda pos, x: F.struct(start(pos, x).alias("start"), x["m"].alias("m"), end(pos, x).alias("end"))
    return _walk(matches, F.lit(0), end, lambda _, x: x["good"], place, _none("struct<start:int,m:string,end:int>"))["out"]


def _span(start: Column, order: int, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"))


def _mark(s: Column) -> Column:
    return F.translate(s, ALPHABET, MARKED)


def _plain(s: Column) -> Column:
    return F.translate(s, MARKED, ALPHABET)


def _base(text: Column, pattern: str, order: int, ok: Callable[[Column], Column]) -> Column:
    """``struct<spans, text>``: spans of a kind, and the text with their characters marked."""

    def both(matches: Column) -> Column:
        spans = F.transform(_placed(matches), lambda x: _span(x["start"], order, x["end"]))
        parts = F.transform(matches, lambda x: F.concat(x["gap"], F.when(x["good"], _mark(x["m"])).otherwise(F.coalesce(x["m"], F.lit("")))))
        return F.struct(spans.alias("spans"), F.array_join(parts, "").alias("text"))

    nothing = F.struct(_none(SPAN).alias("spans"), text.alias("text"))
    return F.when(text.rlike(pattern), _let(_matches(text, pattern, ok), both)).otherwise(nothing)


def _ratio(s: Column, model: Column) -> Column:
    # the state before the first character has no row in the table
    def step(acc: Column, c: Column) -> Column:
        more = F.coalesce(F.get(model, acc["last"] * 128 + F.ascii(c)), F.lit(0.0))
        return F.struct(F.ascii(c).alias("last"), (acc["sum"] + more).alias("sum"))

    return F.aggregate(F.split(s, ""), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), step)["sum"]


def _random(text: Column, model: Column, prior_log_odds: float) -> Column:
    """Spans of the random kind in a text whose base spans are marked."""
    marked = f"[{MARKED[0]}-{MARKED[-1]}]"

    def spans(x: Column) -> Column:
        # stretches between marks, with the character before and after
        held = _placed(_matches(x["m"], f"{marked}?[{CHARS}]+{marked}?", lambda y: _ratio(_plain(y), model) > 0))
        lead = lambda y: F.when(y["m"].rlike(f"^{marked}"), 1).otherwise(0)
        tail = lambda y: F.when(y["m"].rlike(f"{marked}$"), 1).otherwise(0)
        rest = F.transform(held, lambda y: _span(x["start"] + y["start"] + lead(y), 3, x["start"] + y["end"] - tail(y)))
        return F.when(x["m"].rlike(marked), rest).otherwise(F.array(_span(x["start"], 3, x["end"])))

    pattern = f"[{MARKED[0]}-{MARKED[-1]}{CHARS}]{{16,}}"
    likely = _placed(_matches(text, pattern, lambda m: _ratio(_plain(m), model) > prior_log_odds))
    return F.when(text.rlike(pattern), F.flatten(F.transform(likely, spans))).otherwise(_none(SPAN))


def find_secrets(docs: DataFrame, model: list[float], prior_log_odds: float = PRIOR_LOG_ODDS, column: str = "found") -> DataFrame:
    """Adds ``column`` to ``docs``: array of struct ``start, ord, end``, sorted.

    ``ord`` is the position in ``KINDS``; positions count code points, the end is
    exclusive. Base kinds are leftmost and non-overlapping by kind; random spans are added
    only where no base span is: of one that base spans cover in part, the stretches they
    leave stay if they are likelier random than ordinary. A null text counts as empty: no spans. Every row is
    judged alone, so repeated rows give the same; other columns pass through, and an
    existing ``column`` is replaced. Time is linear in the length and matches of a text.

    Base spans are marked by moving their characters to private ones, so that candidates
    carry along which of their characters are taken.
    """
    # a cast of a constant is folded once, a higher-order function would run per candidate
    table = F.split(F.lit(",".join(f"{x:.4g}" for x in model)), ",").cast("array<double>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # private characters of the text itself match nothing
    foreign = (F.length(text) != F.octet_length(text)) & text.rlike(f"[{MARKED[0]}-{MARKED[-1]}]")
    clean = F.when(foreign, F.translate(text, MARKED, "\x01" * len(MARKED))).otherwise(text)
    names = [fresh_name(n, docs) for n in ("_clean", "_assign", "_access", "_hex", "_random")]
    start, assign, access, hexa, extra = names
    out = docs.withColumn(start, clean)
    out = out.withColumn(assign, _base(F.col(start), ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12))
    out = out.withColumn(access, _base(F.col(assign)["text"], _MARKED_ACCESS, 1, lambda m: F.length(m) >= 18))
    # the whole run must have 16 or more characters, so shorter runs need no look
    out = out.withColumn(hexa, _base(F.col(access)["text"], _MARKED_HEX, 2, lambda m: F.lit(True)))
    out = out.withColumn(extra, _random(F.col(hexa)["text"], table, prior_log_odds))
    every = F.array_sort(F.concat(*(F.col(n)["spans"] for n in (assign, access, hexa)), F.col(extra)))
    return out.withColumn(column, every).drop(*names)


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["ord"]), x["start"], x["end"])), ",")


def report(found: DataFrame, column: str = "found") -> DataFrame:
    """``doc_id``, counts by base kind, the digest of base spans, and all spans as text."""
    count = lambda k: F.size(F.filter(column, lambda x: x["ord"] == k)).cast("long")
    return found.select(
        F.col("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(F.filter(column, lambda x: x["ord"] < 3)), 256).alias("base_sha256"),
        _listed(F.col(column)).alias("spans"),
        count(3).alias("n_random"),
    )


def _cut(blocks: Column, a: Column, b: Column) -> Column:
    """Characters ``a`` to ``b`` (exclusive) of a text in blocks of 2**CUT_BITS."""
    i, j = F.shiftright(a, CUT_BITS), F.shiftright(b, CUT_BITS)
    at = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    skip = lambda k, n: n - k * (1 << CUT_BITS)
    within = F.substring(at(i), skip(i, a) + 1, b - a)
    across = F.concat(
        F.substring(at(i), skip(i, a) + 1, F.lit(1 << CUT_BITS)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(at(j), F.lit(1), skip(j, b))
    )
    return F.when(i == j, within).otherwise(across)


def redact(found: DataFrame, mark: str = "<secret>", column: str = "found") -> DataFrame:
    """Replaces every span of ``column`` in ``text``; ``n_chars`` follows where it exists.

    Rows without spans, null texts included, stay as they are; spans that overlap share one
    mark. ``column`` is dropped. Time is linear in the length and spans of a text.
    """
    text = F.col("text")

    def done(blocks: Column) -> Column:
        ends = lambda pos, x: F.greatest(pos, x["end"])
        walked = _walk(F.col(column), F.lit(0), ends, lambda pos, x: x["start"] >= pos, lambda pos, x: F.concat(_cut(blocks, pos, x["start"]), F.lit(mark)), _none("string"))
        return _let(walked, lambda w: F.concat(F.array_join(w["out"], ""), _cut(blocks, w["s"], F.length(text))))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << CUT_BITS}}}"), F.lit(0))
    out = found.withColumn("text", F.when(F.size(column) > 0, _let(blocks, done)).otherwise(text)).drop(column)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out


def scan(spark: SparkSession, docs: DataFrame, training: DataFrame | None = None, column: str = "found") -> DataFrame:
    """``docs`` with ``column``, by models trained on samples made from ``training``."""
    return find_secrets(docs, fit_models(labelled_samples(docs if training is None else training)), column=column)


def redacted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; the columns are those of ``docs``."""
    column = fresh_name("found", docs)
    return redact(scan(spark, docs, column=column), column=column)
