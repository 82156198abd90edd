"""Secrets: fixed rules, and a battery of randomness tests on every other long token.

A key looks like draws from its alphabet. For each token the encoding is inferred (decimal, hex,
base 32, base 64), and three tests are taken over its letters as numbers of that alphabet: the
chi-squared uniformity of the counts, the runs above and below the middle, and the correlation of
neighbours. A token passes where no test and no sum of them rejects draws at random.

Short tokens pass easily, so passing alone means little. Tokens that hold letters of one case and
no digit are ordinary words (decoys). The sum of squares of the three statistics says how random a
token looks; its p-value is the share of decoys, of its class of length and all shorter ones, that look as
random. Within each class of length the p-values are controlled by Benjamini and Hochberg's rule.
Every different token counts once for the whole table, so copies change nothing. All of it runs in
DataFrame functions; the driver gets the counts of a bounded number of steps of that sum. Texts are searched
once: what is found is stored, for the counts and for the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import read, spans_text, stored
from tidewire.llm.spans import SPAN, as_spans, digest, overlaps, with_matches

KINDS = ("assign", "access", "hex")
EXTRA = "random"
FALSE_DISCOVERIES = 0.05
SINGLE, TOTAL = 3.3, 16.3    # limits of one test, and of the sum of squares (about 1 in 1,000 each)
FAR = 99.0                   # a statistic of tokens that are no draws at all
LENGTH_CLASS = 8             # tokens are classed by length in steps of this
LONGEST_CLASS = 16           # the last class holds all longer tokens
STEPS = 64                   # steps in which the sum of squares is told apart, per unit
LAST_STEP = int(TOTAL * STEPS) + 1    # of tokens that don't pass

# The base rules; letters of the first may be of either case.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
# The alphabets, in the order of their numbers.
ALPHABETS = {
    "dec": "0123456789",
    "hex": "0123456789abcdef",
    "b32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def encoding_of(token: Column) -> Column:
    return (
        F.when(token.rlike("^[0-9]+$"), "dec")
        .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+$"), "b32")
        .otherwise("b64")
    )


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _alphabet_of(encoding: Column) -> Column:
    choice = F.lit(ALPHABETS["b64"])
    for name in ("dec", "hex", "b32"):
        choice = F.when(encoding == name, F.lit(ALPHABETS[name])).otherwise(choice)
    return choice


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _uniformity(letters: Column, n: Column, a: Column) -> Column:
    """Chi-squared of the counts, as a normal deviate with the variance that holds for few letters."""
    counts = F.transform(
        F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)).cast("double")
    )
    chi = _sum(F.transform(counts, lambda c: c * c)) * a / n - n
    return (chi - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)


def _runs(numbers: Column, n: Column, a: Column) -> Column:
    """Runs above and below the middle, given how many numbers are above. One run only: far off."""

    def deviate(high: Column) -> Column:
        both = 2 * high * (n - high)
        turns = _sum(
            F.zip_with(
                F.slice(numbers, F.lit(1), F.size(numbers) - 1),
                F.slice(numbers, F.lit(2), F.size(numbers) - 1),
                lambda x, y: F.when((x >= a / 2) != (y >= a / 2), 1.0).otherwise(0.0),
            )
        )
        variance = both * (both - n) / (n * n * (n - 1))
        return F.when(variance > 0, (turns - both / n) / F.sqrt(variance)).otherwise(F.lit(FAR))

    return _let(F.size(F.filter(numbers, lambda x: x >= a / 2)).cast("double"), deviate)


def _serial(numbers: Column, n: Column) -> Column:
    """Correlation of neighbours; equal numbers only: far off."""

    def deviate(mean: Column) -> Column:
        spread = _sum(F.transform(numbers, lambda x: (x - mean) * (x - mean)))
        shared = _sum(
            F.zip_with(
                F.slice(numbers, F.lit(1), F.size(numbers) - 1),
                F.slice(numbers, F.lit(2), F.size(numbers) - 1),
                lambda x, y: (x - mean) * (y - mean),
            )
        )
        return F.when(spread > 0, (shared / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(FAR))

    return _let(_sum(numbers) / n, deviate)


def battery(token: Column) -> Column:
    """(encoding, n, chi, runs, serial) of a token of two letters or more.

    The three statistics are near standard normal for draws from the alphabet.
    """

    def with_letters(bare: Column) -> Column:
        encoding = encoding_of(bare)
        same = F.when(encoding == "hex", F.lower(bare)).otherwise(bare)
        alphabet = _alphabet_of(encoding)
        return _let(
            F.struct(
                encoding.alias("encoding"),
                F.split(same, "").alias("letters"),
                F.transform(F.split(same, ""), lambda c: F.instr(alphabet, c).cast("double") - 1).alias("numbers"),
                F.length(same).cast("double").alias("n"),
                F.length(alphabet).cast("double").alias("a"),
            ),
            lambda s: F.struct(
                s["encoding"].alias("encoding"),
                s["n"].alias("n"),
                _uniformity(s["letters"], s["n"], s["a"]).alias("chi"),
                _runs(s["numbers"], s["n"], s["a"]).alias("runs"),
                _serial(s["numbers"], s["n"]).alias("serial"),
            ),
        )

    return _let(F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", ""), with_letters)


def passes(b: Column) -> Column:
    """Does no test, and no sum of the three, reject draws at random?"""
    high = F.greatest(b["chi"], F.lit(0.0))
    one = (high < SINGLE) & (F.abs(b["runs"]) < SINGLE) & (F.abs(b["serial"]) < SINGLE)
    return one & (high * high + b["runs"] * b["runs"] + b["serial"] * b["serial"] < TOTAL)


def is_decoy(token: Column) -> Column:
    """An ordinary word: no digit, and letters of one case but for the first."""
    return token.rlike("^([A-Z]?[a-z]+|[A-Z]+)$")


def length_class(n: Column) -> Column:
    return F.least(F.floor(n / LENGTH_CLASS), F.lit(LONGEST_CLASS)).cast("int")


def step_of(b: Column) -> Column:
    """The sum of squares of a token that passes, in steps; ``LAST_STEP`` for all others."""
    high = F.greatest(b["chi"], F.lit(0.0))
    total = high * high + b["runs"] * b["runs"] + b["serial"] * b["serial"]
    return F.when(passes(b), F.floor(total * STEPS)).otherwise(F.lit(LAST_STEP)).cast("int")


def cut_steps(tested: DataFrame, rate: float) -> dict[int, int]:
    """For each class of length, the last step whose tokens are believed; classes without one are missing.

    ``tested`` has mark, class, step and decoy, one row per occurrence of a token; each mark counts
    once. The p-value of a step is the smoothed share of decoys up to it, over this class and
    all shorter ones: longer words look less random, so that overstates it. With m tokens that are no decoys in a
    class, r of them up to a step, the step is believed if p * m / r is at most ``rate``; so are all before the last
    such. A class with fewer than 1 / ``rate`` decoys believes none. There are ``LONGEST_CLASS`` + 1
    classes of ``LAST_STEP`` + 1 steps at most.
    """
    tokens = tested.groupBy("mark").agg(F.first("class").alias("class"), F.first("step").alias("step"), F.first("decoy").alias("decoy"))
    counts = tokens.groupBy("class", "step").agg(
        F.count_if(F.col("decoy")).alias("words"), F.count_if(~F.col("decoy")).alias("others")
    )
    by_class: dict[int, dict[int, tuple[int, int]]] = {}
    for row in counts.collect():
        by_class.setdefault(row["class"], {})[row["step"]] = (row["words"], row["others"])
    words = [0] * (LAST_STEP + 1)
    cuts = {}
    for name in sorted(by_class):
        for step, (n, _) in by_class[name].items():
            words[step] += n
        decoys, others = sum(words), sum(n for _, n in by_class[name].values())
        lucky = found = 0
        for step in range(LAST_STEP):
            lucky, found = lucky + words[step], found + by_class[name].get(step, (0, 0))[1]
            if found and (lucky + 1) / (decoys + 1) * others <= rate * found:
                cuts[name] = step
    return cuts


def _proposals(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with base spans, and the long tokens elsewhere with their test results."""
    t = F.col(text)
    # The guards look at a place's first letter, or at what is before it, before anything else is tried there.
    df = with_matches(docs, text, ASSIGN, t.rlike(r"(?i)(?=[psta])(passw|secret|token|api_?key)"), "b_assign")
    df = with_matches(df, text, ACCESS, t.contains("AKIA"), "b_access")
    df = with_matches(df, text, HEX, t.rlike(HEX), "b_hex")
    df = with_matches(df, text, TOKEN, t.rlike(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"), "tokens")
    long_enough = F.filter("b_assign", lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 2)) >= 6)
    df = df.withColumn("_base", F.concat(*[as_spans(k, c) for k, c in zip(KINDS, (long_enough, F.col("b_access"), F.col("b_hex")), strict=True)]))
    fresh = F.filter("tokens", lambda m: ~F.exists("_base", lambda b: overlaps(b, m)))
    df = df.withColumn("tokens", fresh).drop("b_assign", "b_access", "b_hex")

    def test(m: Column) -> Column:
        return _let(
            battery(m["text"]),
            lambda b: F.struct(
                m["start"].alias("start"), m["end"].alias("end"), F.xxhash64(m["text"]).alias("mark"),
                length_class(b["n"]).alias("class"), step_of(b).alias("step"), is_decoy(m["text"]).alias("decoy"),
            ),
        )

    some = F.when(F.size("tokens") > 0, F.transform("tokens", test))
    return df.withColumn("tokens", some)


def _in_order(spans: Column) -> Column:
    """By start, then kind as listed; found tokens come last."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in (*KINDS, EXTRA)]), s["kind"]).cast("int")
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    return F.transform(
        F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    ).cast(SPAN)


def find_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = FALSE_DISCOVERIES, with_text: bool = True
) -> DataFrame:
    """(key, text, base, spans): arrays of (kind, start, end) over the whole text of every row.

    ``base`` is by start, then kind; ``spans`` holds it and the tokens that the battery finds, of
    kind "random", in the same order. A token that overlaps a base span adds nothing. A null text
    counts as empty and has no spans; repeated rows get equal results. What is believed comes from
    the different tokens of the whole table; without tokens nothing is added. ``with_text=False`` leaves the
    text out of the result, and out of what is stored between the search and the decision.
    """
    narrow = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    texts = ["_text"] if with_text else []
    proposed = stored(_proposals(narrow, "_text").select("_key", *texts, "_base", "tokens"), "secrets")
    tested = proposed.filter(F.col("tokens").isNotNull()).select(F.explode("tokens").alias("t")).select("t.mark", "t.class", "t.step", "t.decoy")
    cuts = cut_steps(tested, rate)
    last = F.array(*[F.lit(cuts.get(c, -1)) for c in range(LONGEST_CLASS + 1)])
    good = F.filter("tokens", lambda m: ~m["decoy"] & (m["step"] <= F.get(last, m["class"])))
    extra = F.coalesce(as_spans(EXTRA, good), F.array().cast(SPAN))
    return proposed.select(
        F.col("_key").alias(key),
        *[F.col(c).alias(text) for c in texts],
        _in_order(F.col("_base")).alias("base"),
        _in_order(F.concat(F.col("_base").cast(SPAN), extra)).alias("spans"),
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"), with_text=False)
    digests = digest(F.col("base")).alias("base_sha256"), spans_text(F.col("spans")).alias("spans")
    return found.select("doc_id", *map(_count, KINDS), *digests)
