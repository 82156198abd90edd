"""Personal data: generators propose spans, boosted trees select among them.

Base spans are those of four fixed rules. Further generators propose whatever has the shape of
such data, with or without a base span at the same place: a card among other numbers, a telephone
number that runs into the next number, an address spelled with "at". Trees learn from the proposals that pass or fail
their checks (check sum, parts, number of digits) which format and context such data have. The checks
give the labels only and are no features, so the trees are an opinion of their own: a further proposal that passes its
check is added where its calibrated chance, from format and context, is high too. All of it runs in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import read, spans_text
from tidewire.llm.spans import MATCH, SPAN, as_spans, digest, fit_selector, overlaps, with_matches

KINDS = ("email", "ip", "card", "phone")
FIT_DOCUMENTS = 40_000     # documents whose proposals the trees are fitted on
CERTAINTY = 0.95

# The base rules. Two of them are matched in a text in which single characters that
# can't belong to a match are overwritten, so that runs of one character class are enough and no
# text, however long, needs a deep stack. Lengths stay, so positions do.
LOOSE_DOT = r"\.(?![A-Za-z0-9-])"
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
LOOSE_GAP = r"(?<=[ -])[ -]|[ -](?=[ -])"
CARD = r"[0-9][0-9 -]*[0-9]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The further generators, by kind.
MORE = {
    "email": r"[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:\.| ?[\[(]dot[\])] ?)[A-Za-z]{2,}",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])",
}
SPELLED_AT, SPELLED_DOT = r" ?[\[(]at[\])] ?", r" ?[\[(]dot[\])] ?"
WORDS_BEFORE = r"(?i)(e-?mail|mail|contact|tel|phone|call|mobil|card|karte|tarjeta|carte|visa|ip|host|addr)\W*$"
DIGITS_ONLY = r"[^0-9]"


def luhn_ok(digits: Column) -> Column:
    """Does a string of digits pass the check sum? Every second digit from the right is doubled."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    weighed = F.transform(
        values,
        lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2),
    )
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, DIGITS_ONLY, "")


def _parts_ok(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.left(p, F.lit(3)).cast("int") <= 255))


def _card_ok(text: Column) -> Column:
    digits = _digits(text)
    return F.length(digits).between(16, 19) & luhn_ok(digits)


CHECKS = {
    "email": lambda t: F.lit(True),
    "ip": _parts_ok,
    "card": _card_ok,
    "phone": lambda t: F.length(_digits(t)).between(8, 15),
}


VALID = CHECKS | {"card": lambda t: luhn_ok(_digits(t))}    # of further proposals; their pattern bounds the digits


def _features(kind: str, m: Column) -> Column:
    """Format and context of one whole proposal, without anything its check looks at.

    An address that is spelled out has the format of the address it spells.
    """
    text = m["text"]
    if kind == "email":
        text = F.regexp_replace(F.regexp_replace(text, SPELLED_AT, "@"), SPELLED_DOT, ".")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    last = F.right(m["before"], F.lit(1))
    first = F.left(m["after"], F.lit(1))
    return F.array(
        F.lit(float(KINDS.index(kind))),
        F.length(text).cast("double"),
        F.length(F.regexp_replace(text, "[A-Za-z0-9]", "")).cast("double"),
        F.size(F.array_distinct(F.split(text, ""))).cast("double"),
        flag(last.rlike("[A-Za-z0-9]")),
        flag(first.rlike("[A-Za-z0-9]")),
        flag(last.rlike("[.+-]")),
        flag(m["before"].rlike(WORDS_BEFORE)),
        flag(text.startswith("+")),
        flag(text.contains("(")),
    )


def _proposals(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with base and further matches of each kind, as columns b_<kind> and m_<kind>."""
    t = F.col(text)
    mail, gaps = "_mail_text", "_gap_text"
    guards = {
        "email": t.contains("@"),
        "ip": t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
        "card": t.rlike(r"[0-9][0-9 -]{14,}[0-9]"),
        "phone": t.rlike(r"\+[0-9]"),
    }
    df = docs.withColumn(mail, F.when(guards["email"], F.regexp_replace(t, LOOSE_DOT, "%")))
    df = df.withColumn(gaps, F.when(guards["card"], F.regexp_replace(t, LOOSE_GAP, "x")))
    base = {"email": (mail, EMAIL), "ip": (text, IP), "card": (gaps, CARD), "phone": (text, PHONE)}
    more_guard = guards | {"email": t.rlike(r"[\[(]at[\])]"), "card": t.rlike(r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}")}
    for kind in KINDS:
        source, pattern = base[kind]
        df = with_matches(df, source, pattern, guards[kind], f"b_{kind}")
        df = with_matches(df, text, MORE[kind], more_guard[kind], f"m_{kind}")
    return df.drop(mail, gaps)


def _training_rows(proposed: DataFrame, key: str) -> DataFrame:
    """(label, features, part): base proposals by whether they pass, further ones that fail.

    The part comes from key, kind and place, and repeated rows count once.
    """

    def labelled(kind: str, matches: Column, label: Column | None = None) -> Column:
        return F.transform(
            matches,
            lambda m: F.struct(
                F.lit(kind).alias("kind"), m["start"].alias("start"),
                (CHECKS[kind](m["text"]) if label is None else label).cast("int").alias("label"),
                _features(kind, m).alias("features"),
            ),
        )

    every = [labelled(k, F.col(f"b_{k}")) for k in KINDS]
    every += [labelled(k, _filtered(f"m_{k}", k, VALID, passing=False), F.lit(0)) for k in KINDS]
    rows = proposed.select(F.col(key).alias("key"), F.explode(F.concat(*every)).alias("x")).select("key", "x.*").distinct()
    part = F.pmod(F.xxhash64(F.col("key").cast("string"), "kind", "start"), F.lit(10)).cast("int")
    return rows.select("label", "features", part.alias("part"))


def _filtered(matches: str, kind: str, checks: dict = CHECKS, passing: bool = True) -> Column:
    return F.filter(matches, lambda m: checks[kind](m["text"]) if passing else ~checks[kind](m["text"]))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def find_personal_data(
    docs: DataFrame, key: str = "doc_id", text: str = "text", fit_documents: int = FIT_DOCUMENTS,
    certainty: float = CERTAINTY,
) -> DataFrame:
    """(key, text, base, spans): arrays of (kind, start, end) over the whole text of every row.

    ``base`` is by kind, then start; ``spans`` holds it and what the trees add, in the same order.
    Added spans overlap no base span and, within a kind, no longer added span. A null text counts
    as empty and has no spans. Rows are independent, so repeated ones get equal results. The trees
    are fitted on at most about ``fit_documents`` rows, chosen by the hash of key and text; where those
    hold proposals that all pass or all fail, nothing is added.
    """
    narrow = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    share = min(1.0, fit_documents / max(1, narrow.count()))
    chosen = narrow.filter(F.pmod(F.xxhash64(F.col("_key").cast("string"), "_text"), F.lit(1_000_000)) < int(share * 1_000_000))
    select = fit_selector(_training_rows(_proposals(chosen, "_text"), "_key"), certainty)

    proposed = _proposals(narrow, "_text")
    for kind in KINDS:
        proposed = proposed.withColumn(f"b_{kind}", _filtered(f"b_{kind}", kind))
    proposed = proposed.withColumn("_base", F.concat(*[as_spans(k, F.col(f"b_{k}")) for k in KINDS]))

    def chosen_of(kind: str, name: str) -> Column:
        return F.filter(name, lambda m: VALID[kind](m["text"]) & select(_features(kind, m)))

    added = []
    for kind in KINDS:
        name = f"m_{kind}"
        fresh = F.filter(name, lambda m: ~F.exists("_base", lambda b: overlaps(b, m)))
        proposed = proposed.withColumn(name, fresh)
        proposed = proposed.withColumn(name, F.when(F.size(name) > 0, chosen_of(kind, name)).otherwise(F.array().cast(MATCH)))
        both = F.concat(as_spans(kind, F.col(f"b_{kind}")), as_spans(kind, F.col(name)))
        added.append(F.array_sort(both))    # one kind, so by start
    return proposed.select(
        F.col("_key").alias(key),
        F.col("_text").alias(text),
        F.col("_base").cast(SPAN).alias("base"),
        F.concat(*added).cast(SPAN).alias("spans"),
    )


def redact(found: DataFrame, text: str = "text") -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans merge."""
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    whole = F.col(text)

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(whole, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        mark = F.when(s["start"] >= state["at"], F.concat(gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.concat(state["out"], mark).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    done = F.aggregate(ordered, start, step)
    return F.concat(done["out"], F.substring(whole, done["at"] + 1, F.length(whole)))


def op1_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(read(spark, sf_dir, "documents"))
    digests = digest(F.col("base")).alias("base_sha256"), spans_text(F.col("spans")).alias("spans")
    return found.select("doc_id", *map(_count, KINDS), *digests)
