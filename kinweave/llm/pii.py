"""Personal data by weak supervision, in DataFrame functions only.

1. Fixed patterns give the base spans; they always stay.
2. Looser patterns give further candidates.  Labelers of three sorts vote on each for, against or not at all: patterns
   (shape of the match), gazetteers (lists of known values) and context (words and characters around it).
3. Candidates are counted by kind and votes: a table with at most kinds * 3^labelers rows.  Expectation-maximisation
   on it estimates how often each labeler is right and how likely each combination of votes is.
4. Those posteriors, as soft labels, train a naive Bayes classifier on features of the span; it decides which
   candidates become spans.  Its table has one row per kind and feature value, of which there are a fixed number.

Patterns are written so that Java's matcher neither recurses nor looks at a character again and again: repeated groups
are possessive, and a match starts at the head of a run of its characters or where the last match ended.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.sources.staging import materialize

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms; a candidate that touches a base span is dropped.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\.)\x20?[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9.+-])(?:[0-9]{4}[\x20-]){3}[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: What a text must hold for a loose form of the kind to be looked for.
HINT = {"email": r"[\[({]at[\])}]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[\x20-][0-9]{4}[\x20-]", "phone": r"[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}"}

#: Last parts of addresses, first digits of card issuers, area codes not in use, words around.
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$",
    "ip": r"(?i)^(?:2[0-9a-f]{3}|fe80|fd[0-9a-f]{2}):",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\(?[2-9][0-9]{2}",
}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address)\b",
    "ip": r"(?i)\b(?:ip|ipv6|host|server|address|from|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|iban)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|dial)\b",
}
AGAINST = r"(?i)(?:\b(?:order|invoice|isbn|issn|version|serial|ticket|page|id|no|nr|ref)\b\.?|#)[\x20:]*$"
AROUND = 32
LABELERS = ("shape", "gazetteer", "context", "against", "edges")


def _length(c: Column) -> Column:
    return F.length(c).cast("bigint")


#: Fixed type of a located match.
SPAN = "array<struct<kind:string,start:bigint,end:bigint,match:string>>"
#: Elements of one block where positions of long arrays are formed in two steps.
BLOCK = 64


def bound(value: Column, body) -> Column:
    """``body`` of a value that is formed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(values: Column) -> Column:
    """An array cut into arrays of ``BLOCK`` elements; ``values`` must be a bound value."""
    count = F.ceil(F.size(values) / BLOCK).cast("int")
    numbers = F.filter(F.sequence(F.lit(0), count), lambda b: b < count)
    return F.transform(numbers, lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def running(values: Column, merge) -> Column:
    """For each element of an array of bigint, the fold of all earlier ones with ``merge``, starting at 0.

    Blocks are folded first, then the blocks before each block, then the elements before each element of its block, so
    nothing grows element by element: n elements take about n * 32 + n * n / 8192 steps.
    """
    zero = F.lit(0).cast("bigint")

    def earlier(xs: Column, start: Column) -> Column:
        return F.transform(xs, lambda _, i: F.aggregate(F.slice(xs, F.lit(1), i), start, merge))

    def all_of(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, zero, merge))
        starts = bound(sums, lambda known: earlier(known, zero))
        return F.flatten(F.zip_with(blocks, starts, earlier))

    return bound(values, lambda xs: bound(_blocks(xs), all_of))


def located(text: Column, pattern: str, kind: str) -> Column:
    """Matches in order: array of (kind, start, end, match), in code points, end exclusive.

    The pieces between the matches and the matches themselves give the positions as running lengths.
    """
    def placed(found: Column) -> Column:
        sizes = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, gap: F.struct(
            m.alias("match"), _length(m).alias("size"), (_length(gap) + _length(m)).alias("step")))

        def spans(each: Column) -> Column:
            before = running(F.transform(each, lambda x: x["step"]), lambda total, step: total + step)
            return F.zip_with(each, before, lambda x, at: F.struct(
                F.lit(kind).alias("kind"), (at + x["step"] - x["size"]).alias("start"), (at + x["step"]).alias("end"), x["match"].alias("match")))

        return bound(sizes, spans)

    return F.when(text.rlike(pattern), bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(F.array().cast(SPAN))


def clear_of(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of ``taken``; they must not overlap one another, and come in order.

    A span is hit if, of those taken that start before its end, one ends after its start.  So both are sorted into one
    list, the taken by start and the spans by end, and the furthest end so far is carried along it.
    """
    def event(s: Column, at: str, side: int) -> Column:
        return F.struct(s[at].alias("at"), F.lit(side).alias("side"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match"))

    def kept(ordered: Column) -> Column:
        reach = running(F.transform(ordered, lambda e: F.when(e["side"] == 1, e["end"]).otherwise(F.lit(0).cast("bigint"))), lambda most, end: F.greatest(most, end))
        free = F.zip_with(ordered, reach, lambda e, most: F.struct(((e["side"] == 0) & (most <= e["start"])).alias("free"), e.alias("e")))
        return F.transform(F.filter(free, lambda x: x["free"]), lambda x: F.struct(*[x["e"][n].alias(n) for n in ("kind", "start", "end", "match")]))

    events = F.array_sort(F.concat(F.transform(spans, lambda s: event(s, "end", 0)), F.transform(taken, lambda s: event(s, "start", 1))))
    return bound(events, kept)


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn check."""
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + (
        lambda d: F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))(F.coalesce(F.substring(digits, i, 1).try_cast("int"), F.lit(0))))
    return (n > 0) & (total % 10 == 0)


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (lambda d: (F.length(d) < 4) & (F.coalesce(d.try_cast("int"), F.lit(0)) <= 255))(F.regexp_replace(p, "^0+", "")))
    if kind == "card":
        return F.length(digits_of(match)).between(16, 19) & luhn(digits_of(match))
    if kind == "phone":
        return F.length(digits_of(match)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans by kind as listed, then start; matches that fail their check are left out and not tried again."""
    hint = {"email": text.contains("@"), "phone": text.contains("+")}
    none = F.array().cast(SPAN)

    def of(kind: str) -> Column:
        found = located(text, BASE[kind], kind)
        return F.filter(F.when(hint[kind], found).otherwise(none) if kind in hint else found, lambda s: valid(kind, s["match"]))

    return F.concat(*[of(k) for k in KINDS])


def candidates(text: Column, base: Column) -> Column:
    """Loose matches clear of the base spans, with what stands before and after them."""
    def around(found: Column) -> Column:
        # the surroundings of a block of spans are cut out of the text once
        first = F.greatest(F.element_at(found, 1)["start"] - AROUND, F.lit(0))
        near = F.substring(text, (first + 1).cast("int"), (F.element_at(found, -1)["end"] + AROUND - first).cast("int"))
        return bound(F.struct(first.alias("first"), near.alias("near")), lambda cut: F.transform(found, lambda c: F.struct(
            c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["match"].alias("match"),
            F.substring(cut["near"], (F.greatest(c["start"] - AROUND, F.lit(0)) - cut["first"] + 1).cast("int"), F.least(F.lit(AROUND), c["start"]).cast("int")).alias("before"),
            F.substring(cut["near"], (c["end"] - cut["first"] + 1).cast("int"), F.lit(AROUND)).alias("after"))))

    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,match:string,before:string,after:string>>")
    return F.concat(*[F.when(text.rlike(HINT[k]), F.flatten(bound(clear_of(located(text, LOOSE[k], k), base), lambda clear: F.transform(
        _blocks(clear), around)))).otherwise(none) for k in KINDS])


def _by_kind(kind: Column, patterns: dict[str, str], value: Column) -> Column:
    out = F.lit(False)
    for k in KINDS:
        out = F.when(kind == k, value.rlike(patterns[k])).otherwise(out)
    return out


def votes(c: Column) -> Column:
    """One vote per labeler: 1 for, -1 against, 0 none."""
    digits = digits_of(c["match"])
    shape = F.when(c["kind"] == "card", F.when(luhn(digits), 1).otherwise(-1)).when(c["kind"] == "phone", F.when(c["match"].rlike(r"^\([0-9]{3}\)"), 1).otherwise(0)).otherwise(F.lit(1))
    return F.array(
        shape,
        F.when(_by_kind(c["kind"], GAZETTEER, c["match"]), 1).otherwise(-1),
        F.when(_by_kind(c["kind"], CONTEXT, F.concat_ws(" ", c["before"], c["after"])), 1).otherwise(0),
        F.when(c["before"].rlike(AGAINST), -1).otherwise(0),
        F.when(c["before"].rlike(r"[\p{L}\p{N}_/=-]$") | c["after"].rlike(r"^[\p{L}\p{N}_/=-]"), -1).otherwise(1)).cast("array<int>")


def features(c: Column) -> Column:
    """Feature values of a span; each feature has a fixed number of values."""
    digits = digits_of(c["match"])
    return F.array(
        F.concat(F.lit("votes:"), F.array_join(votes(c).cast("array<string>"), ",")),
        F.concat(F.lit("length:"), F.least(F.floor(F.length(c["match"]) / 4), F.lit(12)).cast("string")),
        F.concat(F.lit("digits:"), F.least(F.length(digits), F.lit(32)).cast("string")),
        F.concat(F.lit("repeat:"), F.when(digits.rlike(r"^(.)\1*$"), "1").otherwise("0")),
        F.concat(F.lit("left:"), F.when(c["before"] == "", "edge").when(c["before"].rlike(r"\s$"), "space").when(c["before"].rlike(r"[\p{L}\p{N}]$"), "word").otherwise("mark")),
        F.concat(F.lit("right:"), F.when(c["after"] == "", "edge").when(c["after"].rlike(r"^\s"), "space").when(c["after"].rlike(r"^[\p{L}\p{N}]"), "word").otherwise("mark")))


@dataclass(frozen=True)
class Model:
    """Log odds by kind, and by kind and feature value; both of fixed size."""

    prior: dict[str, float]
    weight: dict[str, float]


def estimate(counted: DataFrame, rounds: int = 12, smooth: float = 1.0) -> DataFrame:
    """Posterior of every (kind, votes): expectation-maximisation with one rate per kind, labeler, vote and class.

    ``counted`` has (kind, votes, n).  Each round is an aggregate of that small table; what goes on from round to round
    is its parameters, kinds * labelers * 3 * 2 numbers.  The start is the majority of the votes, towards which the
    rates are smoothed, so that the two classes cannot change places.
    """
    majority = F.aggregate("votes", F.lit(0), lambda a, v: a + v)
    start = counted.withColumn("p", F.lit(1.0) / (1.0 + F.exp(-1.5 * majority.cast("double"))))
    current = start
    for _ in range(rounds):
        long = current.select("kind", "n", "p", F.posexplode("votes").alias("who", "vote"))
        rates = long.groupBy("kind", "who", "vote").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()
        totals = {r.kind: (r.yes, r.no) for r in current.groupBy("kind").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()}
        seen = {(r.kind, r.who, r.vote): (r.yes, r.no) for r in rates}
        odds = F.lit(0.0)
        for kind, (yes, no) in totals.items():
            terms = F.lit(math.log((yes + smooth) / (no + smooth)))
            for who in range(len(LABELERS)):
                vote = F.get("votes", F.lit(who))
                chosen = F.lit(0.0)
                for value in (-1, 0, 1):
                    y, m = seen.get((kind, who, value), (0.0, 0.0))
                    tilt = {-1: (0.5, 1.5), 0: (1.0, 1.0), 1: (1.5, 0.5)}[value]
                    chosen = F.when(vote == value, F.lit(math.log((y + smooth * tilt[0]) / (yes + 3 * smooth)) - math.log((m + smooth * tilt[1]) / (no + 3 * smooth)))).otherwise(chosen)
                terms = terms + chosen
            odds = F.when(F.col("kind") == kind, terms).otherwise(odds)
        current = counted.withColumn("p", F.lit(1.0) / (1.0 + F.exp(-odds)))
    return current


def fit(found: DataFrame, smooth: float = 0.5) -> Model:
    """Estimate labelers and train the span classifier on all candidates of ``found`` (column ``candidates``)."""
    each = found.select(F.explode("candidates").alias("c")).select(F.col("c.kind").alias("kind"), votes(F.col("c")).alias("votes"), features(F.col("c")).alias("features"))
    counted = materialize(each.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")), "candidates")
    patterns = counted.groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    soft = materialize(estimate(materialize(patterns, "votes")), "posteriors")
    weighted = counted.join(soft.select("kind", "votes", "p"), ["kind", "votes"])
    counts = weighted.select("kind", "n", "p", F.explode("features").alias("feature")).groupBy("kind", "feature").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()
    totals = {r.kind: (r.yes, r.no) for r in weighted.groupBy("kind").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()}
    prior = {k: math.log((y + smooth) / (n + smooth)) for k, (y, n) in totals.items()}
    weight = {f"{r.kind}|{r.feature}": math.log((r.yes + smooth) / (totals[r.kind][0] + 2 * smooth)) - math.log((r.no + smooth) / (totals[r.kind][1] + 2 * smooth)) for r in counts}
    return Model(prior, weight)


def accepted(cands: Column, model: Model, threshold: float) -> Column:
    """Candidates that the classifier takes."""
    if not model.prior:
        return F.array().cast(SPAN)
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv])
    odds = lambda c: F.coalesce(F.element_at(pairs(model.prior), c["kind"]), F.lit(-99.0)) + F.aggregate(
        features(c), F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(pairs(model.weight), F.concat(c["kind"], F.lit("|"), f)), F.lit(0.0)))
    return F.transform(F.filter(cands, lambda c: odds(c) >= math.log(threshold / (1 - threshold))),
                       lambda c: F.struct(*[c[n].alias(n) for n in ("kind", "start", "end", "match")]))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``base`` and ``candidates`` to each row; null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("base", base_spans(text)).withColumn("candidates", F.when(text.rlike(r"[0-9A-Fa-f]"), candidates(text, F.col("base"))).otherwise(F.array().cast(
        "array<struct<kind:string,start:bigint,end:bigint,match:string,before:string,after:string>>")))


def with_spans(scanned: DataFrame, model: Model, threshold: float = 0.9) -> DataFrame:
    """Replace ``base`` and ``candidates`` by ``base_spans`` and ``spans``, each by kind as listed, then start.

    Of two candidates that overlap, the one found first in the order of kinds and starts stays.  Those of one kind do
    not overlap, so a kind is taken at once: what is clear of the kinds before it.
    """
    of = lambda kind: F.filter("candidates", lambda c: c["kind"] == kind)
    held = scanned.withColumn("candidates", accepted(F.col("candidates"), model, threshold)).withColumn("spans", of(KINDS[0]))
    for kind in KINDS[1:]:
        held = held.withColumn("spans", F.concat("spans", clear_of(of(kind), F.col("spans"))))
    slim = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rank = lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    held = held.withColumn("base_spans", slim(F.col("base")))
    return held.withColumn("spans", slim(F.array_sort(F.transform(F.concat("base_spans", slim(F.col("spans"))), rank)))).drop("base", "candidates")


def find(docs: DataFrame, text_col: str = "text", threshold: float = 0.9, keep: list[str] | None = None) -> DataFrame:
    """Personal data of whole texts: the kept columns, ``base_spans`` and ``spans`` (arrays of kind, start, end).

    Texts are read once; spans and candidates, a few short rows, are written to the shared folder, the texts are not.
    Null and empty texts have no spans; repeated rows get the same spans; an empty table gives an empty one.  Columns
    called base, candidates, base_spans or spans are replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "candidates", "base_spans", "spans")]
    scanned = materialize(scan(docs.select(*names, F.col(text_col).alias("_text")), "_text").drop("_text"), "spans")
    return with_spans(scanned, fit(scanned), threshold)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """Replace personal data in the text by ``<KIND>``; where spans overlap, the one that starts first names the whole.

    Only the candidates are written in between; the texts are scanned a second time instead.  Null texts stay null.
    All columns are kept, whatever their names.
    """
    given = docs.columns
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    named, text_col = text_col, "_text"
    model = fit(materialize(scan(docs.select(F.col(text_col).alias("_text")), "_text").select("candidates").where("size(candidates) > 0"), "candidates"))
    hidden = with_spans(scan(docs, text_col), model, threshold)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(s["kind"]).alias("kind"))))
    text = F.col(text_col)

    def pieces(block: Column) -> Column:
        first = F.element_at(block, 1)["from"]
        part = F.substring(text, (first + 1).cast("int"), (F.element_at(block, -1)["start"] - first).cast("int"))
        return bound(F.struct(first.alias("first"), part.alias("part")), lambda cut: F.array_join(F.transform(block, lambda s: F.concat(
            F.substring(cut["part"], (s["from"] - cut["first"] + 1).cast("int"), (s["start"] - s["from"]).cast("int")), F.lit("<"), s["kind"], F.lit(">"))), ""))

    def replaced(spans: Column) -> Column:
        # what ends furthest so far is where the text goes on; a span that starts before that point is part of the one before
        ends = running(F.transform(spans, lambda s: s["end"]), lambda most, end: F.greatest(most, end))
        heads = F.filter(F.zip_with(spans, ends, lambda s, most: F.struct(most.alias("from"), s["start"].alias("start"), s["kind"].alias("kind"))), lambda s: s["start"] >= s["from"])
        rest = F.substring(text, (F.array_max(F.transform(spans, lambda s: s["end"])) + 1).cast("int"), 2**31 - 1)
        return F.concat(bound(heads, lambda known: F.array_join(F.transform(_blocks(known), pieces), "")), rest)

    done = bound(ordered, replaced)
    written = hidden.select("_row", F.when(F.size("spans") > 0, done).otherwise(text).alias("_text"))
    return written.select(*[F.col("_text").alias(c) if c == named else F.col(f"_row.`{c}`").alias(c) for c in given])
