"""Personal data in texts: base patterns, and spans that boosted trees pick from what wider patterns propose."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import let, stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_WIDE = r"\x00-\x20@<>()\[\],;:\"'!?"
#: The base pattern of each kind. They match what the contract's plainer ones match; look-behind and possessive repeats keep
#: them linear and off the stack. An e-mail may begin within a run of its characters only where the last one ended.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns: each proposes spans of its kind, which may overlap others.
WIDER = {
    "email": [
        rf"(?:\G|(?<![^{_WIDE}]))[^{_WIDE}]++@[^{_WIDE}.]++(?:\.[^{_WIDE}.]++)++",
        rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]++ ?[(\[{{] ?at ?[)\]}}] ?[{_LABEL}]++(?: ?(?:\.|[(\[{{] ?dot ?[)\]}}]) ?[{_LABEL}]++)++",
    ],
    "ip": [r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])"],
    "card": [r"(?<![0-9])[0-9]{4}(?:[\x20./_ -]?[0-9]{4}){2}[\x20./_ -]?[0-9]{1,7}(?![0-9])", r"(?<![0-9])[0-9]{4}[\x20./_ -][0-9]{6}[\x20./_ -][0-9]{5}(?![0-9])"],
    "phone": [rf"\+[0-9]{{1,3}}(?:[\x20.-]?\([0-9]{{1,4}}\))?(?:[\x20.-]?[0-9]{{2,4}}){{{n}}}(?![0-9])" for n in (2, 3, 4)]
    + [r"(?<![0-9+(.-])(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"],
}
#: Patterns by number: the base ones in the order of KINDS, then the wider ones.
PATTERNS = [*((k, BASE[k]) for k in KINDS), *((k, p) for k in KINDS for p in WIDER[k])]
#: Words that go before personal data.
_CUES = r"(?i)(mail|contact|tel|phone|call|fax|mobile|card|visa|pay|account|host|server|addr|\bip\b)[^0-9]{0,16}$"
FEATURES = ("kind_no", "n_digits", "n_letters", "n_other", "n_groups", "first_group", "last_group", "longest_group", "has_plus", "has_bracket", "before_class", "after_class", "has_cue")
_SCALE = 1 << 20


def _matches(text: Column, pattern: str, number: int) -> Callable[[Column], Column]:
    """Given what stands between the matches of a pattern, the matches as _found() has them."""

    def all_(gaps: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            gap = F.get(gaps, i)
            return F.struct(F.lit(number).alias("pattern"), i.alias("i"), gap["skipped"].alias("skipped"), F.length(v).alias("length"), v.alias("value"), gap["before"].alias("before"), F.get(gaps, i + 1)["start"].alias("after"))

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one)

    return all_


def _found(text: Column) -> Column:
    """All matches of all patterns: (pattern, i, skipped, length, value, before, after), where skipped is the number of
    characters between the last match of the pattern and this one. Most texts lack what a pattern needs, so few are searched."""
    has_digit, has_at, has_plus = text.rlike("[0-9]"), text.contains("@"), text.contains("+")
    # A text is searched for a spelt-out address only if it has a bracketed "at".
    spelt = text.rlike(r"(?i)[(\[{] ?at ?[)\]}]")
    parts = []
    for number, (kind, pattern) in enumerate(PATTERNS):
        needed = spelt if pattern.startswith("(?i)") else {"email": has_at, "ip": has_digit & text.contains("."), "card": has_digit, "phone": has_plus if pattern.startswith(r"\+") else has_digit}[kind]
        gaps = F.transform(F.split(text, pattern), lambda g: F.struct(F.length(g).alias("skipped"), F.right(g, F.lit(24)).alias("before"), F.substring(g, 1, 1).alias("start")))

        parts.append(F.when(needed, let(gaps, _matches(text, pattern, number))))
    none = F.array().cast("array<struct<pattern:int,i:int,skipped:int,length:int,value:string,before:string,after:string>>")
    return F.concat(*[F.coalesce(p, none) for p in parts])


def _luhn(digits: Column) -> Column:
    """Whether a run of 19 digits at most passes Luhn's check; zeros before it change nothing."""
    padded = F.lpad(digits, 19, "0")
    each = [(F.ascii(F.substring(padded, 19 - r, 1)) - 48) * (2 if r % 2 else 1) for r in range(19)]
    return reduce(add, [x - F.when(x > 9, 9).otherwise(0) for x in each]) % 10 == 0


def _valid(wide: bool) -> Column:
    """The check of a kind's match: base matches as the contract has it; wider ones may have other separators, and their
    addresses must end in letters."""
    value, kind = F.col("value"), F.col("kind")
    digits, n = F.col("digits"), F.length("digits")
    octet = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    dot = r"[^0-9]+" if wide else r"\."
    email = value.rlike(r"(?i)[\p{L}]{2,}$") & (F.length("value") <= 254) if wide else F.lit(True)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", value.rlike(f"^{octet}{dot}{octet}{dot}{octet}{dot}{octet}$"))
        .when(kind == "card", n.between(13, 19) & _luhn(F.substring("digits", 1, 19)))
        .otherwise(n.between(9, 15))
    )


def _side(c: Column) -> Column:
    """Class of the character beside a span."""
    return F.when(c.isNull() | (c == ""), 0).when(c.rlike(r"^\s$"), 1).when(c.rlike(r"^\p{L}$"), 2).when(c.rlike("^[0-9]$"), 3).otherwise(4)


def spans_of(rows: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end, base, wide_valid, other_base, own_base and FEATURES) of rows (row, doc_id, found): all
    spans found in a text, once each; base: it is a valid match of the base pattern; own_base, other_base: it overlaps one
    of its own kind, of another. Windows are as large as what one text holds."""
    one = rows.select("row", "doc_id", F.explode("found").alias("f")).select("row", "doc_id", "f.*")
    each = Window.partitionBy("row", "pattern").orderBy("i")
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in PATTERNS]), F.col("pattern") + 1)
    one = one.withColumn("end", F.sum(F.col("skipped") + F.col("length")).over(each)).withColumn("start", F.col("end") - F.col("length")).withColumn("kind", kind)
    one = one.withColumn("digits", F.regexp_replace("value", "[^0-9]+", ""))
    one = one.withColumn("base", (F.col("pattern") < len(KINDS)) & _valid(False)).withColumn("wide_valid", _valid(True)).where((F.col("pattern") >= len(KINDS)) | F.col("base"))
    # What two patterns of a kind propose alike is one span; where a match of its pattern ended, its neighbour is unknown.
    once = one.groupBy("row", "doc_id", "kind", "start", "end").agg(F.max("base").alias("base"), F.max("wide_valid").alias("wide_valid"), F.max("value").alias("value"), F.max("digits").alias("digits"), F.max("before").alias("before"), F.max("after").alias("after"))
    whole = (Window.unboundedPreceding, Window.currentRow)
    upto = Window.partitionBy("row").orderBy("start").rangeBetween(*whole)
    onward = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(*whole)
    for k in KINDS:
        of = F.col("base") & (F.col("kind") == k)
        ends, starts = F.max(F.when(of, F.col("end"))).over(upto), F.min(F.when(of, F.col("start"))).over(onward)
        once = once.withColumn(f"over_{k}", F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("end"), F.lit(False)))
    own = reduce(lambda a, b: a | b, [(F.col("kind") == k) & F.col(f"over_{k}") for k in KINDS])
    other = reduce(lambda a, b: a | b, [(F.col("kind") != k) & F.col(f"over_{k}") for k in KINDS])
    groups = F.filter(F.split("value", "[^0-9]+"), lambda g: g != "")
    longest = F.aggregate(groups, F.lit(0), lambda t, g: F.greatest(t, F.length(g)))
    letters = F.length(F.regexp_replace("value", r"[^\p{L}]+", ""))
    features = [
        F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1, F.length("digits"), letters, F.length("value") - F.length("digits") - letters, F.size(groups), F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)),
        F.coalesce(F.length(F.get(groups, F.size(groups) - 1)), F.lit(0)), longest, F.col("value").startswith("+").cast("int"), F.col("value").rlike(r"[(\[{]").cast("int"), _side(F.right("before", F.lit(1))), _side(F.col("after")), F.col("before").rlike(_CUES).cast("int"),
    ]
    named = [F.least(f.cast("int"), F.lit(20)).alias(n) for f, n in zip(features, FEATURES)]
    return once.select("row", "doc_id", "kind", "start", "end", "base", "wide_valid", own.alias("own_base"), other.alias("other_base"), *named)


def fit_trees(cases: DataFrame, *, rounds: int = 12, rate: float = 0.5, ridge: float = 1.0) -> Column:
    """The margin, an expression over FEATURES, of boosted trees of depth two fitted to all cases (FEATURES, yes, no), a row
    for each distinct combination with its numbers of either label. Splits take second-order gains from histograms that
    Spark sums up; sums are of whole numbers, so reruns agree. Only histograms reach the driver: 21 levels a feature."""
    margin = F.lit(0.0)
    p = 1 / (1 + F.exp(-F.col("margin")))
    g = F.round(_SCALE * (F.col("yes") * (p - 1) + F.col("no") * p)).cast("long").alias("g")
    h = F.round(_SCALE * (F.col("yes") + F.col("no")) * p * (1 - p)).cast("long").alias("h")
    features = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).alias("level")) for i, f in enumerate(FEATURES)])

    def best(node: Column) -> dict[int, tuple[str, int, float, float] | None]:
        """The split of the largest gain in each node: (feature, level, value up to it, value beyond it)."""
        bins = cases.withColumn("margin", margin).withColumn("node", node).select("node", g, h, F.explode(features).alias("f"))
        bins = bins.groupBy("node", "f.feature", "f.level").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        found: dict[int, tuple[float, tuple[str, int, float, float] | None]] = {}
        for n in sorted({r["node"] for r in bins}):
            found[n] = (1e-6, None)
            for i, name in enumerate(FEATURES):
                own = sorted((r["level"], r["g"] / _SCALE, r["h"] / _SCALE) for r in bins if r["node"] == n and r["feature"] == i)
                all_g, all_h, left_g, left_h = sum(x[1] for x in own), sum(x[2] for x in own), 0.0, 0.0
                for level, a, b in own[:-1]:
                    left_g, left_h = left_g + a, left_h + b
                    right_g, right_h = all_g - left_g, all_h - left_h
                    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
                    if gain > found[n][0] + 1e-9:
                        found[n] = (gain, (name, level, -rate * left_g / (left_h + ridge), -rate * right_g / (right_h + ridge)))
        return {n: s for n, (_, s) in found.items()}

    for _ in range(rounds):
        top = best(F.lit(0)).get(0)
        if top is None:
            break
        left = F.col(top[0]) <= top[1]
        below = best(F.when(left, 0).otherwise(1))
        sides = [F.lit(top[2 + side]) if (s := below.get(side)) is None else F.when(F.col(s[0]) <= s[1], s[2]).otherwise(s[3]) for side in (0, 1)]
        margin = margin + F.when(left, sides[0]).otherwise(sides[1])
    return margin


def thresholds(cases: DataFrame, score: Column, precision: float) -> dict[str, int]:
    """By kind the least score, in thousandths, from which on precision of the cases (FEATURES, yes, no) have label yes, one
    more of the other label added; kinds without such a score have none."""
    own = cases.groupBy("kind_no", score.alias("score")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    down = Window.partitionBy("kind_no").orderBy(F.desc("score"))
    yes, no = F.sum("yes").over(down), F.sum("no").over(down)
    fit = own.withColumn("share", yes / (yes + no + 1)).where(F.col("share") >= precision)
    return {KINDS[r["kind_no"]]: r["score"] for r in fit.groupBy("kind_no").agg(F.min("score").alias("score")).collect()}


def private_spans(docs: DataFrame, *, precision: float = 0.98, rounds: int = 12) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row of docs.

    Base spans are the matches of BASE that pass their check, and always stay. WIDER patterns propose more. A proposal that
    equals a base span teaches as private; one that fails its kind's check, or lies over a base span of another kind only,
    teaches as not; all documents teach but a fifth by crc32 of doc_id, on which each kind's threshold is set so that precision of
    the labelled proposals above it are private. Of the rest, those that pass their check, touch no base span and
    reach the threshold are added; of overlapping ones that of the higher score, then the longer, then the first. A kind
    without enough labelled proposals gets no more than its base spans. A null text has no spans, a null doc_id counts as ''
    in the fold; rows are judged one by one, equal or not. Other columns of docs are ignored."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(rows.select("row", "doc_id", _found(F.col("text")).alias("found")), "private-proposals")
    spans = stored(spans_of(rows.where(F.size("found") > 0)), "private-spans")

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    no = ~F.col("base") & ~F.col("own_base") & (~F.col("wide_valid") | F.col("other_base"))
    taught = spans.where(F.col("base") & F.col("wide_valid") | no)
    cases = taught.groupBy(held.alias("held"), *FEATURES).agg(F.sum(F.col("base").cast("long")).alias("yes"), F.sum((~F.col("base")).cast("long")).alias("no"))
    cases = stored(cases, "private-cases")
    margin = fit_trees(cases.where("not held"), rounds=rounds)
    score = F.floor(1000 / (1 + F.exp(-margin))).cast("int")
    at_least = thresholds(cases.where("held"), score, precision)

    level = reduce(lambda c, k: c.when(F.col("kind") == k, at_least.get(k, 1001)), KINDS, F.when(F.lit(False), 0))
    more = spans.where(~F.col("base") & ~F.col("own_base") & ~F.col("other_base") & F.col("wide_valid")).withColumn("score", score).where(F.col("score") >= level)
    best = Window.partitionBy("row", "kind", "cluster")
    upto = Window.partitionBy("row", "kind").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    more = more.withColumn("new", F.coalesce((F.max("end").over(upto) <= F.col("start")).cast("int"), F.lit(1)))
    more = more.withColumn("cluster", F.sum("new").over(Window.partitionBy("row", "kind").orderBy("start", "end")))
    more = more.withColumn("place", F.row_number().over(best.orderBy(F.desc("score"), F.desc(F.col("end") - F.col("start")), "start"))).where("place = 1")
    kept = spans.where("base").select("row", "kind", "start", "end", "base").unionByName(more.select("row", "kind", "start", "end", "base"))
    item = F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("k"), "start", "end", "base")
    by_row = kept.groupBy("row").agg(F.sort_array(F.collect_list(item)).alias("s"))  # as many as one text holds
    out = rows.select("row", "doc_id").join(by_row, "row", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<k:bigint,start:bigint,end:bigint,base:boolean>>")))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"].cast("int")), x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("s", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["k"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, F.lit(i + 1)))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
