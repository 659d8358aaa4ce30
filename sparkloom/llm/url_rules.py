"""URL rules: host-suffix and path-prefix expressions, found by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import let, lower_ascii, small, stored


def url_parts(url: Column) -> Column:
    """struct(host, path). host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from
    there up to ? # or the end. Both are empty for a null url or one without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return F.struct(
        lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def _expressions(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Each suffix of the host at a label, of up to labels labels, before each prefix of the path of a length that a rule has."""

    def of(parts: Column) -> Column:
        first = F.greatest(F.size(parts) - labels + 1, F.lit(1))
        suffixes = F.transform(F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
        ends = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length(path))
        return F.flatten(F.transform(suffixes, lambda s: F.transform(ends, lambda n: F.concat(s, F.left(path, n)))))

    return F.when(host != "", let(F.split(host, r"\."), of))


def judge_urls(pages: DataFrame, rules: DataFrame, *, default: str = "allow", digits: int = 8, max_rules: int = 1_000_000) -> DataFrame:
    """pages with host, path, rule and verdict (replacing columns of these names).

    rules has rule (host/path, such as example.net/en/) and verdict. A rule fits its host and all
    subdomains if the url's path starts with the rule's path; the longest that fits wins, and without
    any the verdict is default. Each url expands into the expressions that a rule could equal; these join
    on the first digits hex digits of their SHA-256, and the full digest confirms. Of rules given twice,
    block wins over allow. Rules that are null or have no / are ignored; null urls fit no rule; a row of
    pages gives a row, repeated or not.
    """
    good = rules.where(F.instr("rule", "/") > 1).groupBy("rule").agg(F.max("verdict").alias("verdict"))
    host = lower_ascii(F.substring_index("rule", "/", 1))
    digest = F.sha2(F.concat(host, F.substring("rule", F.instr("rule", "/"), F.length("rule"))), 256)
    listed = stored(
        good.select(
            F.col("rule").alias("_rule"),
            F.col("verdict").alias("_verdict"),
            digest.alias("_known"),
            F.left(digest, F.lit(digits)).alias("_key"),
            F.size(F.split(host, r"\.")).alias("labels"),
            (F.length("rule") - F.length(host)).alias("path_length"),
        ),
        "url-rules",
    )
    lengths = sorted(r[0] for r in listed.select("path_length").distinct().collect())
    labels = listed.agg(F.coalesce(F.max("labels"), F.lit(1))).first()[0]
    clean = pages.drop("host", "path", "rule", "verdict")
    names = clean.columns
    rows = clean.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_page"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("_url", url_parts(F.col("_page.url")))
    asked = rows.withColumn("_text", F.explode_outer(_expressions(F.col("_url.host"), F.col("_url.path"), labels, lengths)))
    asked = asked.withColumn("_digest", F.sha2("_text", 256)).withColumn("_key", F.coalesce(F.left("_digest", F.lit(digits)), F.hex("_row")))
    found = asked.join(small(listed.select("_rule", "_verdict", "_known", "_key"), max_rules), "_key", "left")
    hit = F.when(F.col("_digest") == F.col("_known"), F.struct(F.length("_rule").alias("n"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict")))
    best = found.groupBy("_row").agg(F.first("_page").alias("_page"), F.first("_url").alias("_url"), F.max(hit).alias("_hit"))
    return best.select("_page.*", "_url.host", "_url.path", "_hit.rule", F.coalesce("_hit.verdict", F.lit(default)).alias("verdict"))
