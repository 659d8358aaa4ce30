"""Line deduplication by a fixed-depth tree of line templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import free_names, join_hot, let, small, stored

#: What stands for a token that varies: one with a digit.
FIELD = "<*>"
#: As many fields may stand side by side.
MAX_RUN = 3
_CONTEXT = "array<struct<key:bigint,body:bigint,head:bigint,tail:bigint,place:int,width:int>>"
_BLANKS = ("\t", "\x0b", "\x0c", "\r")


def _spaced(line: Column) -> Column:
    """The line with one space between tokens and none around."""
    odd = line.contains("  ")
    for blank in _BLANKS:
        odd = odd | line.contains(blank)
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(line))


def _plain(line: Column, n: Column, min_words: int) -> Column:
    """A spaced line of n tokens with FIELD for each token with a digit. Lines of fewer than min_words tokens, and those whose
    every token has a digit, such as the rows of a table, stand for themselves."""
    masked = F.regexp_replace(line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)
    fixed = F.length(F.replace(F.replace(masked, F.lit(FIELD), F.lit("")), F.lit(" "), F.lit(""))) > 0
    return F.when((n < min_words) | ~line.rlike("[0-9]"), line).otherwise(F.when(fixed, masked).otherwise(line))


def _hash(*values: Column) -> Column:
    """128 bits, for what is told apart by its hash alone."""
    return F.struct(F.xxhash64(*values).alias("x"), F.xxhash64(F.lit(1), *values).alias("y"))


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, body, at, n, value): each line with a token, n being their number; body tells texts with equal ids apart."""
    lines = F.posexplode(F.split("text", "\n")).alias("at", "value")
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("body"), lines)
    rows = rows.where("value <> ''").withColumn("value", _spaced(F.col("value"))).where("value <> ''")
    rows = rows.withColumn("n", F.length("value") - F.length(F.replace("value", F.lit(" "), F.lit(""))) + 1)
    return rows.withColumn("value", _plain(F.col("value"), F.col("n"), min_words))


def _named_lines(docs: DataFrame, min_words: int, depth: int) -> DataFrame:
    """(doc_id, body, at, leaf, line): each line with a hash of its own, and from min_words tokens on with its leaf of the tree
    (token count, then leading tokens)."""
    leaf = F.when(F.col("n") >= min_words, F.xxhash64("n", F.substring_index("value", " ", depth)))
    return _lines(docs, min_words).select("doc_id", "body", "at", leaf.alias("leaf"), _hash(F.col("value")).alias("line"))


def _voted(tokens: DataFrame, mixed: DataFrame, similarity: float) -> DataFrame:
    """tokens with voted: whether a line agrees with its leaf's most frequent tokens in the share similarity of them."""
    places = tokens.select("leaf", "n", F.posexplode("tokens").alias("place", "token")).groupBy("leaf", "place", "token").agg(F.sum("n").alias("n"))
    usual = places.groupBy("leaf", "place").agg(F.max(F.struct("n", "token"))["token"].alias("usual"))
    usual = usual.groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "usual"))), lambda x: x["usual"]).alias("usual"))
    usual = stored(usual.join(mixed, "leaf"), "templates")
    agree = F.aggregate(F.zip_with("tokens", "usual", lambda a, b: (a == b).cast("int")), F.lit(0), lambda t, x: t + x)
    return join_hot(tokens, usual, "leaf", "n_lines").withColumn("voted", agree >= similarity * F.size("tokens")).drop("usual", "n_lines")


def _contexts(tokens: Column, leaf: Column, depth: int) -> Column:
    """Of a line's tokens: each run of at most MAX_RUN of them below the leading ones, as (key, body, head, tail, place, width): hashes
    of what it stands between and where, of the run, and of its two ends. Two keys that clash only offer a place as a field."""

    def of(hashes: Column) -> Column:
        def run(width: int) -> Column:
            def at(i: Column) -> Column:
                own = [F.get(hashes, i + k) for k in range(width)]
                behind = F.coalesce(F.get(hashes, i + width), F.lit(0).cast("long"))  # the end of the line
                key = F.xxhash64(leaf, i, F.lit(width), F.get(hashes, i - 1), behind)
                return F.struct(key.alias("key"), F.xxhash64(*own).alias("body"), own[0].alias("head"), own[-1].alias("tail"), i.alias("place"), F.lit(width).alias("width"))

            last = F.size(hashes) - width
            return F.when(last >= depth, F.transform(F.sequence(F.lit(depth), F.greatest(last, F.lit(depth))), at))

        return F.concat(*[F.coalesce(run(w), F.array().cast(_CONTEXT)) for w in range(1, MAX_RUN + 1)])

    return let(F.transform(tokens, lambda x: F.xxhash64(x)), of)


def _masked(rest: DataFrame, similarity: float, depth: int) -> DataFrame:
    """Those of the lines that a vote left over which may share a template: (line, n, first_doc, last_doc, template).

    A run of up to MAX_RUN places is a run of fields where lines of the leaf that agree before and behind it differ in both its ends.
    If these are more places than the share 1 - similarity of the line, those with the most different runs are the fields, the
    first of equal ones. Lines that are equal but for their fields share a template, whatever else their leaf holds."""
    runs = stored(rest.select("line", F.inline(_contexts(F.col("tokens"), F.col("leaf"), depth))), "line-contexts")
    bodies = runs.groupBy("key", "body").agg(F.count("*").alias("n_lines"), F.min("head").alias("head"), F.min("tail").alias("tail"))
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in ("head", "tail") for f in (F.min, F.max)]
    varied = bodies.groupBy("key").agg(F.count("*").alias("n_bodies"), F.sum("n_lines").alias("n_lines"), *ends)
    varied = stored(varied.where("head_min <> head_max and tail_min <> tail_max").select("key", "n_bodies", "n_lines"), "varied-contexts")
    found = join_hot(runs.select("line", "key", "place", "width"), varied, "key", "n_lines")
    found = found.select("line", "n_bodies", F.explode(F.sequence("place", F.expr("place + width - 1"))).alias("place"))
    found = found.groupBy("line", "place").agg(F.max("n_bodies").alias("n_bodies"))
    ranked = found.groupBy("line").agg(F.sort_array(F.collect_list(F.struct((-F.col("n_bodies")).alias("fewer"), "place"))).alias("ranked"))
    known = rest.join(stored(ranked, "line-fields"), "line")
    most = F.size("tokens") - F.ceil(F.round(similarity * F.size("tokens"), 6)).cast("int")
    fields = F.transform(F.slice("ranked", F.lit(1), most), lambda x: x["place"])
    mask = let(fields, lambda own: F.transform("tokens", lambda x, i: F.when(F.array_contains(own, i), F.lit(FIELD)).otherwise(x)))
    return known.select("line", "n", "first_doc", "last_doc", _hash(F.col("leaf"), F.array_join(mask, " ")).alias("template"))


def _recurring(docs: DataFrame, held: DataFrame, min_words: int, depth: int, similarity: float, max_broadcast_rows: int) -> DataFrame:
    pick = F.xxhash64("doc_id", "body", "at")
    counts = (F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min(pick).alias("pick"))
    of_line = stored(held.groupBy("leaf", "line").agg(*counts), "lines")
    mixed = stored(of_line.where("leaf is not null").groupBy("leaf").agg(F.count("*").alias("n_lines")).where("n_lines > 1"), "mixed-leaves")
    # Only leaves with more than one kind of line need tokens: one line of each kind shows them.
    shown = stored(join_hot(of_line, mixed, "leaf", "n_lines"), "mixed-lines")
    texts = _lines(docs, min_words).where(F.col("n") >= min_words).select(pick.alias("pick"), "value")
    tokens = texts.join(small(shown, max_broadcast_rows), "pick").where(_hash(F.col("value")) == F.col("line"))
    tokens = tokens.withColumn("tokens", F.split("value", " ")).drop("value", "pick", "n_lines")
    tokens = stored(tokens.dropDuplicates(["line"]), "line-tokens")  # repeated rows have equal picks
    judged = stored(_voted(tokens, mixed, similarity), "voted-lines")
    alike = judged.where("voted").select("line", "n", "first_doc", "last_doc", _hash(F.col("leaf")).alias("template"))
    rest = judged.where("not voted").select("leaf", "line", "n", "first_doc", "last_doc", "tokens")
    general = stored(alike.unionByName(_masked(rest, similarity, depth)), "template-lines")
    whole = general.groupBy("template").agg(F.count("*").alias("n_lines"), F.min("first_doc").alias("first"), F.max("last_doc").alias("last"))
    many = stored(whole.where("n_lines > 1"), "line-templates")
    named = join_hot(general.select("line", "n", "template"), many, "template", "n_lines")
    named = stored(named.select("line", "template", F.col("first").alias("first_doc"), F.col("last").alias("last_doc"), "n"), "named-lines")
    exact = of_line.where("first_doc <> last_doc").join(small(named.select("line"), max_broadcast_rows), "line", "left_anti")
    exact = exact.select("line", F.col("line").alias("template"), "first_doc", "n")
    return exact.unionByName(named.where("first_doc <> last_doc").select("line", "template", "first_doc", "n"))


def recurring_lines(docs: DataFrame, *, min_words: int = 8, depth: int = 4, similarity: float = 0.8, max_broadcast_rows: int = 200_000) -> DataFrame:
    """(line, template, first_doc, n): the lines whose template occurs in two documents or more, with the template's smallest
    doc_id and the number of times the line occurs.

    Lines of min_words tokens or more with the same token count and the same depth leading tokens (tokens with a
    digit count as equal) share a leaf. A leaf's first template has at each place its most frequent token; lines that
    agree with it in at least the share similarity of their tokens take it. Among the others, a run of one to three tokens is
    a run of fields where lines of the leaf have different ones between the same two neighbours (or before the end), and
    lines that are equal but for fields, at most the share 1 - similarity of their tokens, take a template; what else the
    leaf holds does not matter. Any other line is a template by itself, and so is every line of fewer than min_words
    tokens: too little of it would be left to tell a template by.
    """
    held = stored(_named_lines(docs, min_words, depth), "document-lines")
    return _recurring(docs, held, min_words, depth, similarity, max_broadcast_rows)


def dedup_lines(docs: DataFrame, *, min_words: int = 8, depth: int = 4, similarity: float = 0.8, max_broadcast_rows: int = 200_000) -> DataFrame:
    """docs with text freed of recurring lines, and n_lines and n_dropped (replacing columns of these names).

    A line goes if its template (see recurring_lines) occurs in two documents or more and another
    document, the one with the smallest doc_id, holds it; there it stays, so one instance of everything
    is left. Lines without a token are never dropped, and a document's own repetitions
    are left to other rules. Null and empty texts stay as they are. Rows without a doc_id lose nothing
    and do not count; rows with the same doc_id are parts of one document. Other columns pass through.
    """
    held = stored(_named_lines(docs, min_words, depth), "document-lines")
    found = stored(_recurring(docs, held, min_words, depth, similarity, max_broadcast_rows).select("line", "first_doc", "n"), "recurring-lines")
    drop = join_hot(held, found, "line", "n").where("doc_id <> first_doc")
    out = docs.drop("n_lines", "n_dropped")
    doc, body, gone, rest = free_names(out.columns, "_line_doc", "_line_body", "_line_drop", "_line_rest")
    drop = drop.groupBy(F.col("doc_id").alias(doc), F.col("body").alias(body)).agg(F.collect_set("at").alias(gone))
    out = out.join(drop, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(body)), "left")

    def kept(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.transform(left, lambda i: F.get(lines, i))

    lines = F.split("text", "\n")
    return out.withColumn(rest, F.when(F.col(gone).isNotNull(), let(lines, kept))).withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"),
            "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
            "text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")),
        }
    ).drop(doc, body, gone, rest)
