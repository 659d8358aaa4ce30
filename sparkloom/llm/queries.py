"""The registered query of each text operator: whole tables, production parameters, contract columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import attention_quality, chat, decontaminate, divergence_audit, html_text, language_id, line_templates, mixing, private_data, quality_rules, simhash, spelling, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality_rules.quality_verdicts(docs, keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "mark_distance", "common_distance")


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).drop("items")


@query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id", "n_links")


@query
def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


#: The rules of the query.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


@query
def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_texts(table(spark, sf_dir, "conversations"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    profiles = language_id.learn_profiles(docs.where(~F.coalesce(held_out, F.lit(False))).select("lang", "text"))
    out = language_id.predict_language(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query
def op4_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = attention_quality.fit(docs, labels.where(~held_out).select("doc_id", F.col("quality").alias("label")))
    out = attention_quality.score_quality(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.spelling_groups(docs).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


@query
def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.private_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = ", ".join(f"('{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}', '{v}')" for r, v in URL_RULES)
ORACLES["op6_url_filter"] = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, host, path, verdict) AS (VALUES {_RULES}),
m AS (SELECT page_id, rule, verdict FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)"""
ORACLES["op10_chat_snapshots"] = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:i] AS l FROM (SELECT l, unnest(range(1, len(l))) AS i FROM c)),
w AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_equal FROM c GROUP BY l)
SELECT conv_id, len(l) AS n_turns, n_equal,
  array_to_string(list_transform(l, lambda x: '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10)), '') AS text
FROM w ANTI JOIN p USING (l)"""


def _alnum_words(column: str, source: str) -> str:
    text = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return f"SELECT {column}, list_filter(string_split_regex({text}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM {source}"


ORACLES["op3_benchmark_decontamination"] = f"""
WITH d AS ({_alnum_words('doc_id', 'documents')}), b AS ({_alnum_words('item_id', 'benchmark')}),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS gram FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(0, greatest(len(w) - k + 1, 0))) AS i FROM d, (SELECT DISTINCT k FROM win))),
h AS (SELECT DISTINCT doc_id, item_id, g.k, i FROM g JOIN win USING (k, gram)),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)"""
_TOKEN = r"[^\x20\x09\x0B-\x0D]+"
ORACLES["op5_line_templates"] = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, pos, regexp_extract_all(line, '{_TOKEN}') AS raw FROM l WHERE doc_id IS NOT NULL),
k AS (SELECT doc_id, pos, raw, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS masked FROM r WHERE len(raw) > 0),
h AS (SELECT doc_id, pos, len(raw) AS n, masked[1:4] AS head, CASE WHEN len(raw) < 8 OR len(list_filter(masked, lambda x: x <> '<*>')) = 0 THEN raw ELSE masked END AS tokens FROM k),
o AS (SELECT n, tokens[1:4] AS head, tokens, count(*) AS c FROM h GROUP BY ALL),
mixed AS (SELECT n, head FROM o WHERE n >= 8 GROUP BY ALL HAVING count(*) > 1),
places AS (SELECT n, head, c, unnest(tokens) AS token, unnest(range(0, n)) AS place FROM o JOIN mixed USING (n, head)),
votes AS (SELECT n, head, place, token, sum(c) AS v FROM places GROUP BY n, head, place, token QUALIFY row_number() OVER (PARTITION BY n, head, place ORDER BY sum(c) DESC, token DESC) = 1),
usual AS (SELECT n, head, list(token ORDER BY place) AS usual FROM votes GROUP BY ALL),
judged AS (SELECT tokens, n, head, len(list_filter(list_zip(tokens, usual), lambda z: z[1] = z[2])) >= 0.8 * n AS voted FROM o JOIN usual USING (n, head)),
rest AS (SELECT n, head, tokens, unnest(range(1, 4)) AS r FROM judged WHERE NOT voted),
places_of AS (SELECT *, unnest(range(5, n - r + 2)) AS p FROM rest),
spread AS (SELECT n, head, tokens, r, p, tokens[p : p + r - 1] AS body, tokens[p - 1] AS before, coalesce(tokens[p + r], '') AS behind FROM places_of),
varied AS (SELECT n, head, r, p, before, behind, count(DISTINCT body) AS v FROM spread GROUP BY ALL HAVING count(DISTINCT body[1]) > 1 AND count(DISTINCT body[r]) > 1),
maybe AS (SELECT n, head, tokens, v, unnest(range(p, p + r)) AS place FROM spread JOIN varied USING (n, head, r, p, before, behind)),
fields AS (SELECT n, head, tokens, place FROM maybe GROUP BY n, head, tokens, place QUALIFY row_number() OVER (PARTITION BY n, head, tokens ORDER BY max(v) DESC, place) <= n - ceil(0.8 * n)),
masks AS (SELECT n, head, tokens, list_transform(tokens, lambda x, i: CASE WHEN list_contains(own, i) THEN '<*>' ELSE x END) AS mask FROM (SELECT n, head, tokens, list(place) AS own FROM fields GROUP BY n, head, tokens)),
general AS (SELECT tokens, n, head, NULL AS mask FROM judged WHERE voted UNION ALL SELECT tokens, n, head, mask FROM masks),
many AS (SELECT *, n || ' ' || array_to_string(head, ' ') || ' / ' || coalesce(array_to_string(mask, ' '), '') AS template FROM general QUALIFY count(*) OVER (PARTITION BY n, head, mask) > 1),
named AS (SELECT h.*, coalesce(many.template, array_to_string(h.tokens, ' ')) AS template, many.tokens IS NOT NULL AS general FROM h LEFT JOIN many USING (tokens)),
firsts AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY general, template) AS lo FROM named),
gone AS (SELECT doc_id, pos FROM firsts WHERE doc_id <> lo),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_dropped, coalesce(string_agg(CASE WHEN gone.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '') AS text FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, kept.text FROM documents d LEFT JOIN kept USING (doc_id)"""

_BYTES = "flatten(list_transform(string_split(k, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)] END))"
ORACLES["op11_spelling_variants"] = f"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
raw AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
per AS (SELECT id, run, count(*) AS c FROM raw WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM (SELECT run, c, id || ':' || run AS k FROM per), tab),
w AS (SELECT CASE WHEN h % 31 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, c FROM hashed),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
wild AS (SELECT word, n, i, word[: i - 1] AS ahead, word[i + 1 :] AS behind FROM p),
cut AS (SELECT DISTINCT word, n, word[: i - 1] || word[i + 1 :] AS k FROM p),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM wild a JOIN wild b USING (i, ahead, behind) WHERE a.word <> b.word
  UNION ALL SELECT cut.word, v.word, v.n FROM cut JOIN v ON v.word = cut.k UNION ALL SELECT v.word, cut.word, cut.n FROM cut JOIN v ON v.word = cut.k),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN other END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM f UNION SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL),
last AS (SELECT chain.word, root FROM chain JOIN f ON f.word = root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN last USING (word)"""
ORACLES["op12_source_divergence"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tok AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS k FROM tok GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(k) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
held AS (SELECT c.* FROM c JOIN kept USING (lang, term)),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN held USING (lang, source) GROUP BY ALL),
cell AS (SELECT g.lang, g.source, kept.term, coalesce(held.n, 0) AS n, 1 + (1000000000 * (coalesce(held.n, 0) + 2)) // (g.n + 2 * v.v) AS p, 1 + (1000000000 * (kept.total + 2)) // (v.n + 2 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN kept ON kept.lang = g.lang LEFT JOIN held ON held.lang = g.lang AND held.source = g.source AND held.term = kept.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM cell a JOIN cell b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM cell WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (FROM pair UNION ALL FROM term)) WHERE part = 'pair' OR rank <= 10"""
