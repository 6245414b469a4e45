"""One query for each operator, with its SQL counterpart where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm import (
    chat, decontamination, language_id, line_dedup, merkle, mixing, near_dedup, periodic, prefix_trie, quality,
    substring_dedup, suffix_dedup, url_filter,
)
from lexiloom.llm.common import WORD, table

RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
    ("net/es/", "block"), ("net/fr/", "block"),
)


def remainder(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return url_filter.filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_chunks", "n_repeated", "n_dropped", (F.col("n_repeated") > 0).alias("repeats"),
                      F.sha2("text", 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.fit_quality(docs, labels, where=remainder("doc_id", 5) != 0)
    return quality.score_quality(docs, model).select(
        "doc_id", (F.coalesce(remainder("doc_id", 5), F.lit(1)) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    return chat.digest_conversations(chat.format_conversations(rows.union(probe)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.fit_languages(docs, where=remainder("doc_id", 4) != 2)
    return language_id.predict_languages(docs.select("doc_id", "text"), model).select(
        "doc_id", (F.coalesce(remainder("doc_id", 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def rebuilt_conversations(rows: DataFrame) -> DataFrame:
    """Every conversation c with the first crc32(c) % 6 turns of conversation c - c % 100 in place of its own."""
    turns = rows.where("conv_id is not null").select(
        "conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))) - 1).cast("long").alias("turn"))
    shared = remainder("conv_id", 6)
    base = F.col("conv_id") - F.col("conv_id") % 100
    heads = turns.where((F.col("conv_id") == base) & (F.col("turn") < 5)).withColumnRenamed("conv_id", "base")
    ids = rows.where("conv_id is not null").select("conv_id").distinct()
    led = ids.withColumn("base", base).join(heads, "base").where(F.col("turn") < shared)
    return led.select("conv_id", "turn", "role", "text").unionByName(turns.where(F.col("turn") >= shared))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return prefix_trie.prefix_trie(rebuilt_conversations(rows), rows.select("conv_id")).drop("digest")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Of every tenth document by crc32 of its id, the words from a on become a sequence that repeats."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), 0)
    planted = docs.withColumn("_w", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_w").cast("long")).withColumn(
        "_a", F.when(F.col("_n") > 0, g % F.col("_n"))).withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))
    kept = F.slice("_w", F.lit(1), F.col("_a").cast("int"))
    period = F.slice("_w", (F.col("_a") + 1).cast("int"), F.col("_p").cast("int"))
    count = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(period, count)), F.lit(1), (F.col("_n") - F.col("_a")).cast("int"))
    return planted.withColumn("text", F.when(F.col("_a").isNotNull(), F.array_join(F.concat(kept, again), " ")).otherwise(F.col("text"))).select(*docs.columns)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_periods(table(spark, sf_dir, "documents", "doc_id", "text"))
    found = periodic.periodic_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_suffixes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the documents; at the top of the repository, imported when it runs."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _lower(x: str) -> str:
    return _ASCII_LOWER.format(x)


def _crc32(x: str) -> str:
    """crc32 of the decimal digits of x, bit by bit."""
    return (f"xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length({x}::VARCHAR) + 1), lambda i: ord(substr({x}::VARCHAR, i, 1))::BIGINT), "
            "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295::BIGINT)")


_KEY = r"""CASE WHEN {0} LIKE '%://%' THEN """ + _lower(
    r"regexp_extract(substr({0}, strpos({0}, '://') + 3), '^[^/?#]*')") + r"""
  || regexp_replace(regexp_replace(regexp_extract(substr({0}, strpos({0}, '://') + 3), '^[^/?#]*([^#]*)', 1),
     '[?&]utm_[a-z]+=[^&#]*', '', 'g'), '/+$', '') END"""

_RULES = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES)

SQL = {
    "op1_url_filter": rf"""
WITH RECURSIVE rules(rule, rh, rp, rv) AS (VALUES {_RULES}),
links AS (
  SELECT url AS f, regexp_extract(t, '(?i)href=["'']?([a-z]+://[^"''\s>]+)', 1) AS g FROM (
    SELECT url, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*>')) AS t FROM pages)
  WHERE regexp_matches(t, '(?i)rel=["'']?canonical\b')
  UNION ALL
  SELECT url, regexp_extract(t, '(?i)url=["'']?([a-z]+://[^"''\s>]+)', 1) FROM (
    SELECT url, unnest(regexp_extract_all(html, '(?i)<meta\b[^>]*>')) AS t FROM pages)
  WHERE regexp_matches(t, '(?i)http-equiv=["'']?refresh\b')),
edges AS (SELECT {_KEY.format('f')} AS a, {_KEY.format('g')} AS b FROM links WHERE f IS NOT NULL AND g <> ''),
sym AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(s, n) AS (SELECT a, a FROM sym UNION SELECT r.s, e.b FROM reach r JOIN sym e ON r.n = e.a),
urls AS (SELECT url AS u FROM pages UNION SELECT f FROM links UNION SELECT g FROM links WHERE g <> ''),
placed AS (SELECT u, CASE WHEN u LIKE '%://%' THEN {_lower("regexp_extract(substr(u, strpos(u, '://') + 3), '^[^/?#]*')")}
    ELSE '' END AS host,
  CASE WHEN u LIKE '%://%' THEN regexp_extract(substr(u, strpos(u, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM urls),
matched AS (SELECT u, arg_max(rule, length(rule)) AS rule, arg_max(rv, length(rule)) AS rv
  FROM placed JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY u),
blocked AS (SELECT DISTINCT r.s AS k FROM reach r JOIN (
  SELECT DISTINCT {_KEY.format('u')} AS k FROM matched WHERE rv = 'block') m ON r.n = m.k)
SELECT p.page_id, coalesce(pl.host, '') AS host, coalesce(pl.path, '') AS path, m.rule,
  coalesce(m.rv, CASE WHEN {_KEY.format('p.url')} IN (SELECT k FROM blocked) THEN 'block' END, 'allow') AS verdict
FROM pages p LEFT JOIN placed pl ON pl.u = p.url LEFT JOIN matched m ON m.u = p.url""",
    "op2_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line FROM (
    SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
keyed AS (SELECT *, {_lower(f"trim(line, {_SPACES})")} AS k FROM lines),
often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, i, line, o.k IS NOT NULL AND doc_id < o.last AS gone FROM keyed LEFT JOIN often o USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op3_source_mix": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('7|' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
    ('0x' || md5('7|' || coalesce(source, chr(0)))[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM sized GROUP BY source),
levels AS (
  SELECT a.source, (1.5::DOUBLE * (SELECT sum(source_size) FROM named)
      - coalesce(sum(2.0::DOUBLE * b.source_size) FILTER (WHERE NOT later), 0)) / sum(b.weight) FILTER (WHERE later) AS level
  FROM (SELECT a.*, b.source_size AS bs, b.weight AS bw FROM named a, named b) x
  JOIN named a ON a.source IS NOT DISTINCT FROM x.source
  JOIN LATERAL (SELECT x.bs AS source_size, x.bw AS weight,
    x.bs * 2.0::DOUBLE / x.bw >= a.source_size * 2.0::DOUBLE / a.weight AS later) b ON true
  GROUP BY a.source),
level AS (SELECT max(l.level) AS v FROM levels l JOIN named n ON n.source IS NOT DISTINCT FROM l.source
  WHERE l.level * n.weight <= 2.0::DOUBLE * n.source_size),
targets AS (SELECT *, least(2.0::DOUBLE * source_size, (SELECT v FROM level) * weight) AS target FROM named),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, h, doc_id) AS r FROM sized),
rated AS (SELECT r.*, t.source_size, t.target, t.u,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0::DOUBLE) ELSE 0 END AS rate
  FROM ranked r JOIN targets t ON t.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  (size * least(floor(u + rate * r)::BIGINT - floor(u + rate * (r - 1))::BIGINT, 2))::BIGINT AS taken FROM rated""",
    "op6_near_dedup": rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM worded),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM shingled),
-- Two linked sets differ in few shingles: they share one of the first fifth and one, rarest first.
rare AS (SELECT g, count(*) AS df FROM flat GROUP BY g),
ordered AS (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS r FROM flat JOIN rare USING (g)),
head AS (SELECT doc_id, n, g FROM ordered WHERE r <= n - ceil(n * 0.8) + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb
  FROM head a JOIN head b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (SELECT p.a, p.b FROM pairs p JOIN shingled x ON x.doc_id = p.a JOIN shingled y ON y.doc_id = p.b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (na + nb - len(list_intersect(x.s, y.s)))),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(s, n) AS (SELECT a, a FROM sym UNION SELECT r.s, e.b FROM reach r JOIN sym e ON r.n = e.a),
least_of AS (SELECT s, min(n) AS m FROM reach GROUP BY s)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM shingled d LEFT JOIN least_of l ON l.s = d.doc_id""",
    "op8_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
said AS (SELECT conv_id, turn, role, text,
  length(role) + length(text) + length('<|turn|><|text|><|end|>') + 1
    + len(regexp_extract_all(role, '[<\[]\\*(/?s>|(bos|eos|pad|unk)>|[|\x{FF5C}][^|\x{FF5C}<>\[\] \t\n\x0b\f\r]+[|\x{FF5C}]>|</?SYS>>|(start|end)_of_turn>|/?(INST|SYSTEM_PROMPT|AVAILABLE_TOOLS|TOOL_RESULTS|TOOL_CALLS)\])'))
    + len(regexp_extract_all(text, '[<\[]\\*(/?s>|(bos|eos|pad|unk)>|[|\x{FF5C}][^|\x{FF5C}<>\[\] \t\n\x0b\f\r]+[|\x{FF5C}]>|</?SYS>>|(start|end)_of_turn>|/?(INST|SYSTEM_PROMPT|AVAILABLE_TOOLS|TOOL_RESULTS|TOOL_CALLS)\])')) AS n FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars, 0::BIGINT AS rewrites
FROM said GROUP BY conv_id""",
    "op10_decontamination": rf"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS g FROM (
    SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM worded, lengths WHERE len(w) >= n)),
hits AS (SELECT DISTINCT g.doc_id, g.i, g.n, x.item FROM grams g JOIN windows x ON x.n = g.n AND x.g = g.g),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (
  SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op11_prefix_trie": rf"""
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS n
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {_crc32('conv_id')} % 6 AS h FROM turns),
built AS (
  SELECT i.conv_id, t.n, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.base AND t.n < i.h
  UNION ALL SELECT t.conv_id, t.n, t.role, t.text FROM turns t JOIN ids i ON i.conv_id = t.conv_id AND t.n >= i.h),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS d FROM built),
prefixes(conv_id, d, p, up, chars) AS (
  SELECT conv_id, 0::BIGINT, '', NULL::VARCHAR, 0::BIGINT FROM ids
  UNION ALL SELECT n.conv_id, n.d, sha256(p.p || length(n.role) || ' ' || length(n.text) || ' ' || n.role || n.text), p.p, length(n.text)
  FROM prefixes p JOIN numbered n ON n.conv_id = p.conv_id AND n.d = p.d + 1),
sizes AS (SELECT conv_id, max(d) AS turns FROM prefixes GROUP BY conv_id),
nodes AS (SELECT p, min(p.conv_id) AS conv_id, any_value(d) AS depth, any_value(up) AS up, count(*) AS n_convs, any_value(chars) AS chars,
    coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE d = turns), '') AS ends
  FROM prefixes p JOIN sizes s ON s.conv_id = p.conv_id GROUP BY p),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
above AS (SELECT p AS node, p AS top FROM nodes UNION ALL SELECT a.node, n.up FROM above a JOIN nodes n ON n.p = a.top WHERE n.up IS NOT NULL),
sums AS (SELECT top, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.chars)::BIGINT AS saved_tokens
  FROM above a JOIN nodes x ON x.p = a.node LEFT JOIN kids k ON k.up = x.p GROUP BY top)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved_tokens,
  sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.top = n.p LEFT JOIN kids k ON k.up = n.p LEFT JOIN nodes u ON u.p = n.up""",
    "op12_periodic_runs": rf"""
WITH given AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32('doc_id')} AS h FROM documents),
placed AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM given),
spaced AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed),
texts AS (SELECT row_number() OVER () AS d, doc_id, n, CASE WHEN a IS NULL THEN w
    ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS w FROM spaced),
words AS (SELECT d, n, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM texts),
equal AS (SELECT x.d, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.d = y.d AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n / 2),
marked AS (SELECT d, q, i, i - row_number() OVER (PARTITION BY d, q ORDER BY i) AS island FROM equal),
stretches AS (SELECT d, q, min(i) AS s, count(*) + q AS l FROM marked GROUP BY d, q, island
  HAVING count(*) + q >= 12 AND count(*) >= q),
runs AS (SELECT d, s, l, min(q) AS q FROM stretches GROUP BY d, s, l),
gone AS (SELECT DISTINCT d, unnest(range(s + q, s + l)) AS i FROM runs),
listed AS (SELECT d, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs,
    max((l, -s, -q)) AS best FROM runs GROUP BY d),
kept AS (SELECT d, string_agg(w, ' ' ORDER BY i) AS body FROM words LEFT JOIN (SELECT d, i, true AS out FROM gone) g USING (d, i)
  WHERE g.out IS NULL GROUP BY d)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, (-best[2])::BIGINT AS start, (best[1])::BIGINT AS length, (-best[3])::BIGINT AS period,
  (1000 * best[1] // -best[3])::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (d) LEFT JOIN kept USING (d)""",
    "op13_suffix_dedup": r"""
WITH texts AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS d, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
parts AS (
  SELECT d, b, substr(x, 2 * b + 1, 2 * 1099) AS x FROM (
    SELECT d, x, unnest(range(0, greatest(length(x) // 2 - 99, 0), 1000)) AS b FROM texts)),
windows AS (
  SELECT d, b + o AS i, md5(substr(x, 2 * o + 1, 200)) AS h FROM (
    SELECT d, b, x, unnest(range(0, least(1000, length(x) // 2 - 99))) AS o FROM parts)),
later AS (
  SELECT d, i FROM windows JOIN (SELECT h, min((d, i)) AS f FROM windows GROUP BY h HAVING count(*) > 1) USING (h) WHERE (d, i) <> f),
lagged AS (SELECT d, i, coalesce(i - lag(i) OVER (PARTITION BY d ORDER BY i) > 100, true) AS opens FROM later),
runs AS (SELECT d, min(i) AS s, max(i) + 100 AS e FROM (
  SELECT d, i, sum(opens::INT) OVER (PARTITION BY d ORDER BY i) AS r FROM lagged) GROUP BY d, r),
gaps AS (
  SELECT d, coalesce(lag(e) OVER (PARTITION BY d ORDER BY s), 0) AS s, s AS e FROM runs
  UNION ALL SELECT d, max(e), NULL FROM runs GROUP BY d),
kept AS (SELECT d, string_agg(CASE WHEN g.e IS NULL THEN substr(x, 2 * g.s + 1) ELSE substr(x, 2 * g.s + 1, 2 * (g.e - g.s)) END, '' ORDER BY g.s) AS x
  FROM gaps g JOIN texts USING (d) GROUP BY d),
counted AS (SELECT d, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY d)
SELECT doc_id, length(t.x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k.x, t.x))) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (d) LEFT JOIN counted USING (d)""",
}

QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_line_dedup, op3_source_mix, op4_substring_dedup, op5_quality, op6_near_dedup,
    op7_merkle_fingerprint, op8_chat_format, op9_language_id, op10_decontamination,
    op11_prefix_trie, op12_periodic_runs, op13_suffix_dedup)} | {"pipeline": corpus}
