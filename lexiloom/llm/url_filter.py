"""URL filter with redirect equivalence.

Rules judge a url by its host and path. A block also reaches the url's aliases: urls joined to it,
directly or over others, by redirects and canonical links. An explicit allow is stronger.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import written
from lexiloom.llm.components import connected_components

COMPILED_RULES = 500  # up to here rules become one expression; longer lists are joined

# Patterns that name another address of the same page.
LINK_TAG = r"<link\b[^>]*>"
META_TAG = r"<meta\b[^>]*>"
TRACKING = r"[?&]utm_[a-z]+=[^&#]*"


def _rest(url: Column | str) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column | str) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    host = F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0),
                       string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit(""))


def path_of(url: Column | str) -> Column:
    """After the host up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address_key(url: Column | str) -> Column:
    """One key for spellings of an address: host, path and query without scheme, fragment,
    tracking parameters and a slash at the end. Null if the url has no ``://``."""
    rest = F.regexp_replace(F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1), TRACKING, "")
    return F.when(F.locate("://", url) > 0,
                  F.concat(host_of(url), F.regexp_replace(rest, r"/+$", "")))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or not, with or without blanks around the sign."""
    return F.trim(F.coalesce(
        F.nullif(F.regexp_extract(tag, rf"(?i)[\s\"']{name}\s*=\s*\"([^\"]*)", 1), F.lit("")),
        F.nullif(F.regexp_extract(tag, rf"(?i)[\s\"']{name}\s*=\s*'([^']*)", 1), F.lit("")),
        F.regexp_extract(tag, rf"(?i)[\s\"']{name}\s*=\s*([^\"'\s>]+)", 1)))


def links_in(html: Column | str) -> Column:
    """What a page calls its canonical address or sends its reader to at once, as written."""
    tags = lambda pattern: F.regexp_extract_all(html, F.lit(f"(?i){pattern}"), F.lit(0))
    canonical = F.transform(
        F.filter(tags(LINK_TAG), lambda t: F.rlike(_attribute(t, "rel"), F.lit(r"(?i)(^|\s)canonical($|\s)"))),
        lambda t: _attribute(t, "href"))
    refresh = F.transform(
        F.filter(tags(META_TAG), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh"),
        lambda t: F.regexp_extract(t, r"(?i)url\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    found = F.filter(F.concat(canonical, refresh), lambda u: u != F.lit(""))
    return F.coalesce(found, F.array().cast("array<string>"))


def resolved(link: Column | str, base: Column | str) -> Column:
    """A link as an absolute url, seen from the page's: with a scheme as it is; from ``//`` on with the page's scheme,
    from ``/`` on with its host, ``?`` and ``#`` behind its path, else in the folder of its path. Other schemes than
    those with ``//`` (mailto:) and links on pages without ``://`` give null."""
    link, base = (F.col(x) if isinstance(x, str) else x for x in (link, base))
    scheme = F.regexp_extract(base, r"^([^:/?#]+):", 1)
    site = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*", 0)
    path = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    joined = F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link)
    return (F.when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), link)
            .when((site == "") | F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None))
            .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
            .when(F.startswith(link, F.lit("/")), F.concat(site, _without_dots(link)))
            .when(F.rlike(link, F.lit("^[?#]")), F.concat(site, path, link))
            .otherwise(F.concat(site, _without_dots(F.substring(joined, F.length(site) + 1, F.length(joined))))))


def _without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; what follows ``?`` or ``#`` stays."""
    way, rest = F.regexp_extract(path, r"^[^?#]*", 0), F.regexp_extract(path, r"^[^?#]*(.*)$", 1)
    parts = F.split(way, "/")
    walked = F.aggregate(
        F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"),
        lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(p == ".", done).otherwise(F.concat(done, F.array(p))))
    # A path that ends in dots ends in a folder.
    tail = F.when(F.rlike(way, F.lit(r"/\.{1,2}$")), F.lit("/")).otherwise(F.lit(""))
    plain = F.concat(F.lit("/"), F.array_join(walked, "/"))
    return F.when(F.rlike(way, F.lit(r"/\.{1,2}(/|$)")), F.concat(
        F.when((tail == "/") & plain.endswith("/"), plain).otherwise(F.concat(plain, tail)), rest)).otherwise(path)


def _parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return "".join(c.lower() if c in string.ascii_uppercase else c for c in host), slash + path


def _compiled(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), -len(_parts(r[0])[0]), r[1] != "allow", r[0], r[1])):
        h, p = _parts(rule)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("rule_verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def match_rules(df: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` (null without one) to rows with ``host`` and ``path``.

    ``rules`` are (rule, verdict) pairs, a rule being a host and a path prefix written together;
    it fits its host and all subdomains, and the longest one wins. Of rules equally long the one with the longer
    host wins; of a rule listed twice, allow, then the smaller spelling, then the smaller verdict. Null rules fit
    nothing. A short list is one expression. A list of any length, or a table (rule, verdict), is joined by
    host suffix, with the same result: distinct hosts and paths only, so the few hot hosts of a crawl meet a rule
    table once per path.
    """
    spark = df.sparkSession
    if not isinstance(rules, DataFrame):
        if not rules:
            return df.select("*", F.lit(None).cast("string").alias("rule"),
                             F.lit(None).cast("string").alias("rule_verdict"))
        if len(rules) <= COMPILED_RULES:
            hit = _compiled([r for r in rules if r[0] is not None], F.col("host"), F.col("path"))
            return df.withColumn("_hit", hit).select(*df.columns, "_hit.rule", "_hit.rule_verdict")
        rules = spark.createDataFrame(list(rules), "rule string, verdict string")
    table = rules.where("rule is not null").select(
        ascii_host("rule").alias("_suffix"), F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("_prefix"),
        F.col("rule").alias("_rule"), F.col("verdict").alias("_verdict"))
    places = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    best = (
        places.withColumn("_suffix", F.explode(suffixes)).join(table, "_suffix")
        .where(F.col("path").startswith(F.col("_prefix")))
        .groupBy("host", "path").agg(F.min(F.struct(
            (-F.length("_rule")).alias("n"), (-F.length("_suffix")).alias("h"),
            (~F.col("_verdict").eqNullSafe(F.lit("allow"))).alias("v"), F.col("_rule").alias("rule"),
            F.col("_verdict").alias("rule_verdict"))).alias("_hit")))
    return df.join(best, ["host", "path"], "left").select(*df.columns, "_hit.rule", "_hit.rule_verdict")


def ascii_host(rule: str) -> Column:
    return F.translate(F.regexp_extract(rule, r"^[^/]*", 0),
                       string.ascii_uppercase, string.ascii_lowercase)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, *,
                url: str = "url", html: str | None = "html", redirects: DataFrame | None = None,
                default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict added.

    Edges are the canonical links and immediate refreshes in ``html`` and the rows of
    ``redirects`` (source, target), between addresses as ``address_key`` writes them. A
    page with a rule gets the rule's verdict. A page without one is blocked if its component holds
    an address that a rule blocks, crawled or only linked to; else it gets ``default``. So an
    explicit allow protects its own address, not its aliases.

    Links are resolved against the page's url. Null or malformed urls and html have no host, path, rule or alias and
    get ``default``; of html of any length all tags are read. Repeated rows are judged alike, an empty table gives an
    empty one. Columns of ``pages`` with the names of the four results are replaced. Html is read once for the
    edges. Verdicts of aliases come back by a join on the address: without a shuffle of the pages if the
    blocked addresses are few enough for Spark to broadcast, else with one; rows without an address are spread.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = match_rules(
        pages.select(*own, host_of(url).alias("host"), path_of(url).alias("path")), rules)

    sources = []
    if html is not None:
        sources.append(pages.select(F.col(url).alias("_from"),
                                    F.explode_outer(links_in(html)).alias("_to")).select(
                                        "_from", resolved("_to", "_from").alias("_to")))
    if redirects is not None:
        sources.append(redirects.select(F.col("source").alias("_from"), F.col("target").alias("_to")))
    if not sources:
        return _final(judged, own, None, url, default)
    links = sources[0] if len(sources) == 1 else sources[0].union(sources[1])
    links = written(links.where("_from is not null and _to is not null"), "links")

    keyed = links.select(address_key("_from").alias("left"), address_key("_to").alias("right"))
    members = connected_components(keyed, "left", "right")
    ends = links.select(F.explode(F.array("_from", "_to")).alias("_u")).distinct()
    on_rule = match_rules(ends.select(address_key("_u").alias("node"), host_of("_u").alias("host"),
                                      path_of("_u").alias("path")), rules)
    blocked_nodes = on_rule.where("rule_verdict = 'block'").select("node").distinct()
    # A page under another spelling of a linked address may be the one a rule blocks.
    spelled = (judged.where("rule_verdict = 'block'").select(address_key(url).alias("node")).distinct()
               .join(members.select("node"), "node", "left_semi"))
    components = (members.join(blocked_nodes.union(spelled).distinct(), "node")
                  .select("component").distinct())
    blocked = members.join(components, "component").select(F.col("node").alias("_key"))
    return _final(judged, own, written(blocked, "blocked"), url, default)


def _final(judged: DataFrame, own: list[str], blocked: DataFrame | None, url: str,
           default: str) -> DataFrame:
    if blocked is None:
        verdict = F.coalesce("rule_verdict", F.lit(default))
        return judged.select(*own, "host", "path", "rule", verdict.alias("verdict"))
    # Rows without an address get a key of their own that meets nothing, so that they do not all fall to one task.
    nowhere = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    joined = judged.withColumn("_k", F.coalesce(address_key(url), nowhere)).join(
        blocked.withColumn("_blocked", F.lit(True)), F.col("_k") == F.col("_key"), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("_blocked"), "block"), F.lit(default))
    return joined.select(*own, "host", "path", "rule", verdict.alias("verdict"))
