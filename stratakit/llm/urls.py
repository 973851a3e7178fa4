"""URL filters with redirect equivalence.

Block and allow rules are (host, path) pairs; a rule fits its host and all
subdomains where the url's path starts with the rule's, and the longest
fitting rule wins.  Urls tied by redirects or canonical links are aliases:
connected components over these edges carry decisions from urls with a rule to
those without.  Precedence: a url's own rule; then an explicit allow of any
alias; then a block of any alias; then allow.

All DataFrame functions.  Rules are matched once for every different (host,
path), by an equality join on the host's suffixes; decisions are one row a
component before they are joined back.  A url that a third of all edges point
to is a hub of the components, whose joins Spark splits.

Defined results: a url that is null or has no ``://`` has empty host and path,
no rule, no aliases and is allowed; repeated urls get equal results; empty
tables and an empty rule list work as such; null edge ends are no edges;
fragments don't tell urls apart as aliases, nor do dot segments, an empty path
against ``/``, and entities in a page's links; columns of other names are not
carried, and working names are those of tables made here; a very long url
costs time in proportion to its length, or to the square of its number of
segments where it has dot segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import local_table
from .common import grown, materialize
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "rule_host string, rule_path string, rule_verdict string"

#: Rules (host, path, verdict) of the registered query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))


# The standard entities; an ampersand's own comes last.
ENTITIES = (("&(lt|#60|#[xX]3[cC]);", "<"), ("&(gt|#62|#[xX]3[eE]);", ">"), ("&(quot|#34|#[xX]22);", "\""),
            ("&(apos|#39|#[xX]27);", "'"), ("&(amp|#38|#[xX]26);", "&"))


def _rest(url: Column) -> Column:
    """What stands after the first ://, or empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """``path`` with its ``.`` and ``..`` segments resolved."""
    parts = F.slice(F.split(path, "/", -1), F.lit(2), F.size(F.split(path, "/", -1)))
    walked = F.aggregate(parts, F.lit(""), lambda done, part: F.when(part == ".", done)
                         .when(part == "..", F.regexp_replace(done, "/[^/]*$", ""))
                         .otherwise(F.concat(done, F.lit("/"), part)))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(walked, F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))
                  ).otherwise(path)


def plain(text: Column) -> Column:
    """An attribute's value with the standard entities decoded."""
    for name, mark in ENTITIES:
        text = F.regexp_replace(text, name, mark)
    return text


def node_of(url: Column) -> Column:
    """The url without its fragment, scheme and host lower-cased, an empty
    path read as ``/`` and dot segments resolved; null if it is none."""
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    path = without_dots(F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url)))
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), path, query))


def html_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) urls: canonical links and refresh redirects of each page's
    html, resolved against its url."""
    html, url = F.col(html_col), F.col(url_col)
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\s[^>]*>"), F.lit(0)),
                     lambda t: t.rlike(r"(?is)\srel\s*=\s*[\"']?canonical[\"'\s/>]"))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0)),
                     lambda t: t.rlike(r"(?is)\shttp-equiv\s*=\s*[\"']?refresh[\"'\s/>]"))
    targets = F.concat(
        F.transform(links, lambda t: F.regexp_extract(t, r"(?is)\shref\s*=\s*[\"']?([^\"'\s>]+)", 1)),
        F.transform(metas, lambda t: F.regexp_extract(t, r"(?is)[;\s]url\s*=\s*[\"']?([^\"'\s>]+)", 1)))
    found = (pages.filter(url.isNotNull() & html.rlike(r"(?i)<(link|meta)\s"))
             .select(url.alias("src"), F.explode(targets).alias("href"))
             .select("src", plain(F.col("href")).alias("href")).filter("href <> ''"))
    src = F.col("src")
    scheme, host = F.substring_index(src, "://", 1), host_of(src)
    base = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(F.when(path_of(src) == "", F.lit("/")).otherwise(path_of(src)), "[^/]*$", "")
    href = F.col("href")
    whole = (F.when(href.contains("://"), href)
             .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
             .when(href.startswith("/"), F.concat(base, href))
             .otherwise(F.concat(base, folder, href)))
    return found.select("src", whole.alias("dst"))


def matched_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict) of the different (host, path) of
    ``places`` that a rule fits.  Of rules of one length the one with the
    longer host wins, then allow."""
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)),
                         lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    dealt = places.select("host", "path").distinct().select("host", "path", F.explode(suffix).alias("rule_host"))
    fits = dealt.join(rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    best = F.struct(F.length(name).alias("n"), F.length("rule_host").alias("h"),
                    (F.col("rule_verdict") == "allow").alias("a"), name.alias("rule"),
                    F.col("rule_verdict").alias("v"))
    return (fits.groupBy("host", "path").agg(F.max(best).alias("b"))
            .select("host", "path", F.col("b.rule").alias("rule"), F.col("b.v").alias("rule_verdict")))


def judge_urls(pages: DataFrame, edges: DataFrame | None = None, rules=RULES, id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, component) of every page.  ``rules``: a
    list of (host, path, verdict), or a DataFrame (rule_host, rule_path,
    rule_verdict) of any size; ``edges``: (src, dst) urls."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        from pyspark.sql.types import StringType, StructField, StructType
        schema = StructType([StructField(c, StringType()) for c in ("rule_host", "rule_path", "rule_verdict")])
        rules = local_table(spark, [tuple(r) for r in rules], schema)
    url = F.col(url_col)
    named = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"),
                         node_of(url).alias("node"))
    own = materialize(matched_rules(named, rules), "rules")
    judged = named.join(grown(own), ["host", "path"], "left")
    if edges is None:
        aliases = spark.createDataFrame([], "node string, component string, alias_verdict string")
    else:
        ties = materialize(edges.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst"))
                           .filter("src is not null and dst is not null and src <> dst").distinct(), "aliases")
        members = connected_components(ties)
        places = members.select("node", "component", host_of(F.col("node")).alias("host"),
                                path_of(F.col("node")).alias("path"))
        ruled = places.join(matched_rules(places, rules), ["host", "path"])
        decided = materialize(ruled.groupBy("component").agg(
            F.min(F.col("rule_verdict")).alias("alias_verdict")), "decisions")     # allow sorts before block
        aliases = materialize(members.join(grown(decided), "component", "left")
                              .select("node", "component", "alias_verdict"), "alias-verdicts")
    return (judged.join(grown(aliases), "node", "left")
            .select(id_col, "host", "path", "rule",
                    F.coalesce("rule_verdict", "alias_verdict", F.lit("allow")).alias("verdict"), "component"))
