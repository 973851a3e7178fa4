"""Not-modified revisits resolved to full responses.

A web archive holds full responses and *revisits*: later captures where the
server said that nothing had changed (304), without a body.  Each revisit is
tied, by an as-of join on the canonical url, to the latest earlier full
response; its validators are checked against that response's, and the headers
that a 304 may update are merged into the stored ones.

The as-of join moves record ids and times only; bodies stay where they are and
are found by the source's record id.  It runs in bounded time buckets of a
url, so a url with a third of all captures is spread over tasks.

Statuses: ``resolved``; ``mismatch`` (a validator differs: entity tag, else
last-modified, else payload digest); ``no_validator`` (the revisit has none;
it isn't resolved); ``no_response`` (nothing earlier); ``no_url`` (no url or
no time).

Defined results: a record without url or time is never a source; captures of
one url and time don't see each other; of several responses of one time the
largest record id counts; repeated revisits each get their row; empty tables
work as such; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grown, latest_earlier, materialize
from .urls import LOWER, UPPER, _rest, host_of, path_of

#: Header fields of a 304 that don't update a stored response (fixed list,
#: after RFC 9111 section 3.2 and the hop-by-hop fields).
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
              "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te",
              "trailer", "transfer-encoding", "upgrade")
#: Query fields that don't tell resources apart.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid|sid)(=.*)?$"

RECORDS = ("record_id bigint, url string, ts bigint, kind string, etag string, last_modified string, "
           "payload_sha256 string, headers map<string,string>")


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` and default port, path without trailing slash,
    query fields sorted and without tracking ones; no scheme, no fragment.
    Null if there is no ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda f: (f != "") & ~f.rlike(TRACKING)))
    tail = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(F.lit(""))
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, tail))


def _tag(column: Column) -> Column:
    """Weak comparison: without W/."""
    return F.regexp_replace(F.trim(column), "^W/", "")


def merged_headers(stored: Column, update: Column) -> Column:
    """``stored`` with the fields that ``update`` may set (names in lower case)."""
    def lower(m):
        entries = F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))
        named = F.transform(entries,
                            lambda e: F.struct(F.translate(e["key"], UPPER, LOWER).alias("key"),
                                               e["value"].alias("value")))
        # of names that differ in case only, the first in order stays
        return F.map_from_entries(F.filter(
            named, lambda e, i: ~F.exists(F.slice(named, F.lit(1), i), lambda x: x["key"] == e["key"])))

    sent = F.map_filter(lower(update), lambda k, v: ~k.isin(*NOT_MERGED))
    kept = F.map_filter(lower(stored), lambda k, v: ~F.map_contains_key(sent, k))
    return F.map_concat(kept, sent)


def headers_text(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)),
                                    lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))),
                        "\n")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row a revisit: record_id, url_key, ts, source_id, status, headers
    (merged if resolved, else the revisit's own), payload_sha256 (the source's
    if resolved)."""
    named = records.withColumn("url_key", canonical_url(F.col("url")))
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    full = named.filter((F.col("kind") == "response") & usable & F.col("record_id").isNotNull())
    revisits = named.filter(F.col("kind") == "revisit")
    # Only keys, times and ids go through the as-of join; the source depends on
    # key and time alone.
    events = (full.select("url_key", "ts", F.col("record_id").alias("response"), F.lit(False).alias("asks"))
              .unionByName(revisits.filter(usable).select(
                  "url_key", "ts", F.lit(None).cast("bigint").alias("response"), F.lit(True).alias("asks")).distinct()))
    tied = (latest_earlier(events, ["url_key"], "ts", "response", "source_id")
            .filter("asks and source_id is not null").select("url_key", "ts", "source_id"))
    tied = materialize(tied, "revisits")
    source = full.select(F.col("record_id").alias("source_id"), F.col("etag").alias("s_etag"),
                         F.col("last_modified").alias("s_modified"), F.col("payload_sha256").alias("s_payload"),
                         F.col("headers").alias("s_headers")).dropDuplicates(["source_id"])
    both = revisits.join(grown(tied), ["url_key", "ts"], "left").join(source, "source_id", "left")
    same = (F.when(F.col("etag").isNotNull() & F.col("s_etag").isNotNull(), _tag(F.col("etag")) == _tag(F.col("s_etag")))
            .when(F.col("last_modified").isNotNull() & F.col("s_modified").isNotNull(),
                  F.col("last_modified") == F.col("s_modified"))
            .when(F.col("payload_sha256").isNotNull() & F.col("s_payload").isNotNull(),
                  F.col("payload_sha256") == F.col("s_payload")))
    bare = F.col("etag").isNull() & F.col("last_modified").isNull() & F.col("payload_sha256").isNull()
    status = (F.when(~usable, F.lit("no_url")).when(F.col("source_id").isNull(), F.lit("no_response"))
              .when(bare, F.lit("no_validator")).when(same, F.lit("resolved")).otherwise(F.lit("mismatch")))
    good = F.col("status") == "resolved"
    return both.withColumn("status", status).select(
        "record_id", "url_key", "ts", "source_id", "status",
        F.when(good, merged_headers(F.col("s_headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(good, F.col("s_payload")).otherwise(F.col("payload_sha256")).alias("payload_sha256"))


def page_records(pages: DataFrame, gap: int = 500) -> DataFrame:
    """Archive records made of the table of pages: a full response a page at
    time page_id, and a revisit of the same url ``gap`` later that carries the
    page's entity tag.  Other captures of the same canonical url in between
    make it a mismatch, as they changed what the revisit compares with."""
    html = F.coalesce("html", F.lit(""))
    tag = F.concat(F.lit('"'), F.substring(F.sha2(html, 256), 1, 16), F.lit('"'))
    base = pages.select("page_id", "url", tag.alias("etag"), F.sha2(html, 256).alias("sha"),
                        F.length(html).cast("string").alias("n"))
    none = F.lit(None).cast("string")
    full = base.select((F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("ts"),
                       F.lit("response").alias("kind"), "etag", none.alias("last_modified"),
                       F.col("sha").alias("payload_sha256"),
                       F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("n"),
                                    F.lit("ETag"), F.col("etag"), F.lit("Date"), F.col("page_id").cast("string"))
                       .alias("headers"))
    again = base.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") + gap).alias("ts"),
                        F.lit("revisit").alias("kind"), "etag", none.alias("last_modified"),
                        none.alias("payload_sha256"),
                        F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("ETag"), F.col("etag"),
                                     F.lit("Date"), (F.col("page_id") + gap).cast("string"),
                                     F.lit("Connection"), F.lit("close")).alias("headers"))
    return full.unionByName(again)
