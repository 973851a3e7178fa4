"""The thin queries over the given tables, and their DuckDB SQL where SQL can
express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, decontaminate, lattice, packing, quality, quotes, repair, secrets, simhash, toxicity, urls, variants,
               warc)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


UP, LOW = urls.UPPER, urls.LOWER


@query
def op1_revisits(spark, sf_dir):
    """Revisits of all pages against all full responses."""
    found = warc.resolve_revisits(warc.page_records(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", warc.headers_text(F.col("headers")))


ORACLES["op1_revisits"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strpos(url, '://') > 0 AS ok, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
k AS (SELECT page_id, h, CASE WHEN ok THEN
  regexp_replace(regexp_replace(translate(regexp_extract(rest, '^[^/?#]*'), '{UP}', '{LOW}'), '^www\\.', ''), ':(80|443)$', '')
  || regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '/+$', '') END AS place,
  list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'),
    lambda f: f <> '' AND NOT regexp_matches(f, '{warc.TRACKING}'))) AS fields FROM p),
f AS (SELECT page_id, place || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END AS url_key,
  sha256(h) AS sha, '"' || substr(sha256(h), 1, 16) || '"' AS etag, length(h) AS n FROM k),
r AS (SELECT page_id, page_id + 500 AS ts, url_key, etag FROM f),
j AS (SELECT r.*, s.page_id AS source, s.etag AS s_etag, s.sha, s.n FROM r ASOF LEFT JOIN f s ON r.url_key = s.url_key AND r.ts > s.page_id)
SELECT 2 * page_id + 1 AS record_id, url_key, ts, 2 * source AS source_id,
  CASE WHEN url_key IS NULL THEN 'no_url' WHEN source IS NULL THEN 'no_response' WHEN etag = s_etag THEN 'resolved' ELSE 'mismatch' END AS status,
  CASE WHEN source IS NOT NULL AND etag = s_etag
    THEN 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || etag
    ELSE 'Connection: close' || chr(10) || 'Content-Length: 0' || chr(10) || 'Date: ' || ts || chr(10) || 'ETag: ' || etag END AS headers,
  CASE WHEN source IS NOT NULL AND etag = s_etag THEN sha END AS payload_sha256
FROM j"""


@query
def op2_simhash(spark, sf_dir):
    """SimHash classes of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_secrets(spark, sf_dir):
    """Secrets of all documents through a ledger that starts empty."""
    findings, _ = secrets.scan_versions(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    return findings.select(
        F.col("id").alias("doc_id"), secrets.count_of(spans, "assign").alias("n_assign"),
        secrets.count_of(spans, "access").alias("n_access"), secrets.count_of(spans, "hex").alias("n_hex"),
        F.sha2(secrets.spans_text(spans, base_only=True), 256).alias("base_sha256"),
        secrets.spans_text(spans).alias("spans"))


# RE2 reads the same patterns; the matches' places are running sums of the
# pieces between matches and the matches themselves.
def _spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind,
       list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS b,
       length(whole[i]) AS n
FROM (SELECT doc_id, whole, tested, gaps, unnest(range(1, len(whole) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}', 0) AS whole, regexp_extract_all(t, '{quoted}', {group}) AS tested,
                   string_split_regex(t, '{quoted}') AS gaps FROM docs))
WHERE length(tested[i]) >= {least}"""


ORACLES["op3_secrets"] = (
    "WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),\nfound AS (\n"
    + "\nUNION ALL\n".join(_spans_sql(r.kind, i, r.pattern.replace(r"\x20", " "), r.group, r.least)
                          for i, r in enumerate(secrets.RULES))
    + """),
lists AS (SELECT doc_id, string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + n AS BIGINT), ',' ORDER BY b, rank) AS spans,
                 string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + n AS BIGINT), ',' ORDER BY b, rank) FILTER (rank < 3) AS base,
                 count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                 count(*) FILTER (kind = 'hex') AS n_hex FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN lists USING (doc_id)""")


@query
def op4_decontaminate(spark, sf_dir):
    """Hits of all documents against all benchmark items."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                  keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        decontaminate.items_digest().alias("items_sha256"),
                        decontaminate.contaminated().alias("contaminated"))


ORACLES["op4_decontaminate"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(13, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""


@query
def op5_token_files(spark, sf_dir):
    """All documents' ids through grammar-compressed shards."""
    return repair.token_files(table(spark, sf_dir, "documents"))


@query
def op6_quality(spark, sf_dir):
    """Quality of all documents; the line field is fitted on labelled ones."""
    docs = table(spark, sf_dir, "documents")
    field = quality.fit_field(docs, table(spark, sf_dir, "labels"))
    return quality.quality_rules(docs.select("doc_id", "text"), field, keep_text=False).drop("text")


@query
def op8_packing(spark, sf_dir):
    """All documents' pieces in sequences of 4096 ids."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op7_quotes(spark, sf_dir):
    """All conversations' messages in reply order, without quotes."""
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


ORACLES["op7_quotes"] = """
WITH m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
l AS (SELECT rid, conv_id, turn, i, lines[i] AS line, regexp_extract(lines[i], '^([ \\t]*>)+') AS prefix
      FROM (SELECT *, string_split_regex(t, '\\r?\\n') AS lines, unnest(range(1, len(string_split_regex(t, '\\r?\\n')) + 1)) AS i FROM m)),
b AS (SELECT rid, conv_id, turn, i, length(regexp_replace(prefix, '[^>]', '', 'g')) AS level,
      regexp_replace(line, '^([ \\t]*>)+[ \\t]?', '') AS body FROM l),
g AS (SELECT *, i - row_number() OVER (PARTITION BY rid, level ORDER BY i) AS run FROM b),
p AS (SELECT rid, conv_id, turn, level, run, min(i) AS i, string_agg(body, chr(10) ORDER BY i) AS text FROM g GROUP BY ALL),
parts AS (SELECT rid, conv_id, turn, level, unnest(list_concat([text], string_split(text, chr(10)))) AS part FROM p),
u AS (SELECT DISTINCT rid, conv_id, turn, level, trim(regexp_replace(lower(part), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS unit FROM parts
      WHERE regexp_matches(part, '[\\p{L}\\p{N}]') AND conv_id IS NOT NULL AND turn IS NOT NULL),
q AS (SELECT conv_id, turn, unit, min(level) AS level FROM u WHERE level > 0 GROUP BY ALL),
own AS (SELECT DISTINCT conv_id, turn, unit FROM u WHERE level = 0),
v AS (SELECT conv_id, turn, level, from_turn, count(*) AS n FROM (
        SELECT q.conv_id, q.turn, q.unit, q.level, max(own.turn) AS from_turn FROM q JOIN own
        ON q.conv_id = own.conv_id AND q.unit = own.unit AND own.turn < q.turn GROUP BY ALL) GROUP BY ALL),
r AS (SELECT conv_id, turn, arg_max(from_turn, (-level, n, from_turn)) AS quoted, sum(n) AS n_linked FROM v GROUP BY ALL),
o AS (SELECT conv_id, turn, lag(turn) OVER w AS previous, row_number() OVER w - 1 AS position
      FROM (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT rid, count(*) FILTER (level > 0) AS n_quotes, max(level) AS max_level,
      trim(coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (level = 0), '')) AS text FROM p GROUP BY rid)
SELECT m.conv_id, m.turn, m.role, o.position, coalesce(quoted, previous) AS reply_to,
  CASE WHEN quoted IS NOT NULL THEN 'quote' WHEN previous IS NOT NULL THEN 'previous' ELSE 'none' END AS link,
  n_quotes, CAST(max_level AS INTEGER) AS max_level, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, x.text
FROM m JOIN x USING (rid) LEFT JOIN o ON m.conv_id = o.conv_id AND m.turn = o.turn
LEFT JOIN r ON m.conv_id = r.conv_id AND m.turn = r.turn"""


@query
def op9_urls(spark, sf_dir):
    """All pages' urls under the rules, aliases by their html's links."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.html_edges(pages))


_HOST = f"translate(regexp_extract(rest, '^[^/?#]*'), '{UP}', '{LOW}')"
_SOME = "coalesce(nullif(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), ''), '/')"
_PATH = f"""(CASE WHEN regexp_matches({_SOME}, '/\\.\\.?(/|$)')
    THEN list_reduce(list_concat([''], string_split({_SOME}, '/')[2:]),
           lambda a, s: CASE s WHEN '.' THEN a WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || s END)
         || CASE WHEN regexp_matches({_SOME}, '/\\.\\.?$') THEN '/' ELSE '' END
    ELSE {_SOME} END)"""
_PLAIN = "href0"
for _name, _mark in urls.ENTITIES:
    _PLAIN = f"""regexp_replace({_PLAIN}, '{_name}', '{_mark.replace("'", "''")}', 'g')"""
_PLACE = f"""{_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  CASE WHEN ok THEN translate(string_split(url, '://')[1], '{UP}', '{LOW}') || '://' || {_HOST} || {_PATH} || regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1) END AS node"""
_REST = "strpos(url, '://') > 0 AS ok, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest"
ORACLES["op9_urls"] = f"""
WITH RECURSIVE rules(rh, rp, rv) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)}),
pages0 AS (SELECT page_id, url, html, {_REST} FROM pages),
pg AS (SELECT page_id, url, html, {_PLACE} FROM pages0),
hrefs AS (SELECT url, host, path, {_PLAIN} AS href FROM (SELECT url, host, path, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?is)<link\\s[^>]*>'), lambda t: regexp_matches(t, '(?is)\\srel\\s*=\\s*["'']?canonical["''\\s/>]')),
      lambda t: regexp_extract(t, '(?is)\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\\s[^>]*>'), lambda t: regexp_matches(t, '(?is)\\shttp-equiv\\s*=\\s*["'']?refresh["''\\s/>]')),
      lambda t: regexp_extract(t, '(?is)[;\\s]url\\s*=\\s*["'']?([^"''\\s>]+)', 1)))) AS href0 FROM pg WHERE url IS NOT NULL)),
tied AS (SELECT url AS src, CASE WHEN contains(href, '://') THEN href
    WHEN starts_with(href, '//') THEN string_split(url, '://')[1] || ':' || href
    WHEN starts_with(href, '/') THEN string_split(url, '://')[1] || '://' || host || href
    ELSE string_split(url, '://')[1] || '://' || host || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || href END AS dst
  FROM hrefs WHERE href <> ''),
ends AS (SELECT DISTINCT url FROM (SELECT src AS url FROM tied UNION ALL SELECT dst FROM tied)),
nodes AS (SELECT url, {_PLACE} FROM (SELECT url, {_REST} FROM ends)),
e AS (SELECT a.node AS a, b.node AS b FROM tied JOIN nodes a ON a.url = src JOIN nodes b ON b.url = dst
      WHERE a.node IS NOT NULL AND b.node IS NOT NULL AND a.node <> b.node),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM e2 UNION SELECT r.a, e2.b FROM reach r JOIN e2 ON r.b = e2.a),
places AS (SELECT DISTINCT host, path FROM pg UNION SELECT DISTINCT host, path FROM nodes),
fit AS (SELECT host, path, arg_max(rh || rp, (length(rh || rp), length(rh))) AS rule, arg_max(rv, (length(rh || rp), length(rh))) AS rv
        FROM places JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
decided AS (SELECT component, min(fit.rv) AS av FROM comp JOIN (SELECT DISTINCT node, host, path FROM nodes) n USING (node)
            JOIN fit USING (host, path) GROUP BY component)
SELECT page_id, pg.host, pg.path, fit.rule, coalesce(fit.rv, av, 'allow') AS verdict, comp.component
FROM pg LEFT JOIN fit ON fit.host = pg.host AND fit.path = pg.path
LEFT JOIN comp ON comp.node = pg.node LEFT JOIN decided ON decided.component = comp.component"""


@query
def op10_lattice(spark, sf_dir):
    """Scores of all documents, learned from the training ones."""
    return lattice.score_documents(table(spark, sf_dir, "documents"))


@query
def op11_toxicity(spark, sf_dir):
    """Scores of all documents; models and curve learn from labels that are
    not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op12_collocations(spark, sf_dir):
    """The first phrases of each language."""
    return collocations.mine(table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = f"""
WITH p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UP}', '{LOW}'),
                                                                              '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents)),
f AS (SELECT lang, k, phrase, count(*) AS c
      FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) s(k) WHERE len(w) >= k)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
g AS (SELECT * FROM f WHERE c >= 100),
inside AS (SELECT lang, phrase, max(c) AS c
           FROM (SELECT lang, c, array_to_string(w[i:i + s - 1], ' ') AS phrase
                 FROM (SELECT lang, c, w, s, unnest(range(1, k - s + 2)) AS i
                       FROM (SELECT lang, c, k, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS s FROM g WHERE k > 2))) GROUP BY ALL),
cut AS (SELECT lang, phrase, c AS a, j, array_to_string(w[1:j], ' ') AS le, array_to_string(w[j + 1:], ' ') AS ri
        FROM (SELECT g.lang, g.phrase, g.c, string_split(g.phrase, ' ') AS w, unnest(range(1, k)) AS j FROM g
              LEFT JOIN inside i ON g.lang = i.lang AND g.phrase = i.phrase WHERE k > 1 AND (i.c IS NULL OR 100 * i.c < 100 * g.c))),
s AS (SELECT cut.lang, cut.phrase, a, j, x.c AS l, y.c AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.c AS HUGEINT) * y.c) AS BIGINT) AS score
      FROM cut JOIN g x ON x.lang = cut.lang AND x.phrase = le JOIN g y ON y.lang = cut.lang AND y.phrase = ri JOIN n ON n.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
QUALIFY rank <= 2000"""


@query
def op13_variants(spark, sf_dir):
    """All words with their near words, forms and roots."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


ORACLES["op13_variants"] = f"""
WITH RECURSIVE crc(t) AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], range(8)),
    lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))),
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), '{UP}', '{LOW}'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, k, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(
    list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CAST(unicode(c) AS BIGINT)),
    lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, crc),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 31 = 0
    THEN run[1:CAST(h % length(run) AS INT)] || run[CAST(h % length(run) AS INT) + 2:] ELSE run END AS word FROM h)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
masks AS (SELECT word, n, word[1:i - 1] || '_' || word[i + 1:] AS m FROM places),
cut AS (SELECT DISTINCT word, n, word[1:i - 1] || word[i + 1:] AS short FROM places),
one AS (SELECT cut.word AS a, cut.n AS a_n, w.word AS b, w.n AS b_n FROM cut JOIN words w ON w.word = short),
near AS (SELECT x.word, y.word AS other, y.n AS other_n FROM masks x JOIN masks y ON x.m = y.m AND x.word <> y.word
         UNION ALL SELECT a, b, b_n FROM one UNION ALL SELECT b, a, a_n FROM one),
best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
         QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
             CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
up(word, root, depth) AS (SELECT word, word, 0 FROM f
    UNION ALL SELECT up.word, f.form, depth + 1 FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, form, arg_max(root, depth) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n
FROM f JOIN up ON up.word = f.word GROUP BY f.word, form"""
