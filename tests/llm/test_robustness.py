"""Whole lines, long texts, clashing names, bounds and links as pages write
them; the SQL twins on rows that hold quotes and links."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratakit.llm import decontaminate, quality, quotes, secrets, simhash, urls
from stratakit.llm.common import materialize, shared_path
from stratakit.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tools.oracle_check import table_hash


def test_notices_are_read_to_the_line_end():
    at = quality.FEATURES.index("furniture")
    lines = ["word " * k + "copyright" + " more" * m for k, m in ((0, 5), (5, 0), (13, 0), (0, 47), (60, 3))] + ["no such word"]
    x = quality.line_features(lines)[0][:, at]
    assert (x[:5] > 0).all() and x[5] == 0 and x[0] > x[3] > x[4]


def test_quality_verdict_by_brute_force(spark):
    """``kept`` from the field's weights: the best of all label sequences."""
    field = quality.LineField([-2.0, 1.0, -1.0, -3.0, -2.0, -1.0, -0.5, -4.0, -1.0, 0.6], -0.7)
    rng = random.Random(4)
    lines = ["# * # | | | |", "a plain line of some more words here", "subscribe to our newsletter", "x", "same same same same"]
    texts = ["\n".join(rng.choice(lines) + " " + " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(0, 30)))
                       for _ in range(rng.randint(1, 9))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs, field).collect()}
    for i, text in enumerate(texts):
        x, counts, _ = quality.line_features(text.split("\n"))
        emit, best = field.scores(x), None
        for labels in range(1 << len(emit)):
            y = [labels >> k & 1 for k in range(len(emit))]
            s = sum(e for e, v in zip(emit, y) if v) + field.change * sum(a != b for a, b in zip(y, y[1:]))
            best = max(best or (s, y), (s, y))
        n, _, _, _, repeat = brute.quality(text)
        content = sum(c for c, v in zip(counts, best[1]) if v)
        assert kept[i] == (n >= 50 and 100 * repeat <= 50 * n and 2 * content >= n)
    assert 0 < sum(kept.values()) < 60


def test_long_texts_of_many_matches(spark):
    n = 20_000
    text = " ".join(f"token=abcdef{i} é 😀" for i in range(n)) + " end"
    quoted = "\n".join(">" * (i % 3) + f" line {i}" for i in range(n))
    df = spark.createDataFrame([(text, quoted), ("", ""), ("token=abcdef", "> a")], "t string, q string")
    rows = df.select(secrets.rule_spans(F.col("t"), secrets.RULES[0], 0).alias("s"), quotes.passages(F.col("q")).alias("p"),
                     secrets.clean_text(F.col("t"), secrets.rule_spans(F.col("t"), secrets.RULES[0], 0), "[S]").alias("c")).collect()
    assert [(s["start"], s["stop"]) for s in rows[0]["s"]] == [m.span() for m in re.finditer(r"token=abcdef\d+", text)]
    assert rows[0]["c"] == re.sub(r"token=abcdef\d+", "[S]", text) and rows[1]["c"] == "" and rows[2]["c"] == "[S]"
    assert [(p["level"], p["text"]) for p in rows[0]["p"]] == [(i % 3, f"line {i}" if i % 3 else f" line {i}") for i in range(n)]


def test_overlapping_spans_are_one_mark(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcé😀") for _ in range(3000))
    spans = sorted((a, rng.randint(0, 4), a + rng.randint(1, 90)) for a in (rng.randint(0, 2990) for _ in range(40)))
    spans = [(a, r, min(b, 3000), "k") for a, r, b in spans]
    want, at = "", 0
    for a, _, b, _ in spans:
        if a > at or a == 0 and not want:
            want += text[at:a] + "#"
        at = max(at, b)
    df = spark.createDataFrame([(text, spans)], f"t string, s {secrets.SPANS}")
    assert df.select(secrets.clean_text(F.col("t"), F.col("s"), "#")).first()[0] == want + text[at:]


def test_clashing_names(spark):
    names = ["doc_id", "text", "_sb", "_ss", "blob", "SPANS", "row", "_row", "fp", "n_hit", "items", "own0", "owntext", "_text"]
    rows = [tuple([i, t] + [f"{n}{i}" for n in names[2:]]) for i, t in enumerate(
        ["my token=abcdef123 here", "nothing at all in this one", "nothing at all in this one", None, ""])]
    docs = spark.createDataFrame(rows, ", ".join(f"{n} {'bigint' if n == 'doc_id' else 'string'}" for n in names))
    clean = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert clean[0]["text"] == "my [SECRET] here"
    one = {r["doc_id"]: r for r in simhash.one_a_class(docs).collect()}
    assert set(one) == {0, 1, 3}
    bench = spark.createDataFrame([("q", "nothing at all in"), ("z", "here")], "item_id string, text string")
    left = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench).collect()}
    cut = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench, cut_spans=True).collect()}
    assert set(left) == {3, 4} and cut[1]["text"].split() == ["this", "one"] and cut[3]["text"] is None
    for got in (clean, one, left, cut):
        for i, r in got.items():
            assert r.__fields__ == names and tuple(r)[2:] == rows[i][2:]
    many = decontaminate.matches(docs, bench, max_words=1)
    assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in many.collect()} == {
        0: (1, ["z"]), 1: (4, ["q"]), 2: (4, ["q"]), 3: (0, []), 4: (0, [])}


def test_automata_stay_under_the_bound(spark):
    rng = random.Random(2)
    items = [(f"i{k}", " ".join(f"w{rng.randint(0, 50)}" for _ in range(30))) for k in range(60)]
    rows = items + [items[0]] * 30 + [(None, None), ("e", "")]
    bench = spark.createDataFrame(rows, "item_id string, text string")
    parts = decontaminate.shards_of(bench.distinct().toDF("item", "words"), 300)
    sizes = [sum(len(brute.ITEM_WORDS.findall(r["words"] or "")) for r in p.collect()) for p in parts]
    assert sum(sizes) == 1800 and max(sizes) <= 300 and sum(p.count() for p in parts) == 62
    texts = {i: " ".join(rng.choice(items)[1].split()[a:a + 20]) + " and more" for i, a in enumerate([0, 5, 10, 3] * 5)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = brute.item_hits(texts, items)
    for r in decontaminate.matches(docs, bench, max_words=300).collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == want[r["doc_id"]][:3]


def test_ledger_of_the_pipeline(spark):
    path = shared_path(spark, "test-ledger")
    rows = [(i, f"text {i % 4} token=abcdef{i % 4}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spark.conf.set(corpus_pipeline.LEDGER, path)
    try:
        for more, blobs in ((0, 4), (0, 4), (2, 6)):
            grown = docs.unionAll(spark.createDataFrame([(100 + i, f"new {i} token=abcdef9") for i in range(more)] or rows[:1], docs.schema))
            clean = corpus_pipeline.secrets_stage(spark, grown, None).collect()
            assert all("[SECRET]" in r["text"] and "abcdef" not in r["text"] for r in clean) and len(clean) == grown.count()
            ledger = secrets.read_ledger(spark, path)
            assert ledger.count() == ledger.select("blob").distinct().count() == blobs
    finally:
        spark.conf.unset(corpus_pipeline.LEDGER)


def test_pages_write_links_their_way(spark):
    nodes = {"http://a.org": "http://a.org/", "HTTP://A.org/x/../y/./z?q=/../#f": "http://a.org/y/z?q=/../",
             "http://a.org/x/..": "http://a.org/", "http://a.org/../..": "http://a.org/", "http://a.org/x/.": "http://a.org/x/",
             "http://a.org/x.html/..y": "http://a.org/x.html/..y", "http://a.org?b": "http://a.org/?b", "none": None}
    df = spark.createDataFrame([(u,) for u in nodes], "url string")
    assert {r[0]: r[1] for r in df.select("url", urls.node_of(F.col("url"))).collect()} == nodes


def _pages():
    link = '<link rel="canonical" href="{}">'
    return [(1, "http://example.com/en/bad?a=1&b=2", ""), (2, "http://other.org/p", link.format("http://example.com/en/bad?a=1&amp;b=2")),
            (3, "http://example.com/en/", ""), (4, "http://third.org/x/y/page", link.format("../../q/./r")),
            (5, "http://third.org/q/r", link.format("http://x.net/es/1")), (6, "http://x.net/es/1", None),
            (7, "http://empty.org", link.format("http://y.net/fr/")), (8, "http://empty.org/", ""), (9, "http://z.org/&lt;", ""),
            (10, "http://www.example.com/en/ok", link.format("http://w.org/1")), (11, "http://w.org/1", link.format("http://y.net/fr/2")),
            (12, None, link.format("/a")), (13, "no url", "<html>"), (14, "http://r.org/a/b",
             '<meta http-equiv="refresh" content="0; url=//w.org/1">'), (15, "http://r.org/%", link.format("&#38;x&quot;")),
            (15, "http://r.org/%", ""), (16, "http://long.org/" + "x/" * 20_000, link.format("http://x.net/es/1"))]


def test_links_carry_blocks(spark, tmp_path):
    df = spark.createDataFrame(_pages(), "page_id bigint, url string, html string")
    got = _twin(spark, "op9_urls", {"pages": df}, tmp_path)
    verdict = {r["page_id"]: r["verdict"] for r in got}
    assert [verdict[i] for i in (2, 4, 5, 7, 8, 16)] == ["block"] * 6 and verdict[11] == verdict[14] == "allow"


def test_quotes_twin(spark, tmp_path):
    rng = random.Random(11)
    said = [f"I said {w} number {k}" for w in ("this", "that", "nothing") for k in range(3)] + ["!!", ""]
    rows = []
    for conv in range(30):
        texts = []
        for turn in range(rng.randint(1, 8)):
            lines = [rng.choice(["", "> ", ">> ", " >\t"]) + rng.choice(rng.choice(texts).split("\n") if texts and rng.random() < .6 else said)
                     for _ in range(rng.randint(1, 5))]
            texts.append("\n".join(lines))
            rows.append((conv, turn, "user", rng.choice([texts[-1], texts[-1].upper()])))
    rows += [(99, 0, "user", None), (99, 1, None, "x\n" * 30_000 + "> x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    got = _twin(spark, "op7_quotes", {"conversations": df}, tmp_path)
    assert sum(r["link"] == "quote" for r in got) > 20


def _twin(spark, name, tables, folder):
    """Rows of a query over made tables; its SQL gives the same."""
    import duckdb
    con = duckdb.connect()
    for t, df in tables.items():
        path = f"{folder}/{t}.parquet"
        df.coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    df, cur = QUERIES[name](spark, str(folder)), con.execute(ORACLES[name])
    rows, cols = df.collect(), [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols) and len(rows) == len(want) > 0
    order = [cols.index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(str(tuple(r[i] for i in order)) for r in want)
    return rows
