"""The operators against brute-force versions, on given tables and on odd rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratakit.llm import (decontaminate, lattice, packing, quality, quotes, repair, secrets, simhash, tokens, urls,
                           warc)
from stratakit.llm.common import latest_earlier, rank_in_key, shared_path
from stratakit.llm.components import connected_components
from tests.conftest import SF001
from tests.llm import brute

DOC = "doc_id bigint, text string, n_words string, _text string, spans string"
LONG = "lang wort " * 30_000 + "x" * 3_000
ODD = [None, "", "   \n\t", "one", "one two three", "É́ ́ß İ ΑΣ 😀 日本語 café x y", "a\x1cb \x00 c",
       "the same text of some more words than four", "the same text of some more words than four",
       "Password: 'hunter22!' token:token:abcdefg AKIA" + "Z" * 20 + " " + "0f" * 20 + " é secret==abcdef", LONG]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(ODD)] +
                                 [(7, ODD[7], "a", "b", "c"), (7, ODD[7], "a", "b", "c")], DOC)


@pytest.fixture(scope="module")
def texts():
    return dict(enumerate(ODD))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


@pytest.fixture(scope="module")
def given(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def empty(df):
    return df.filter("false")


# --- helpers

@pytest.mark.parametrize("bucket", [1, 3, 4096])
def test_latest_earlier(spark, bucket):
    rng = np.random.default_rng(1)
    rows = [(("a", "b")[int(rng.integers(2))], int(rng.integers(40)), int(v) if v < 50 else None)
            for v in rng.integers(0, 100, 120)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    got = latest_earlier(df, ["k"], "t", "v", "found", bucket).collect()
    assert len(got) == len(rows)
    for r in got:
        earlier = [(t, v) for k, t, v in rows if k == r["k"] and v is not None and t < r["t"]]
        assert r["found"] == (max(earlier)[1] if earlier else None)
    ranked = rank_in_key(df, ["k"], "t", "n", bucket).collect()
    assert all(r["n"] == sum(k == r["k"] and t < r["t"] for k, t, _ in rows) for r in ranked)


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    pairs += [(1000 + i, 1001 + i) for i in range(70)]            # a path
    pairs += [(2000, 2001 + i) for i in range(100)] + [(5, None), (None, 6), (7, 7)]
    got = {r[0]: r[1] for r in connected_components(
        spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()}
    nodes = {x for a, b in pairs if a is not None and b is not None and a != b for x in (a, b)}
    near = {n: set() for n in nodes}
    for a, b in pairs:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in sorted(nodes):
        todo = [n] if n not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    assert got == want
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_word_encoder(given):
    path = tokens.word_tokenizer_path()
    own = tokens.WordEncoder(path, max_words=50)                  # the cache is emptied often
    extra = ODD + ["THE.. <|ENDOFTEXT|> <|endoftext|>. H̱ a|b | <s> don't «É». x!!"]
    texts = dict(enumerate(list(given.values())[:60] + extra))
    want = brute.token_ids(texts, path)
    for d, t in texts.items():
        assert own.encode([t or ""])[0].tolist() == want[d][:-1]


# --- 2 simhash

def test_simhash_given(docs, given):
    fps = {d: brute.fingerprint(t) for d, t in given.items()}
    want = brute.classes(fps)
    for rows in (simhash.RUN_ROWS, 2):
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"])
               for r in simhash.near_duplicates(docs, run_rows=rows).collect()}
        assert got == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


def test_simhash_dense_group(spark):
    """A large group of close fingerprints, one key for most: every run length
    gives the same classes as brute force."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(400)}
    fps |= {int(x) for x in rng.integers(1 << 62, size=50)}
    nodes = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in nodes.items()],
                               "node bigint, fp bigint")
    want = brute.classes(nodes)
    for rows in (8192, 100, 7):
        edges = simhash.links(df, run_rows=rows)
        assert edges.count() < 35 * len(nodes) * (1 + len(nodes) / rows)
        assert all(bin(nodes[a] ^ nodes[b]).count("1") <= 4 for a, b in edges.collect())
        got = {r[0]: r[1] for r in connected_components(edges).collect()}
        assert {i: got.get(i, i) for i in nodes} == want


def test_simhash_odd(odd, texts, spark):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) + 2
    fps = {d: brute.fingerprint(t) for d, t in texts.items()}
    want = brute.classes(fps)
    assert all((r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", want[r["doc_id"]]) for r in got)
    assert fps[0] == 0 and want[2] == 0
    assert simhash.near_duplicates(empty(odd)).count() == 0
    rows = simhash.near_duplicates(spark.createDataFrame([(None, "a b"), (4, "a b"), (None, "c")], "doc_id int, text string"))
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in rows.collect()) == [(0, 0), (0, 4), (4, 4)]


def _flipped(fp, bits):
    """A signed fingerprint with these bits changed."""
    fp ^= sum(1 << b for b in bits)
    return fp - (1 << 64) if fp >> 63 else fp


def test_simhash_links_through_rows_without_id(spark, monkeypatch):
    # 9 - null - 5 is a chain over a row without an id; two rows without one are a class of their own
    rows = [(9, _flipped(0, ())), (None, _flipped(0, range(4))), (5, _flipped(0, range(8))),
            (None, _flipped(0, range(20, 60))), (None, _flipped(0, range(20, 58)))]
    fps = spark.createDataFrame(rows, "id bigint, fp bigint")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **k: fps)
    got = simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (0, 5), (5, 5), (9, 5)]


# --- 3 secrets

def test_secrets_odd(odd, texts):
    findings, new = secrets.scan_versions(odd)
    got = findings.select("id", secrets.spans_text(F.col("spans"), True).alias("s")).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        assert r["s"] == ",".join(f"{k}:{a}:{b}" for k, a, b in brute.base_spans(texts[r["id"]]))
    assert new.count() == len({t or "" for t in ODD})
    assert secrets.scan_versions(empty(odd))[0].count() == 0


def test_secret_ledger(spark):
    first = spark.createDataFrame([("a@1", "token=abcdef"), ("b@1", "nothing")], "doc_id string, text string")
    found, ledger = secrets.scan_versions(first)
    later = spark.createDataFrame([("a@1", "token=abcdef"), ("a@2", "token=abcdef x"), ("c@1", "token=abcdef")],
                                  "doc_id string, text string")
    again, new = secrets.scan_versions(later, ledger=ledger)
    assert new.count() == 1                                     # only the unseen blob
    assert sorted((r["id"], len(r["spans"])) for r in again.collect()) == [("a@1", 1), ("a@2", 1), ("c@1", 1)]
    _, newer = secrets.scan_versions(later, ledger=ledger, version="2")
    assert newer.count() == 2                                   # a new rule version sees all blobs
    _, none = secrets.scan_versions(later, ledger=ledger.unionByName(new))
    assert none.count() == 0


def test_redact(odd, texts):
    rows = secrets.redact(odd).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text, out, at = texts[r["doc_id"]], "", 0
        for _, a, b in brute.base_spans(text):
            if a > at or not out:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert r["text"] == (text if text is None else out + text[at:])
    assert secrets.redact(odd).columns == odd.columns


def test_redact_ledger(spark):
    first = spark.createDataFrame([(1, "token=abcdef x"), (2, "nothing")], "doc_id int, text string")
    clean, ledger = secrets.redact_versions(first)
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {1: "[SECRET] x", 2: "nothing"}
    assert ledger.count() == 2
    later = spark.createDataFrame([(1, "token=abcdef x"), (3, "token=abcdef x"), (4, "b token=fedcba1"), (5, None)],
                                  "doc_id int, text string")
    want = {1: "[SECRET] x", 3: "[SECRET] x", 4: "b [SECRET]", 5: None}
    clean, new = secrets.redact_versions(later, ledger=ledger)
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == want and new.count() == 2     # only the unseen blobs
    clean, none = secrets.redact_versions(later, ledger=ledger.unionByName(new))
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == want and none.count() == 0
    # what the ledger says of a seen blob counts: it isn't scanned again
    blank = ledger.withColumn("spans", F.array().cast(secrets.SPANS))
    assert secrets.redact(first, ledger=blank).filter("doc_id = 1").first()["text"] == "token=abcdef x"
    assert secrets.redact_versions(later, ledger=blank, version="2")[1].count() == 3


# --- 4 decontamination

def test_decontaminate_odd(odd, texts):
    bench = odd.sparkSession.createDataFrame([(1, ODD[7]), (2, "some more words than four")], "item_id int, text string")
    want = brute.item_hits(texts, [(1, ODD[7]), (2, "some more words than four")])
    kept = decontaminate.decontaminate(odd, bench)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [d for d in texts if not want[d][3]]


@pytest.mark.parametrize("max_words", [decontaminate.MAX_WORDS, 60])
def test_decontaminate(spark, docs, given, max_words):
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    items += [(900, "The and of"), (901, None), (902, ""), (903, "and"), (904, items[0][1]), (None, "is it ever"),
              (905, " ".join(items[1][1].split()[:13]))]
    df = spark.createDataFrame(items, "item_id bigint, text string")
    texts = dict(given) | {10**6: items[0][1], 10**6 + 1: None, 10**6 + 2: "", 10**6 + 3: "the AND of the and-of",
                           10**6 + 4: "x " * 2000 + items[2][1] + " y" * 500}
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = decontaminate.matches(rows, df, keep=["doc_id"], max_words=max_words).withColumn(
        "c", decontaminate.contaminated()).collect()
    want = brute.item_hits(texts, items)
    assert len(got) == len(texts)
    for r in got:
        n, hit, found, bad = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], list(r["items"]), r["c"]) == (n, hit, [i for i in found if i != "None"], bad)
        assert sum(b - a for a, b in r["spans"]) == hit
    kept = {r["doc_id"] for r in decontaminate.decontaminate(rows, df).collect()}
    assert kept == {d for d in texts if not want[d][3]}


def test_cut_spans(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = spark.createDataFrame([(1, f"Before, it. {item.upper()}! after", "q")], "doc_id int, text string, items string")
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    got = decontaminate.decontaminate(rows, bench, cut_spans=True).first()
    assert got["text"] == "Before, it. ! after" and got["items"] == "q"
    assert decontaminate.matches(rows, empty(bench)).first()["n_hit"] == 0


# --- 5 token shards

def test_token_files(spark, docs, given):
    out = shared_path(spark, "shards")
    repair.write_shards(docs.select("doc_id", "text"), out, shard_ids=20_000)
    want = brute.token_ids(given, tokens.word_tokenizer_path())
    got = {r["key"]: r for r in repair.read_documents(spark, out, keep_ids=True).collect()}
    start = 0
    for d in sorted(want):
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(want[d]), brute.crc(want[d]))
        assert got[d]["ids"] == want[d]
        start += len(want[d])
    rows = [r.asDict() for r in spark.read.parquet(out).collect()]
    assert len(rows) > 3 and sum(len(r["symbols"]) // r["width"] for r in rows) < 0.95 * start
    for r in rows:
        ids = repair.decode(r)
        assert len(ids) == r["n_ids"]
        for a in range(0, len(ids), 1777):
            assert (repair.decode_range(r, a, a + 50) == ids[a:a + 50]).all()


def test_token_files_odd(odd, texts, spark):
    got = repair.token_files(odd).collect()
    want = brute.token_ids(texts, tokens.word_tokenizer_path())
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (d, len(want[d]), brute.crc(want[d])) for d in [*texts, 7, 7])
    ends = sorted((r["start"], r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(ends))
    assert repair.token_files(empty(odd)).count() == 0
    nulls = spark.createDataFrame([(None, "b"), (None, "a"), (1, None)], "doc_id bigint, text string")
    assert [r["doc_id"] for r in repair.token_files(nulls).orderBy("start").collect()] == [None, None, 1]


def test_repair_compress():
    rng = np.random.default_rng(4)
    for ids in (np.zeros(0, int), np.array([3]), np.full(1001, 5), np.tile([1, 2, 3, 4], 500), rng.integers(0, 30, 9000)):
        symbols, rules, expansions = repair.compress(ids.astype("<u4"), 50)
        row = {"symbols": symbols.astype("<u4").tobytes(), "width": 4, "base": 50, "rules": rules.tobytes(),
               "expansions": expansions.tobytes()}
        assert (repair.decode(row) == ids).all()
        assert len(ids) < 100 or len(symbols) < len(ids)
        for a in range(0, len(ids), 97):
            assert (repair.decode_range(row, a, a + 13) == ids[a:a + 13]).all()


def _pair_counts(symbols):
    """Occurrences of each pair that don't overlap, from left to right."""
    counts, last = {}, {}
    for i, pair in enumerate(itertools.pairwise(symbols.tolist())):
        if last.get(pair) != i - 1 or pair[0] != pair[1]:
            counts[pair] = counts.get(pair, 0) + 1
            last[pair] = i
    return counts


def test_repair_goes_on_to_the_end():
    rng = np.random.default_rng(5)
    # rare symbols that only occur as one pair, behind more than 512 frequent ones; long nested repeats
    rare = np.repeat(np.arange(600, 1600, 2), 8)
    rare = np.column_stack((rare, rare + 1, rng.integers(0, 600, len(rare)))).ravel()
    for ids in (np.append(np.tile(rng.permutation(600), 30), rare), np.tile(np.arange(1024), 32), np.full(5000, 7),
                rng.integers(0, 40, 30000), np.repeat(rng.integers(0, 9, 4000), rng.integers(1, 30, 4000))):
        symbols, rules, expansions = repair.compress(ids.astype("<u4"), 1600)
        row = {"symbols": symbols.astype("<u4").tobytes(), "width": 4, "base": 1600, "rules": rules.tobytes(),
               "expansions": expansions.tobytes()}
        assert (repair.decode(row) == ids).all()
        assert max(_pair_counts(symbols).values(), default=0) < repair.MIN_COUNT
        assert len({tuple(r) for r in rules.tolist()}) == len(rules)


# --- 6 quality

def test_quality(spark, docs, given, odd, texts):
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    field = quality.fit_field(docs, labels)
    assert all(w < 0 for w in field.weights[:3])
    for df, source in ((docs, given), (odd, texts)):
        rows = quality.quality_rules(df, field, keep_text=False).collect()
        assert len(rows) == df.count()
        for r in rows:
            base = brute.quality(source[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
            assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
            assert not (r["kept"] and r["base_failed"])
    judged = quality.quality_rules(docs, field).join(labels, "doc_id").filter("not base_failed").collect()
    right = sum(bool(r["kept"]) == bool(r["quality"]) for r in judged)
    assert right >= 0.9 * len(judged)
    assert all(r["kept"] for r in judged if r["quality"] == 1)
    assert quality.quality_rules(empty(docs), field).count() == 0
    blank = quality.fit_field(docs, empty(labels))
    assert blank.decode(np.zeros((3, len(quality.FEATURES)))).all()


def test_viterbi_is_best():
    rng = np.random.default_rng(5)
    for n in (1, 2, 6):
        field = quality.LineField(rng.normal(size=len(quality.FEATURES) + 1), float(rng.normal()))
        x = rng.normal(size=(n, len(quality.FEATURES)))
        emit = field.scores(x)

        def total(path):
            return sum(e for e, p in zip(emit, path) if p) + field.change * sum(a != b for a, b in itertools.pairwise(path))
        best = max(itertools.product((0, 1), repeat=n), key=total)
        assert math.isclose(total(tuple(field.decode(x).astype(int))), total(best))
        p, changes = field._marginals(x[None], np.ones((1, n), dtype=bool))
        weights = {path: math.exp(total(path)) for path in itertools.product((0, 1), repeat=n)}
        z = sum(weights.values())
        assert np.allclose(p[0], [sum(w for path, w in weights.items() if path[i]) / z for i in range(n)])
        assert math.isclose(changes, sum(w * sum(a != b for a, b in itertools.pairwise(path)) for path, w in weights.items()) / z,
                            abs_tol=1e-9)


# --- 8 packing

def check_packing(rows, want, capacity):
    pieces = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert pieces == sorted((d, k, a, len(ids[a:a + capacity]), brute.crc(ids[a:a + capacity]))
                            for d, ids in want for k, a in enumerate(range(0, len(ids), capacity)))
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


@pytest.mark.parametrize("capacity", [4096, 100, 7])
def test_packing(docs, given, capacity):
    want = brute.token_ids(given, tokens.word_tokenizer_path())
    n = check_packing(packing.pack(docs, capacity=capacity).collect(), list(want.items()), capacity)
    total = sum(map(len, want.values()))
    assert n <= 1.05 * -(-total // capacity) + 1


def test_packing_odd(odd, texts):
    want = brute.token_ids(texts, tokens.word_tokenizer_path())
    check_packing(packing.pack(odd).collect(), [*want.items(), (7, want[7]), (7, want[7])], 4096)
    assert packing.pack(empty(odd)).count() == 0


def test_plan_is_best_fit():
    """The plan over counts opens as many sequences as best fit decreasing
    over single pieces."""
    rng = np.random.default_rng(6)
    for capacity in (10, 64):
        lengths = sorted(rng.integers(1, capacity + 1, 500).tolist(), reverse=True)
        rooms = []
        for n in lengths:
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - n)
            else:
                rooms.append(capacity - n)
        _, n = packing.plan({k: lengths.count(k) for k in set(lengths)}, capacity)
        assert n == len(rooms)


# --- 9 urls

def test_urls(spark):
    pages = spark.createDataFrame([
        (1, "https://www.Example.com/en/1"), (2, "http://example.com/en/2#x"), (3, "http://a.net/es/1"),
        (4, "http://a.net/de/1"), (5, "http://b.org/x"), (6, None), (7, "nourl"), (8, "http://example.com?q"),
        (9, "http://c.org/y"), (10, "http://d.org/z#frag"), (11, "http://xcom/"), (11, "http://xcom/")],
        "page_id bigint, url string")
    edges = spark.createDataFrame([("http://b.org/x", "http://a.net/es/1"), ("http://c.org/y", "http://b.org/x#top"),
                                   ("http://d.org/z", "http://b.org/x2"), ("http://b.org/x2", "http://a.net/fr/"),
                                   ("http://d.org/z", "https://www.example.com/en/1"), (None, "http://a.net/es/1"),
                                   ("http://a.net/de/1", "nourl")], "src string, dst string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"])
           for r in urls.judge_urls(pages, edges).collect()}
    assert got == {
        1: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        2: ("example.com", "/en/2", "example.com/en/", "block"),
        3: ("a.net", "/es/1", "net/es/", "block"), 4: ("a.net", "/de/1", None, "allow"),
        5: ("b.org", "/x", None, "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("example.com", "", None, "allow"), 9: ("c.org", "/y", None, "block"),
        10: ("d.org", "/z", None, "allow"),                      # an alias is explicitly allowed
        11: ("xcom", "/", None, "allow")}
    assert urls.judge_urls(empty(pages), empty(edges)).count() == 0
    assert urls.judge_urls(pages, None).count() == 12
    rules = spark.createDataFrame([("org", "/", "block")], urls.RULE_SCHEMA)
    assert {r["page_id"] for r in urls.judge_urls(pages, None, rules).filter("verdict = 'block'").collect()} == {5, 9, 10}


def test_html_edges(spark):
    rows = [("http://a.org/d/p?q", '<LINK rel="canonical" href="/c"> <link rel=stylesheet href="s.css">'),
            ("http://a.org/d/p", "<meta http-equiv='refresh' content='0; url=http://b.org/'>"),
            ("http://a.org", '<link href="x.html" rel=canonical>'), ("http://a.org/", None),
            (None, '<link rel="canonical" href="/c">'), ("https://a.org/", '<link rel="canonical" href="//e.org/f"/>')]
    got = urls.html_edges(spark.createDataFrame(rows, "url string, html string")).collect()
    assert sorted(tuple(r) for r in got) == [
        ("http://a.org", "http://a.org/x.html"), ("http://a.org/d/p", "http://b.org/"),
        ("http://a.org/d/p?q", "http://a.org/c"), ("https://a.org/", "https://e.org/f")]


# --- 10 lattice

def test_base_scores(docs, given, odd, texts):
    for bound in (lattice.FREQUENT_BOUND, 50):
        got = lattice.score_documents(docs, frequent_bound=bound).collect()
        want = brute.base_scores(given)
        for r in got:
            held, n, known, train, base = want[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    first = {r["doc_id"]: r["score"] for r in lattice.score_documents(docs, steps=0).collect()}
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.75 * sum(first[r["doc_id"]] for r in held)     # log10: far more probable
    rows = lattice.score_documents(odd).collect()
    assert len(rows) == len(ODD) + 2 and all(math.isfinite(r["score"]) for r in rows)
    assert lattice.score_documents(empty(odd)).count() == 0


def test_lattice_sums_all_segmentations():
    own = lattice.pieces(lattice.piece_model_path())
    rng = np.random.default_rng(7)
    weights = own.first * rng.random(own.n)
    weights /= weights.sum()
    logp = np.log(weights)
    number = {p: i for i, p in enumerate(own.texts)}

    def all_ways(text):
        if not text:
            yield ()
        for k in range(1, len(text) + 1):
            if text[:k] in number:
                for rest in all_ways(text[k:]):
                    yield (number[text[:k]], *rest)
            elif k == 1:
                for rest in all_ways(text[1:]):
                    yield (*[own.byte0 + b for b in text[0].encode()], *rest)

    words = ["the", "thention", "a", "élan", "x😀y", "\x01", "onthe"]
    got = lattice.word_scores(own, logp, words)
    uses, want = np.zeros(own.n), []
    for w in words:
        ways = [(way, math.exp(logp[list(way)].sum())) for way in all_ways(lattice.SPACE + w)]
        total = sum(p for _, p in ways)
        want.append(math.log(total))
        for way, p in ways:
            np.add.at(uses, list(way), 3 * p / total)
    assert np.allclose(got, want)
    assert np.allclose(lattice.Lattice(own, logp, words).expected(np.full(len(words), 3.0)), uses)


# --- 1 revisits, 7 quotes

def test_revisits(spark):
    none = None
    rows = [
        (1, "http://www.a.org/x/?b=2&a=1&utm_s=3#f", 10, "response", 'W/"e1"', none, "p1", {"ETag": "e1", "Content-Type": "t", "etag": "dup"}),
        (2, "https://A.org/x?a=1&b=2", 20, "response", '"e2"', none, "p2", {"X": "1", "Date": "d"}),
        (3, "http://a.org:80/x?a=1&b=2", 15, "revisit", '"e1"', none, none, {"Date": "n", "Connection": "close"}),
        (4, "http://a.org/x?a=1&b=2", 30, "revisit", '"e1"', none, none, {"Date": "n"}),
        (5, "http://a.org/x?a=1&b=2", 10, "revisit", '"e1"', none, none, none),
        (6, None, 30, "revisit", '"e1"', none, none, none), (7, "http://a.org/x?a=1&b=2", None, "revisit", none, none, none, none),
        (8, "http://a.org/x?a=1&b=2", 99, "revisit", none, none, "p2", {"x": "2", "Content-Length": "0"}),
        (8, "http://a.org/x?a=1&b=2", 99, "revisit", none, none, "p2", {"x": "2", "Content-Length": "0"}),
        (9, "http://a.org/x?a=1&b=2", 99, "revisit", none, none, none, none),
        (10, "http://a.org/y", 99, "revisit", none, "m", none, none)]
    df = spark.createDataFrame(rows, warc.RECORDS)
    got = sorted((r["record_id"], r["source_id"] or 0, r["status"]) for r in warc.resolve_revisits(df).collect())
    assert got == [(3, 1, "resolved"), (4, 2, "mismatch"), (5, 0, "no_response"), (6, 0, "no_url"), (7, 0, "no_url"),
                   (8, 2, "resolved"), (8, 2, "resolved"), (9, 2, "no_validator"), (10, 0, "no_response")]
    by = {r["record_id"]: r for r in warc.resolve_revisits(df).collect()}
    assert by[3]["headers"] == {"etag": "e1", "content-type": "t", "date": "n"}
    assert by[8]["headers"] == {"x": "2", "date": "d"} and by[8]["payload_sha256"] == "p2"
    assert warc.resolve_revisits(empty(df)).count() == 0


def test_quotes(spark):
    rows = [
        ("c", 0, "u", "Hello there.\nA second LINE of it"), ("c", 1, "a", "Answer text\nmore"),
        ("c", 2, "u", "> Answer   TEXT\nI see"), ("c", 3, "a", "other"),
        ("c", 4, "u", ">> hello there.\n>> a second line of it\n> Answer text\n> more\nFirst of all\n> unknown words\nbye"),
        ("c", 5, "a", "> a second line of it\nok"), ("d", 1, "u", "> Answer text\nx"), ("d", 1, "a", ">>>\n>"),
        (None, 1, "u", "> q"), ("e", None, "u", None), ("f", 9, "u", "> \n>\n")]
    df = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")
    got = {(r["conv_id"], r["turn"], r["role"]): r for r in quotes.link_quotes(df).collect()}
    assert len(got) == len(rows)

    def of(*key):
        r = got[key]
        return r["reply_to"], r["link"], r["n_quotes"], r["max_level"], r["text"]
    assert of("c", 0, "u") == (None, "none", 0, 0, "Hello there.\nA second LINE of it")
    assert of("c", 2, "u") == (1, "quote", 1, 1, "I see")
    assert of("c", 3, "a") == (2, "previous", 0, 0, "other")
    assert of("c", 4, "u") == (1, "quote", 3, 2, "First of all\nbye")
    assert got["c", 4, "u"]["n_linked"] >= 4 and got["c", 4, "u"]["position"] == 4
    assert of("c", 5, "a") == (0, "quote", 1, 1, "ok")
    assert of("d", 1, "u") == (None, "none", 1, 1, "x") and of("d", 1, "a")[:4] == (None, "none", 2, 3)
    assert of(None, 1, "u")[:2] == (None, "none") and got["e", None, "u"]["position"] is None
    assert quotes.link_quotes(empty(df)).count() == 0


def test_a_lean_encoder_keeps_nothing_and_halves_its_cache():
    own = tokens.WordEncoder(tokens.word_tokenizer_path(), max_words=40)
    plain = tokens.WordEncoder(tokens.word_tokenizer_path())
    for k in range(30):
        texts = [f"word{i} plain. tail{k} (odd{i})" for i in range(k, k + 12)]
        assert [x.tolist() for x in own.encode(texts)] == [x.tolist() for x in plain.encode(texts)]
        assert len(own.old) <= 200
    own.trim()
    assert len(own.known) == 1 and not own.old and own.encode(["plain."])[0].tolist() == plain.encode(["plain."])[0].tolist()
