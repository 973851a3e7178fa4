"""The registered queries and the pipeline over whole tables, against brute
force, and the pipeline's stages on odd rows."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as se
import corpus_pipeline
from stratakit.llm import quality, secrets, tokens
from stratakit.llm.common import materialize
from stratakit.llm.queries import ORACLES, QUERIES
from tests.conftest import SF001
from tests.llm import brute
from tests.llm.test_operators import check_packing
from tools.oracle_check import duck, table_hash

Q = se.queries()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) <= set(Q) and "pipeline" in Q and set(ORACLES) <= set(se.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, name):
    df, cur = Q[name](spark, SF001), duck(SF001).execute(ORACLES[name])
    rows, cols = [tuple(r) for r in df.collect()], [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols) and len(rows) == len(want) > 0
    assert table_hash(df.columns, rows) == table_hash(cols, want)


def test_op2(spark, texts):
    fps = {d: brute.fingerprint(t) for d, t in texts.items()}
    want = brute.classes(fps)
    got = {tuple(r)[:3] for r in Q["op2_simhash"](spark, SF001).collect()}
    assert got == {(d, f"{fps[d]:016x}", want[d]) for d in texts}


def test_op3(spark, texts):
    for r in Q["op3_secrets"](spark, SF001).collect():
        spans = brute.base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]


def test_op4(spark, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.item_hits(texts, items)
    rows = Q["op4_decontaminate"](spark, SF001).collect()
    assert len(rows) == len(texts) and any(r["contaminated"] for r in rows)
    for r in rows:
        n, hit, found, bad = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), bad)
        assert r["items_sha256"] == brute.sha(",".join(found))


def test_op5(spark, texts):
    want, start = brute.token_ids(texts, tokens.word_tokenizer_path()), 0
    for r in sorted(Q["op5_token_files"](spark, SF001).collect(), key=lambda r: r["doc_id"]):
        ids = want[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), brute.crc(ids))
        start += len(ids)


def test_op6(spark, texts):
    rows = Q["op6_quality"](spark, SF001).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute.quality(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])


def test_op8(spark, texts):
    want = brute.token_ids(texts, tokens.word_tokenizer_path())
    n = check_packing(Q["op8_packing"](spark, SF001).collect(), list(want.items()), 4096)
    assert n <= -(-sum(map(len, want.values())) // 4096) + 2


def test_op10(spark, texts):
    want = brute.base_scores(texts)
    for r in Q["op10_lattice"](spark, SF001).collect():
        held, n, known, train, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and -60 * n < r["score"] < 0


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    field = quality.fit_field(docs, spark.read.parquet(f"{SF001}/labels.parquet"))
    verdict = {d: quality.judge(t, field)[-1] for d, t in texts.items()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.kept_by_pipeline(texts, items, verdict)
    ids = brute.token_ids(want, tokens.word_tokenizer_path())
    check_packing(Q["pipeline"](spark, SF001).collect(), list(ids.items()), 4096)
    assert 0.5 * len(texts) < len(want) < len(texts)


def _stages(spark, docs):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF001), "test")
        out.append(docs)
    return out


def test_stages_on_odd_rows(spark):
    prose = " ".join(f"word{i} and" for i in range(60)) + "."
    other = " ".join(f"thing{i} of" for i in range(60)) + "."
    rows = [(1, prose, "en", "a", 9, "x", "y"), (1, prose, "en", "a", 9, "x", "y"), (2, prose, "en", "a", 9, "x", None),
            (3, None, None, None, None, None, None), (4, "", "en", "a", 0, "x", "y"), (5, "a b", "en", "a", 3, "x", "y"),
            (6, other + " token=abcdef9", "en", "a", None, None, "y"), (None, other + " more of it " + prose, "en", "b", 1, "x", "y"),
            (7, "tale " * 40_000, "en", "b", 1, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                       "n_words string, spans string")
    out = _stages(spark, docs)
    for df in out[:-1]:
        assert df.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in out[0].collect()) == [0, 1, 1, 2, 6]
    assert sorted((r["doc_id"] or 0) for r in out[1].collect()) == [0, 1, 6]
    clean = {r["doc_id"]: r for r in out[3].collect()}
    assert clean[6]["text"] == other + " [SECRET]" and clean[6]["n_chars"] == len(clean[6]["text"])
    assert clean[1]["text"] == prose and clean[1]["spans"] == "y"
    assert {r["doc_id"] for r in out[4].collect()} == {None, 1, 6}
    assert [df.count() for df in _stages(spark, docs.filter("false"))] == [0] * 5


def test_near_duplicate_stage_keeps_one_row_a_class(spark):
    one, two, three = (" ".join(f"{w}{i} of" for i in range(60)) for w in ("word", "thing", "item"))
    # id 1 stands for three texts, and the copy of its second has a larger id; two rows without an id are copies
    # of each other, one is a copy of a row with one
    rows = [(1, one, "a"), (1, two, "a"), (1, two, "b"), (2, two, "a"), (1, three, "a"), (None, three, "a"),
            (None, "quite another text", "a"), (None, "quite another text", "a"), (3, one, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF001)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in kept.collect()) == sorted(
        [(1, one), (1, two), (1, three), (0, "quite another text")])


def test_hot_groups(spark):
    """A third of all rows copies of one text, a third close to another one,
    and one secret everywhere."""
    base = [f"tok{i}" for i in range(80)]
    rows = [(i, " ".join(base)) for i in range(300)]
    rows += [(300 + i, " ".join(base[::-1][:70] + [f"own{i}"] + base[::-1][70:]) + " api_key=abcdef12") for i in range(300)]
    rows += [(600 + i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(13)
    from stratakit.llm import simhash
    fps = {d: brute.fingerprint(t) for d, t in rows}
    want = brute.classes(fps)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, run_rows=50).collect()}
    assert got == want and len(set(want.values())) < 400
    findings, ledger = secrets.scan_versions(docs)
    assert findings.filter(F.size("spans") > 0).count() == 300 and ledger.count() == 601
