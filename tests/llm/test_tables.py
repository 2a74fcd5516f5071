"""Every operator on empty tables and on awkward rows: defined results, no crash, a row per row."""

import hashlib

import pytest
from pyspark.sql import functions as F

from concordia.llm import brown, html, langid, minhash, mixing, packing, rangejoin, rollups, secrets, winnow
from concordia.llm.queries import tokenizer_path

ROW_WISE = {
    "brown": lambda d: brown.score_documents(d, passes=1, frequent=64, k=4),
    "secrets": secrets.scan_secrets,
    "mixing": mixing.mix_sources,
    "langid": langid.detect_languages,
    "minhash": minhash.near_duplicates,
    "winnow": winnow.fingerprint_documents,
}


@pytest.mark.parametrize("name", ROW_WISE)
def test_empty(make_docs, name):
    assert ROW_WISE[name](make_docs([])).collect() == []


@pytest.mark.parametrize("name", ROW_WISE)
def test_awkward_rows_each_give_a_row(with_extra, awkward, name):
    got = sorted(str(r["doc_id"]) for r in ROW_WISE[name](with_extra).collect())
    assert got == sorted(str(r[0]) for r in awkward)


def test_awkward_results(with_extra, awkward):
    lang = {r["doc_id"]: r for r in langid.detect_languages(with_extra).collect()}
    assert all(lang[i]["lang_pred"] == "und" and lang[i]["score"] == 0 for i in (1, 2, 3, 5))
    assert lang[4]["lang_pred"] != "und"
    near = minhash.near_duplicates(with_extra).collect()
    assert {r["n_shingles"] for r in near if r["doc_id"] in (1, 2, 3)} == {0}
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in near)
    mixed = mixing.mix_sources(with_extra).collect()
    assert all(r["taken"] == 0 for r in mixed if r["size"] == 0)
    marks = {r["doc_id"]: r for r in winnow.fingerprint_documents(with_extra).collect()}
    assert marks[1]["fingerprint"] == "" and marks[2]["n_chars"] == 0
    spans = secrets.scan_secrets(with_extra).collect()
    assert {r["base_sha256"] for r in spans} == {hashlib.sha256(b"").hexdigest()}
    scored = {r["doc_id"]: r for r in brown.score_documents(with_extra, passes=1, frequent=64, k=4).collect()}
    assert scored[1]["n_tokens"] == scored[2]["n_tokens"] == 1


def test_packing_empty_and_awkward(make_docs, with_extra, awkward):
    assert packing.pack_documents(make_docs([]), tokenizer_path()).collect() == []
    got = packing.pack_documents(with_extra, tokenizer_path()).collect()
    assert sorted(str(r["doc_id"]) for r in got if r["piece"] == 0) == sorted(str(r[0]) for r in awkward)
    assert [(r["length"], r["start"]) for r in got if r["doc_id"] == 1] == [(1, 0)]


def test_pages(spark):
    pages = [(1, None, None), (2, "not a url", ""), (None, "http://h.example/a", "<p>text"), (3, "http://h.example/b", "<<p>broken <a href='x"), (3, "http://h.example/b", "<<p>broken <a href='x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("tokens", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = html.extract_main_text(df).collect()
    assert len(got) == 5
    assert {r["page_id"]: r["text"] for r in got} == {1: "", 2: "", None: "text", 3: "<\nbroken"}
    assert html.extract_main_text(df.where("false")).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.01]), (1, [1.0, 0.0]), (10, [-0.0, -1.0]), (11, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cid", F.lit("clash")).withColumn("cell", F.lit(0))
    got = {}
    for r in rangejoin.near_vectors(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert got[1] == [(3, 1, True)] * 2 and got[2] == [(3, 1, False)] and got[None] == [(3, 1, True)]
    assert all(got[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 9))
    assert got[10] == [(1, 10, True)] and got[11] == [(1, 10, False)]
    assert rangejoin.near_vectors(df.where("false")).collect() == []
    assert rangejoin.near_vectors(df.where("vec_id = 3")).count() == 1


def test_rollups_are_idempotent(spark, tmp_path):
    schema = "source string, lang string, tokenizer_version string, old_tokens long, new_tokens long"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    store = rollups.Rollup(spark, str(tmp_path / "r"))
    assert store.totals().collect() == []
    assert store.commit("1", rows(("a", "en", "v", None, 10), ("a", "en", "v", None, 5), (None, None, "v", None, 1)))
    assert not store.commit("1", rows(("a", "en", "v", None, 10)))
    assert store.commit("2", rows(("a", "en", "v", 10, 30), ("a", "en", "v", 5, None), ("x", None, "v", None, None)))
    assert store.commit("3", rows())
    assert {tuple(r) for r in store.totals().collect()} == {("a", "en", "v", 1, 30), (None, None, "v", 1, 1)}
    assert store.commit("4", rows(("a", "en", "v", 30, None)))
    assert {tuple(r) for r in rollups.Rollup(spark, str(tmp_path / "r")).totals().collect()} == {(None, None, "v", 1, 1)}
    # a writer that died half-way leaves a snapshot that nobody sees and the next one overwrites
    spark.range(1).write.parquet(str(tmp_path / "r" / "v5" / "totals"))
    assert rollups.Rollup(spark, str(tmp_path / "r")).version() == 4
    assert store.commit("5", rows(("b", "en", "v", None, 2))) and store.totals().count() == 2
