"""The pipeline's stages and its result on a small table."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from concordia.llm import langid, minhash, secrets


def test_stages(make_docs, spark):
    rng_words = lambda i, n: " ".join(f"the word number{(i * 37 + j * 11) % 997} of this" for j in range(n))
    docs = [(i, rng_words(i, 30), "en", "ab"[i % 2]) for i in range(40)] + [(100, rng_words(0, 30), "en", "a"), (101, "123 456", "en", "a"), (102, None, "en", "a")]
    docs += [(103, rng_words(7, 30) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "en", "b"), (0, rng_words(0, 30), "en", "a")]
    df = make_docs(docs)
    kept = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == df.columns, name
        kept = spark.createDataFrame(kept.collect(), df.schema)
        ids = Counter(r["doc_id"] for r in kept.collect())
        if name == "language_id":
            assert 101 not in ids and 102 not in ids and len(ids) == 42
        elif name == "near_duplicates":
            assert 100 not in ids and 103 not in ids and ids[0] == 1 and len(ids) == 40
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()
    assert sum(r["piece"] == 0 for r in packed) == kept.count()


LONG = " ".join(f"the quick brown fox number{i % 977} jumps over a lazy dog" for i in range(20_000))


def clashing(make_docs, rows):
    """Documents with extra columns under every name that the stages use inside."""
    df = make_docs(rows)
    for c in ("lang_pred", "lang_score", "gone_id", "gone_th", "th", "id", "row", "key", "size", "root", "component_id", "first_th", "copy", "part", "target", "range", "sequence_id", "piece"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_stages_on_awkward_rows(make_docs, spark, awkward):
    rows = [r for r in awkward if r[0] != 6] + [(20 + i, f"the quick brown fox number{i} jumps over the lazy dog", "en", "a") for i in range(30)] + [(60, LONG, "en", "b")]
    df = clashing(make_docs, rows)
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == df.columns, name
        docs = spark.createDataFrame(out.collect(), df.schema)
        ids = Counter(r["doc_id"] for r in docs.collect())
        assert all(r["lang_pred"] == r["row"] == "clash" for r in docs.collect())
        if name == "language_id":
            assert not {1, 2, 3, 5}.intersection(ids) and ids[60] == 1 and ids[4] == 2
        elif name == "near_duplicates":
            assert ids[4] == 1 and ids[60] == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sum(r["piece"] == 0 for r in packed) == docs.count()
    for name, stage in corpus_pipeline.STAGES:  # each stage on the awkward rows themselves, and on none
        assert stage(spark, df, "").count() > 0, name
        assert stage(spark, df.where("false"), "").count() == 0, name


def test_unlearned_languages_go(make_docs, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = [
        "Litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
        "Все люди рождаются свободными и равными в своем достоинстве и правах", "xzq vkj wpfg qqzx jjkw vbnm zxcv qwrt plkj mnbv hgfd wqzx",
    ]
    new = make_docs([(10**9 + 4 * i, t, None, "x") for i, t in enumerate(foreign)])
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(new), "").select("doc_id").collect()}
    assert max(kept) < 10**9 and len(kept) >= 0.99 * docs.where("text rlike '[A-Za-z]{3}'").count()


def brute_masks(text):
    covered = bytearray(len(text))
    for _, a, b in secrets.all_spans(text):
        covered[a:b] = b"\1" * (b - a)
    out, inside = [], False
    for c, x in zip(text, covered, strict=True):
        if not x:
            out.append(c)
        elif not inside:
            out.append("[SECRET]")
        inside = bool(x)
    return "".join(out)


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in docs.collect()}
    kept = corpus_pipeline.language(spark, docs, sf)
    readable = docs.where("text rlike '[A-Za-z]{3}'").count()
    assert kept.count() >= 0.98 * readable
    one = {r["component_id"] for r in minhash.near_duplicates(kept).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, kept, sf).collect()} == one
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert all(r["text"] == brute_masks(texts[r["doc_id"]]) for r in corpus_pipeline.secret_scan(spark, kept, sf).collect())
    assert all(not secrets.base_spans(r["text"]) for r in corpus_pipeline.secret_scan(spark, kept, sf).collect())
    assert langid.SIZES
