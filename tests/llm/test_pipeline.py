import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from helpers import AWKWARD, corpus, documents
from roleweave.llm import queries
from roleweave.session import checkpoint_dir

SF = "/root/testdata/sf0.001"


def test_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names) and queries.QUERIES.keys() <= names.keys()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "secret_scan", "mixing", "bpe"]


@pytest.mark.parametrize("clashes", [False, True])
def test_stages_on_awkward_rows(spark, clashes):
    checkpoint_dir(spark)
    secret = "password=mine12345678"
    rows = corpus(40) + [(60, corpus(40)[7][1], "bb", "s9"), (61, f"the inon haer {secret} the er inha", "aa", "s7")] + AWKWARD
    docs = documents(spark, rows, clashes)
    columns = list(corpus_pipeline.COLUMNS)
    one = corpus_pipeline.identify_language(spark, docs, SF)
    assert one.columns == columns
    kept = [r.doc_id for r in one.collect()]
    assert not {900, 901, 902, 903} & set(kept) and {904, 61, None} | set(range(40)) <= set(kept)
    two = corpus_pipeline.drop_near_duplicates(spark, one, SF)
    assert two.columns == columns
    ids = [r.doc_id for r in two.collect()]
    assert ids.count(904) == 1 and ids.count(None) == 1 and 7 in ids and 60 not in ids and len(ids) == len(set(ids))
    three = corpus_pipeline.mask_secrets(spark, two, SF)
    texts = {r.doc_id: r for r in three.collect()}
    assert three.columns == columns and len(texts) == len(ids)
    assert texts[61].text == "the inon haer [assign] the er inha" and texts[61].n_chars == len(texts[61].text)
    four = corpus_pipeline.mix_sources(spark, three, SF)
    assert four.columns == columns and four.count() > 0
    five = corpus_pipeline.tokenize(spark, four, SF)
    assert five.count() == four.count() and five.where("n_tokens * 4 <> octet_length(ids)").count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_no_rows(spark, stage):
    checkpoint_dir(spark)
    assert stage(spark, documents(spark, [], clashes=False), SF).count() == 0


def test_mask(spark):
    df = spark.createDataFrame([(1, "é🙂abcdef", [("x", 1, 3), ("y", 2, 4), ("z", 5, 6)]), (2, "ab", [])], "i int, text string, live array<struct<kind:string,start:bigint,end:bigint>>")
    assert [r[0] for r in df.orderBy("i").select(corpus_pipeline.mask("text", "live")).collect()] == ["é[x]bc[z]ef", "ab"]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < out.count() and out.join(rows, "doc_id", "left_anti").count() == 0


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if re.match(r"op\d", n) and n not in ("op5_top_k", "op11_chat_format")])
def test_queries_answer_every_row(spark, name):
    table, key = ("pages", "page_id") if name in ("op1_url_filter", "op7_html_text") else ("documents", "doc_id")
    given = spark.read.parquet(f"{SF}/{table}.parquet").select(key)
    got = queries.QUERIES[name](spark, SF).select(F.col(key))
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in given.collect())


def test_texts_of_no_learned_language_are_rejected(spark):
    checkpoint_dir(spark)
    rng = random.Random(4)
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 300")
    learned = [tuple(r) for r in given.where("lang in ('en', 'de', 'es')").select("doc_id", "text", "lang", "source").limit(300).collect()]
    foreign = [(10_000_000 + i, r.text, None, "s") for i, r in enumerate(given.where("lang = 'fr'").select("text").limit(20).collect())]
    salad = [(20_000_000 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(60)), None, "s") for i in range(10)]
    short = [(30_000_000 + i, " ".join(text.split()[:n]), lang, "s") for i, (n, (_, text, lang, _)) in enumerate(zip([2, 5, 9] * 20, learned))]
    got = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, documents(spark, learned + foreign + salad + short, clashes=False), SF).collect()}
    assert sum(r[0] in got for r in foreign) <= 1 and not any(r[0] in got for r in salad)
    assert sum(r[0] in got for r in learned) >= 0.97 * len(learned)
    assert sum(r[0] in got for r in short) >= 0.95 * len(short)
