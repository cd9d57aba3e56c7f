"""Physical-plan properties the design relies on (checked on the executed plan text)."""

from roleweave.operators.matching import match
from roleweave.operators.selection import cap_per_company, top_recent
from roleweave.plans import stand_ins as S
from tests.conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_match_stays_on_the_jvm_without_cross_joins(spark):
    m = match(S.profiles(spark, SF001), S.postings(spark, SF001), threshold=0.35, align_words=("gear", "rod"))
    plan = _plan(m)
    for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan, word


def test_no_text_travels_with_the_words(spark):
    """The scan for words shuffles no text: what leaves it holds an id and one word's characters."""
    from roleweave.operators.dictionary import candidates, find_words, vocabulary

    texts = spark.createDataFrame([(1, "abc")], "id int, body string")
    words = spark.createDataFrame([("ab",)], "word string")
    plan = [x.split("Subquery")[0] for x in _plan(find_words(texts, "id", "body", words)).split("\n")]
    exchanges = [x for x in plan if "Exchange" in x and "hashpartitioning" in x]
    assert exchanges and not any("body" in x or "part#" in x or "piece" in x for x in exchanges)
    scan = candidates(texts, "id", "body", vocabulary(words))
    top = [x for x in _plan(scan).split("\n") if not x.lstrip(" +-*()0123456789").startswith((":", "Subquery")) and ":  " not in x]
    assert not any(x.lstrip(" +-").startswith("Exchange") for x in top if "SinglePartition" not in x and "cell#" not in x and "word#" not in x)


def test_building_a_query_starts_no_job(spark, monkeypatch):
    """Apart from reading the tables' footers.  Streams and written runs work while they are
    built, and a capped TF-IDF vocabulary needs its ranking's size."""
    from pyspark.sql.readwriter import DataFrameReader

    from roleweave.plans import registry as R

    reads, parquet = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *a, **k: (reads.append(a), parquet(self, *a, **k))[1])
    sc = spark.sparkContext
    for name, q in R.QUERIES.items():
        if name in ("stream_first_seen", "stream_late", "run_state", "tfidf_cosine"):
            continue
        reads.clear()
        sc.setJobGroup(f"build-{name}", name)
        q(spark, SF001)
        assert len(sc.statusTracker().getJobIdsForGroup(f"build-{name}")) <= len(reads), name
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_caps_use_window_group_limit(spark):
    m = match(S.profiles(spark, SF001), S.postings(spark, SF001), threshold=0.35, align_words=("gear", "rod"))
    top = top_recent(cap_per_company(m))
    top.collect()
    assert "WindowGroupLimit" in _plan(top)


def test_scan_reads_only_needed_columns(spark):
    from roleweave.operators.filters import is_in_region
    from roleweave.sources.tables import read_table

    nation = read_table(spark, SF001, "nation").where(is_in_region("n_name", ["nation_1"])).select("n_nationkey")
    plan = nation._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<n_nationkey:int,n_name:string>" in plan


def test_no_cartesian_or_nested_loop_join_in_registered_queries(spark):
    from roleweave.plans import registry as R

    for name, q in R.QUERIES.items():
        if name in ("stream_first_seen", "stream_late", "run_state"):  # work while they are built
            continue
        plan = _plan(q(spark, SF001))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
