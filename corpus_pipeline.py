"""A training-data pipeline over ``documents``: language, near duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``.  All but the last return the columns of
``documents``.  Rows are never lost but by a stage's decision.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roleweave.llm import bpe, language, mixing, secrets, simhash
from roleweave.llm.common import id_hash, ready, table
from roleweave.llm.queries import tokenizer_path
from roleweave.session import checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose shortest code is longer than its own bytes is no text of a learned language.
MOST_BITS_PER_BYTE = 8.0
#: Beyond this quantile of a language's own bits a byte, at so many times its distance from
#: the median (or half the median, where texts hardly differ), a text is of no learned
#: language; a text may have so many bits more, whatever its length: a name or a number.
HIGH, TIMES, EXTRA_BITS, SKETCH = 0.95, 5.0, 96.0, 10_000


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in docs.columns]


def language_fences(found: DataFrame) -> dict:
    """The most bits a byte of a long text, by language, from ``lang_pred``, ``given`` and ``bits_per_byte``.

    Each language's own distribution decides: that of the documents labelled with it and
    predicted as it, by mergeable sketches, so texts of a language that wasn't learned
    don't widen the fence of the one they fall to.
    """
    sketch = F.percentile_approx("bits_per_byte", [0.5, HIGH], SKETCH)
    return {r["lang_pred"]: r["q"][0] + max(TIMES * (r["q"][1] - r["q"][0]), r["q"][0] / 2) for r in found.where("lang_pred = given").groupBy("lang_pred").agg(sketch.alias("q")).collect()}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null texts too) and those that no learned language
    codes about as well as its own texts; ``lang`` becomes the predicted language.

    Learns from documents whose id hash mod 4 is not 2, like ``op2``.  Where no language
    can be learned, nothing is known and all documents stay as they are.
    """
    ready(spark)
    held_out = F.coalesce(id_hash("doc_id") % 4 == 2, F.lit(False))
    model = language.train(docs.where(~held_out))
    if not model.languages:
        return docs.select(*_columns(docs))
    # two narrow passes: the first one's sketches are small, and whole texts aren't kept
    fences = language_fences(language.identify(docs, model, carry=(docs["lang"].cast("string").alias("given"),)))
    carried = tuple(docs[c].alias(f"kept_{c}") for c in _columns(docs) if c not in ("doc_id",))
    found = language.identify(docs, model, carry=carried)
    fence = F.lit(MOST_BITS_PER_BYTE)
    for name, most in fences.items():
        fence = F.when(F.col("lang_pred") == name, F.lit(most) + F.lit(EXTRA_BITS) / F.octet_length("kept_text")).otherwise(fence)
    good = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("bits_per_byte") <= F.least(fence, F.lit(MOST_BITS_PER_BYTE))))
    return good.select(*[F.col("doc_id") if c == "doc_id" else F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"kept_{c}").alias(c) for c in _columns(docs)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each SimHash component, the document with the least id, once.

    Rows with a null id can't be named as a group's document and stay as they are.
    """
    ready(spark)
    found = simhash.near_duplicates(docs)
    chosen = found.where("doc_id = component_id").select("doc_id").distinct()
    columns = _columns(docs)
    # one row of an id: the join leaves equal ids in one partition, so no further shuffle
    kept = docs.select(*columns).join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*columns).union(docs.select(*columns).where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each live-looking secret by its kind in brackets; documents stay.

    Values that several owners or many documents hold are published examples and stay as they are.  Rows
    whose id is null or repeated are matched by id and text, so each gets its own spans.
    """
    ready(spark)
    columns = _columns(docs)
    # rows without a candidate go straight on; only the few others take part in the join
    holds = F.coalesce(secrets.holds_candidate(docs["text"]), F.lit(False))
    clean = docs.select(*columns).where(~holds)
    keyed = docs.select(*columns).where(holds).withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = secrets.find_secrets(keyed, id_col="row_key").where(F.size("live") > 0).select(F.col("doc_id").alias("row_key"), "live").dropDuplicates(["row_key"])
    joined = keyed.join(found, "row_key", "left")
    text = F.when(F.col("live").isNull(), F.col("text")).otherwise(mask("text", "live"))
    masked = joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in columns])
    if "n_chars" in columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.union(masked)


def mask(text: str, spans: str):
    """The text with each span replaced by ``[kind]``; of overlapping spans the first, then the longest, is replaced."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, x):
        new = F.struct(
            F.concat(acc["out"], F.substring(F.col(text), acc["at"].cast("int") + 1, (x["start"] - acc["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]")).alias("out"),
            x["end"].alias("at"),
        )
        return F.when(x["start"] >= acc["at"], new).otherwise(acc)

    return F.aggregate(F.col(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"].cast("int") + 1, F.length(F.col(text)))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that expected domain tokens match the production targets.

    Documents that are likeliest of the anchor, the clean domain, are never dropped.
    """
    ready(spark)
    columns = _columns(docs)
    model = mixing.train(docs, mixing.domains(table(spark, sf_dir, "labels")))
    carried = tuple(docs[c].alias(f"kept_{c}") for c in columns)
    mixed = mixing.mix(docs, model, mixing.TARGETS, mixing.ANCHOR, carry=carried).where("copies > 0")
    return mixed.select(*[F.col(f"kept_{c}").alias(c) for c in columns], F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(*columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``round_trip_sha256`` of the decoded text."""
    ready(spark)
    coded = bpe.encode_and_decode(docs, tokenizer_path())
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("round_trip_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: The stages learn models and hash by XXH64, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written under ``spark.checkpoint.dir`` and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
