"""Toxicity: subword-bag embeddings averaged into a linear softmax (see :mod:`roleweave.llm.subwords`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleweave.llm import subwords

#: A text is called toxic from this score on.
THRESHOLD = 0.5


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = subwords.TEXTS_PER_CLASS) -> subwords.SubwordModel:
    """Fits on the labelled documents of ``labels`` (0 or 1; others and nulls teach nothing).

    An id with several labels teaches each of them once.
    """
    marks = labels.select(labels[id_col].alias("mark_id"), labels[label_col].cast("int").alias("label")).where("label in (0, 1)").distinct()
    return subwords.train(documents, marks, id_col, text_col, per_class)


def score(documents: DataFrame, model: subwords.SubwordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``score`` (probability of label 1), ``predicted`` (1 from 0.5 on, else 0).

    Whole texts are scored; null and empty texts have the score of no words.  If label 1
    was never met the score is 0, if it alone was met 1.  A narrow pass without a shuffle.
    """
    scored = subwords.posteriors(documents, model, (documents[id_col].alias("doc_id"),), text_col)
    value = F.element_at("shares", model.classes.index(1) + 1) if 1 in model.classes else F.lit(0.0)
    return scored.select("doc_id", value.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
