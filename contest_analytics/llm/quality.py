"""Quality of documents by supervised subword embeddings (see ``subword``)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contest_analytics.llm import subword
from contest_analytics.llm.common import fold

#: Most labelled rows of a class that the model is fitted on.
PER_CLASS = 1500
#: Rows with a lower score are rejected.
LEAST = 0.3


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    per_class: int = PER_CLASS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> subword.Model:
    """A model of ``label`` (0 or 1) from rows whose crc32(id) mod 5 is not 0."""
    known = labels.select(F.col("doc_id").alias(id_col), F.col(label).cast("int").alias("_label")).filter(
        F.col(id_col).isNotNull() & F.col("_label").isin(0, 1) & (fold(id_col) != 0)
    )
    sizes = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = np.array([sizes.get(c, 0) + 1.0 for c in (0, 1)])
    chosen = subword.sample(known, "_label", per_class, 2, id_col)
    rows = subword.featurized(docs, chosen, "_label", 2 * per_class, id_col, text_col, False, True)
    return subword.train(rows, ["0", "1"], prior / prior.sum(), lower=False, repeats=True)


def score(model: subword.Model, text: Column) -> Column:
    """Struct with ``score``, the probability of label 1."""
    one = model.classes.index("1")

    def finish(_: str | None, logits: np.ndarray) -> tuple:
        return (float(model.probabilities(logits)[one]),)

    return subword.score_udf(model, finish, "score double")(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row.

    Defined cases: null and empty texts get the score of a document without features (from
    the labels' shares alone); null ids count as held out; without labels every score
    follows even shares; repeated rows stay; other columns are ignored; an empty table
    gives no rows.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    scored = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (fold(id_col) == 0).alias("held_out"),
        score(model, F.col(text_col).cast("string"))["score"].alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= LEAST).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the model rejects."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    return docs.filter(score(model, F.col(text_col).cast("string"))["score"] >= LEAST)
