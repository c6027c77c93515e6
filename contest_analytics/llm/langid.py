"""Language of documents by averaged subword embeddings, with calibrated rejection.

The model is that of ``subword`` on lower-cased words. Its probabilities are calibrated by
a temperature on rows kept out of the fit; a prediction whose calibrated probability is
under ``SURE`` is marked as rejected. Texts without a letter have no language.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contest_analytics.llm import subword
from contest_analytics.llm.common import fold

#: Most rows of a language, and most languages, that the model is fitted on.
PER_LANGUAGE, LANGUAGES = 500, 200
UNKNOWN = "und"
#: Predictions with a lower calibrated probability are rejected.
SURE = 0.5


def fit(
    docs: DataFrame,
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    languages: int = LANGUAGES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> subword.Model:
    """A model of ``lang_col`` from rows that have one and whose crc32(id) mod 3 is not 1."""
    known = docs.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (fold(id_col, 3) != 1)).select(
        id_col, F.col(lang_col).cast("string").alias("_label")
    )
    chosen = subword.sample(known, "_label", per_language, languages, id_col)
    rows = subword.featurized(docs, chosen, "_label", per_language * languages, id_col, text_col, True, False)
    rows = [r for r in rows if len(r[1])]
    classes = sorted({label for label, _, _ in rows})
    even = np.full(len(classes), 1 / max(len(classes), 1))
    return subword.train(rows, classes, even, lower=True, repeats=False)


def predict(model: subword.Model, text: Column) -> Column:
    """Struct with ``lang``, ``score`` (calibrated) and ``rejected``."""

    def finish(value: str | None, logits: np.ndarray) -> tuple:
        if not value or not model.classes or not any(map(str.isalpha, value)):
            return UNKNOWN, 0.0, True
        p = model.probabilities(logits)
        best = int(p.argmax())
        return model.classes[best], float(p[best]), bool(p[best] < SURE)

    return subword.score_udf(model, finish, "lang string, score double, rejected boolean")(text)


def identify(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``rejected`` of every row.

    Defined cases: null texts and texts without a letter are ``und`` with score 0 and
    rejected, and so is everything if no row has a language to learn; null ids are neither
    learned from nor held out; equal probabilities go to the first language by name;
    repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    model = fit(docs, lang_col, id_col=id_col, text_col=text_col)
    found = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (fold(id_col, 3) == 1).alias("held_out"),
        predict(model, F.col(text_col).cast("string")).alias("_p"),
    )
    return found.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), "_p.score", "_p.rejected")


def keep(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose language is unknown or rejected."""
    model = fit(docs, lang_col, id_col=id_col, text_col=text_col)
    return docs.filter(~predict(model, F.col(text_col).cast("string"))["rejected"])
