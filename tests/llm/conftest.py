from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Builds a documents-like table from (doc_id, text) pairs, with clashing extra columns."""

    def build(rows, **extra):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(i, t, extra.get("lang"), "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return build


#: Nulls, blanks, a long text, ties and repeated rows.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "one two three four five six seven"),
    (5, "one two three four five six seven"),
    (None, "no id here at all, none"),
    (None, None),
    (6, "long " * 30_000),
    (7, "\U0001f642 é ñ ß 中文 \x1c x"),
]


@pytest.fixture(scope="session")
def odd(docs_of):
    frame = docs_of(ODD)
    for name in ("fp", "key", "root", "label", "slot", "part", "kind", "score", "nth", "_key", "_spans", "spans", "_row", "_score"):
        frame = frame.selectExpr("*", f"source as {name}")
    return frame
