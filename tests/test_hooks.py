"""User hooks on many rows."""

from __future__ import annotations

from contest_analytics.functions import hooks


def test_expand_rows_in_small_parts(spark):
    """Rows of one Arrow batch reach the function a few hundred at a time, each once."""

    def sizes(pdf):
        assert list(pdf.index) == list(range(len(pdf)))
        return pdf.assign(seen=len(pdf)).loc[pdf.index.repeat(2)]

    rows = spark.range(0, 1500, 1, 1)
    got = hooks.expand_rows(rows, sizes, "id long, seen long").collect()
    assert sorted(r.id for r in got) == sorted([*range(1500)] * 2)
    assert max(r.seen for r in got) <= hooks.EXPAND_ROWS
    assert hooks.expand_rows(rows.limit(0), sizes, "id long, seen long").count() == 0
