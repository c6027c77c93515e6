"""Best-two-fit packing of tokenized documents into sequences of bounded length.

A document's ids end with a closing id; only documents longer than a sequence are cut.
What matters for packing is a piece's length alone, so the plan is made on the histogram of
lengths, which never has more entries than a sequence has places:

* a sequence is filled greedily: the longest piece left, then again and again the longest
  that still fits;
* if a gap stays, its smallest piece is taken out and the two unpacked lengths are put
  in that fill the wider gap best, if they fill it better;
* the composition found is repeated as often as the counts allow, so the number of
  compositions is bounded by the number of lengths, not by the data.

Pieces then find their place by their rank among the pieces of their length: rank within
the task, plus the number in earlier tasks. A length that a third of all rows share
is no special case, and texts are read once and never shuffled.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contest_analytics.llm.bpe import Words
from contest_analytics.llm.common import saved, text_rows

#: Ranks of one length stay under this.
MANY = 1 << 44


@lru_cache(2)
def tokenizer(path: str) -> Words:
    """Ids by the ``tokenizers`` library, word by word with a cache."""
    model = Tokenizer.from_file(path).model
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    return Words(spec, lambda word: [t.id for t in model.tokenize(word)])


def pieces(
    docs: DataFrame,
    path: str,
    size: int = 2048,
    closing: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``) of every piece,
    with its task ``part`` and ``nth``, its number among the task's pieces of its length."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = tokenizer(path), TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        end = np.array([closing], "<u4").tobytes()
        for rows in text_rows(batches):
            out: list[tuple] = []
            kept: list[np.ndarray] = []
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                raw = words.ids(text) + end
                for n, at in enumerate(range(0, len(raw), 4 * size)):
                    own = raw[at : at + 4 * size]
                    length = len(own) // 4
                    out.append((doc, n, at // 4, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
                    if keep_ids:
                        kept.append(np.frombuffer(own, "<u4"))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [*names, *["ids"] * keep_ids])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return slim.mapInArrow(run, schema + ", ids array<int>" * keep_ids)


def best_two_fit(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Compositions (how often, [(length, how many), ...]) that hold all of ``counts``.

    ``counts[n]`` is the number of pieces of length n; the last index is the room.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    room = len(left) - 1
    plan = []
    index = np.arange(room + 1)
    while left.any():
        free, taken, gap = left.copy(), {}, room

        def take(length: int, many: int, free: np.ndarray = free, taken: dict = taken) -> int:
            free[length] -= many
            taken[length] = taken.get(length, 0) + many
            return length * many

        while gap and (fits := np.flatnonzero(free[: gap + 1])).size:
            longest = int(fits[-1])
            gap -= take(longest, min(int(free[longest]), gap // longest))
        if gap and sum(taken.values()) > 1:
            smallest = min(taken)
            wide = gap + smallest
            # For each length, the longest other that still fits beside it.
            upto = np.maximum.accumulate(np.where(free > 0, index, 0))
            one = np.flatnonzero(free[: wide + 1])
            two = upto[wide - one]
            # A pair of equals needs two of them; else the next shorter one.
            alone = (two == one) & (free[one] < 2)
            two = np.where(alone, upto[np.maximum(one - 1, 0)], two)
            both = np.where(two > 0, one + two, 0)
            if both.size and both.max() > smallest:
                best = int(both.argmax())
                take(smallest, -1)
                if not taken[smallest]:
                    del taken[smallest]
                take(int(one[best]), 1)
                take(int(two[best]), 1)
        often = min(int(left[length]) // many for length, many in taken.items())
        for length, many in taken.items():
            left[length] -= often * many
        plan.append((often, sorted(taken.items(), reverse=True)))
    return plan


def _places(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan by length and rank: which ranks go to which sequences, and where in them."""
    rows, first, used = [], 0, {}
    for often, composition in plan:
        at = 0
        for length, many in composition:
            rank = used.get(length, 0)
            rows.append((length * MANY + rank, rank, many, first, at))
            used[length] = rank + often * many
            at += length * many
        first += often
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "rank", "many", "first", "at"), table.T, strict=True))


def pack(
    docs: DataFrame,
    path: str,
    size: int = 2048,
    closing: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset`` (and ``ids``).

    Places in a sequence are filled from 0 without gaps.

    Defined cases: null and empty texts are one piece with the closing id alone; null ids of
    rows stay null; repeated rows are packed each; other columns are ignored; an empty
    table gives no rows.
    """
    cut = saved(pieces(docs, path, size, closing, id_col, text_col, keep_ids))
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = saved(counts)
    histogram = np.zeros(size + 1, np.int64)
    # At most one row per length: bounded by the sequence size.
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    places = _places(best_two_fit(histogram))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # The offsets are few rows beside the pieces: hashed, so that neither side is sorted.
    ranked = cut.join(offsets.hint("shuffle_hash"), ["part", "length"]).withColumn("rank", F.col("nth") + F.col("base"))
    result = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            own = np.searchsorted(places["key"], length * MANY + rank, side="right") - 1
            since, many = rank - places["rank"][own], places["many"][own]
            sequence = places["first"][own] + since // many
            offset = places["at"][own] + since % many * length
            columns = [batch.column(c) for c in result]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)], [*result, "sequence_id", "offset"]
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" * keep_ids + ", sequence_id long, offset long"
    return ranked.select(*result, "rank").mapInArrow(run, schema)
