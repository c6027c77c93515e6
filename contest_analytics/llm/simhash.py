"""Near-duplicate documents by SimHash, with pigeonring filtering.

A fingerprint has 64 bits: bit ``i`` is set if it is set in over half of the hashes
of the document's word shingles. Documents link when their fingerprints differ in at
most four bits, and links are transitive.

**Finding links.** The bits are cut into a ring of five segments. If two fingerprints
differ in at most four bits, then some segment starts a chain in which the
differences of its first 1, 2, 3, 4, 5 segments add up to at most 0, 1, 2, 3, 4 (the
proportional budget 4/5 per segment, rounded down). So for each of the five starts:

* the first segment is equal, and the next two (26 bits) differ in at most two bits, so
  two of their four quarters are equal. Equal bits make the key: 5 starts x 6 pairs of
  quarters = 30 keys of about 26 bits each per distinct fingerprint;
* among the fingerprints of a key the whole chain is tested, and only for pairs that pass
  it all 64 bits are compared.

Equal fingerprints are merged before and count once, so copies make no pairs. Inside a
key only a spanning forest of the links leaves the task. Keys with many fingerprints
are cut into blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contest_analytics.llm.common import free_name, saved, text_rows
from contest_analytics.llm.components import connected_components

BITS, REACH = 64, 4
#: First bit and width of the ring's segments, from the highest bit down.
SEGMENTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: First bit of a key above those that ``chain_keys`` uses.
SEED_BIT = 40
#: Fingerprints of one key that are compared in one go.
BLOCK = 2048
#: Copies of each component's smallest value, so that a large component is joined by many tasks.
SALTS = 32


def shingle_hashes(text: str | None, words: int = 4, seed: int = 42) -> np.ndarray:
    """Hashes of all word shingles in order; none for null and for a text without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.dtype(">u8"))
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(words, len(parts))
    n = len(parts) - k + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.dtype(">u8"), n)


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text; zero for null and for a text without words."""
    return majority(shingle_hashes(text, words, seed))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the (big-endian) hashes; zero without any."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # bounds the unpacked bits of a very long text
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    seed: int = 42,
    extra: str | None = None,
) -> DataFrame:
    """``doc_id`` (long), ``fp`` (long, the fingerprint's bits), one row per input row.

    ``extra`` names a string column to carry along.
    """
    carried = [extra] if extra else []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_rows(batches):
            found = [fingerprint(t, words, seed) for t in rows.column(0).to_pylist()]
            bits = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([bits, *rows.columns[1:]], ["fp", "doc_id", *carried])

    text, name = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    slim = docs.select(text.alias("_text"), name.alias("doc_id"), *carried)
    schema = "fp long, doc_id long" + "".join(f", {c} string" for c in carried)
    return slim.mapInArrow(run, schema)


def _bits(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, BITS - first - width).bitwiseAND(F.lit((1 << width) - 1))


def chain_keys(fp: Column) -> Column:
    """The 30 keys of a fingerprint, an array of structs (start, key)."""
    keys, segments = [], len(SEGMENTS)
    for start in range(segments):
        head = _bits(fp, *SEGMENTS[start])
        quarters = []
        for nearby in ((start + 1) % segments, (start + 2) % segments):
            first, width = SEGMENTS[nearby]
            half = width // 2
            quarters += [_bits(fp, first, half), _bits(fp, first + half, width - half)]
        for pick, (i, j) in enumerate(combinations(range(4), 2)):
            packed = F.shiftleft(head, 14).bitwiseOR(F.shiftleft(quarters[i], 7)).bitwiseOR(quarters[j])
            keys.append(F.shiftleft(packed, 8).bitwiseOR(F.lit(6 * start + pick)))
    return F.array(*keys)


_MASKS = np.array([((1 << w) - 1) << (BITS - f - w) for f, w in SEGMENTS], np.uint64)


def near(one: np.ndarray, many: np.ndarray, start: int, reach: int = REACH) -> np.ndarray:
    """Which fingerprints link: the chain from segment ``start`` first, then all bits."""
    diff = one ^ many
    alive = np.arange(len(diff))
    total = np.zeros(len(diff), np.int64)
    for length in range(1, len(SEGMENTS)):
        mask = _MASKS[(start + length - 1) % len(SEGMENTS)]
        total = total + np.bitwise_count(diff[alive] & mask)
        keep = total <= length * reach // len(SEGMENTS)
        alive, total = alive[keep], total[keep]
        if not len(alive):
            break
    alive = alive[np.bitwise_count(diff[alive]) <= reach]
    hit = np.zeros(len(diff), bool)
    hit[alive] = True
    return hit


def _forest(fps: np.ndarray, start: int, reach: int = REACH) -> list[tuple[int, int]]:
    """A spanning forest of the links among a key's fingerprints."""
    links, rest = [], fps
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            one = stack.pop()
            hit = near(one, rest, start, reach)
            found = rest[hit]
            links += [(one, x) for x in found]
            stack.extend(found)
            rest = rest[~hit]
    return links


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The rows of each (key, cell) with several; they come sorted by it, a group may span batches."""
    kept: list[np.ndarray] = []

    def cut(rows: np.ndarray) -> list[np.ndarray]:
        cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        ends = zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True)
        return [rows[a:b] for a, b in ends if b - a > 1]

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
        if kept:
            rows = np.concatenate([*kept, rows])
        same = (rows[:, :2] == rows[-1, :2]).all(axis=1)
        first = 0 if same.all() else len(rows) - int(same[::-1].argmin())
        kept = [rows[first:]]
        if first:
            yield cut(rows[:first])
    if kept:
        yield cut(kept[0])


def _trees(group: np.ndarray, reach: int = REACH) -> list[tuple[int, int]]:
    """A spanning forest of the links within one (key, cell)."""
    return _forest(group[:, 2].astype(np.int64).view(np.uint64), int(group[0, 0] & 255) // 6, reach)


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each (key, cell)."""
    for groups in _groups(batches):
        ends = np.array([pair for group in groups for pair in _trees(group)], np.uint64).reshape(-1, 2)
        ends = np.unique(ends, axis=0).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def _dealt(keyed: DataFrame) -> DataFrame:
    """``key``, ``cell``, ``fp`` of the keys that several have, sorted, a cell in one task."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    here = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    low, high = F.least(F.col("mine"), F.col("other")), F.greatest(F.col("mine"), F.col("other"))
    # Both sides have a row for each key; Spark sizes them as the fingerprints before the explode, and would
    # send all keys through the driver.
    cells = (
        keyed.join(sizes.hint("merge"), "key")
        .withColumn("blocks", blocks)
        .withColumn("mine", here)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", (low * F.col("blocks") + high).alias("cell"), "fp")
    )
    return cells.repartition("key", "cell").sortWithinPartitions("key", "cell")


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """``a``, ``b``: links that connect the distinct fingerprints ``fp``, a forest per key."""
    keyed = prints.select("fp", F.explode(chain_keys(F.col("fp"))).alias("key"))
    return _dealt(keyed).mapInArrow(_links, "a long, b long").distinct()


def fingerprint_groups(prints: DataFrame, reach: int = REACH) -> DataFrame:
    """``group``, ``seed``, ``fp``: the distinct fingerprints (``seed``, ``fp``) that link inside a key.

    ``seed``, a small number, tells families of fingerprints apart. Members of a group are connected by
    links of at most ``reach`` bits inside one chain key; a fingerprint is in a group for each key where it
    links. Up to four bits every link is inside some key; of wider ones only those that share a key are.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _groups(batches):
            names, seeds, found = [], [], []
            for group in groups:
                root: dict[int, int] = {}
                for one, other in _trees(group, reach):
                    root[other] = root.setdefault(one, one)
                key, cell = group[0, :2].tolist()
                for fp, top in root.items():
                    names.append(xxhash.xxh3_64_intdigest(f"{key} {cell} {top}"))
                    seeds.append(key >> SEED_BIT)
                    found.append(fp)
            columns = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (names, seeds, found)]
            yield pa.RecordBatch.from_arrays(columns, ["group", "seed", "fp"])

    family = F.shiftleft(F.col("seed").cast("long"), SEED_BIT)
    keyed = prints.select("seed", "fp", F.explode(chain_keys(F.col("fp"))).alias("key"))
    return _dealt(keyed.select("fp", F.col("key").bitwiseOR(family).alias("key"))).mapInArrow(run, "group long, seed long, fp long")


def linked_roots(prints: DataFrame) -> DataFrame:
    """``node``, ``root`` of the fingerprints that link with another one."""
    return connected_components(fingerprint_links(prints))


def classes(
    prints: DataFrame, least: Column, roots_of: Callable[[DataFrame], DataFrame] = linked_roots
) -> DataFrame:
    """``fp``, ``least``: the smallest value of ``least`` among the rows of its component."""
    distinct = saved(prints.groupBy("fp").agg(F.min(least).alias("own")))
    roots = roots_of(distinct.select("fp"))
    named = saved(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left"))
    # Fingerprints without a link are their own component and need no more work.
    alone = named.filter("root is null").select("fp", F.col("own").alias("least"))
    linked = named.filter("root is not null").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    best = linked.groupBy("root").agg(F.min("own").alias("least"))
    copies = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Sized by Spark as one copy: never broadcast.
    return alone.unionByName(linked.join(copies.hint("merge"), ["root", "salt"]).select("fp", "least"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    ``component_id`` is the smallest id reachable over links, the row's own included.

    Defined cases: null, empty and blank texts have fingerprint zero and link like any
    other; a text of fewer than ``words`` words is one shingle; repeated rows stay and share
    a component; a null id stays null and names a component only if all its ids are null
    (the name is null then); other columns are ignored; an empty table gives no rows.
    """
    prints = saved(fingerprints(docs, id_col, text_col, words, seed).select("doc_id", "fp"))
    least = classes(prints, F.col("doc_id"))
    return prints.join(least, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least").alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id.

    Among rows that repeat this id the smallest SHA-256 of id and text stays, once; rows
    without an id come last. Links are those of :func:`near_duplicates`.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    key = free_name(docs, "_key")
    keyed = docs.withColumn(key, F.sha2(F.concat_ws(":", name, text), 256))
    prints = saved(fingerprints(keyed, id_col, text_col, extra=key))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col(key).alias("key"))
    stay = classes(prints, order).select(F.col("least.key").alias(key)).distinct()
    return keyed.join(stay, key).dropDuplicates([key]).select(*docs.columns)
