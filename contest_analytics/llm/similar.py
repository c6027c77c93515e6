"""Near-duplicate documents by the exact similarity of their word shingles.

Two documents link when the Jaccard similarity of their sets of ``words``-word shingles is
``similarity`` at least, and links are transitive. Candidates come from SimHash with pigeonring
filtering (:mod:`simhash`): every set has ``SEEDS`` fingerprints, and sets whose fingerprints link
inside a chain key, by ``REACH`` bits at most, are candidates. All pairs within four bits are among
them, but a pair at 0.8 differs in about ten. So that no link is lost, there are MinHash keys
beside: ``BANDS`` keys of ``ROWS`` smallest hashes each. A pair with similarity s shares one with
probability 1 - (1 - s ** ROWS) ** BANDS: 0.9993 at 0.8, more above. Every candidate of either
kind is confirmed on the shingles themselves, so no other documents link.

Equal sets are merged before and count once, so copies make no pairs. Keys with the same
members are compared once. Inside a key only a spanning forest of the links leaves the
task. Shingles are shuffled only for sets that share a key with another one.

A key with many sets, or many bytes, is cut into blocks. First every block is solved, together
with one set of the key that all blocks share; so the members of one large group of near copies
are connected after work that grows with their number. Then only sets outside the key's largest
group are compared with all of its blocks: what is connected already is not compared again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contest_analytics.llm.common import free_name, saved, text_rows
from contest_analytics.llm.components import connected_components
from contest_analytics.llm.simhash import classes, fingerprint_groups, majority, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
#: Fingerprints of a set, and bits in which two of them may differ.
SEEDS, REACH = 1, 10
#: Sets of one key, and bytes of their shingles, that are compared in one go.
BLOCK, BLOCK_BYTES = 128, 64 << 20

_RNG = np.random.default_rng(23)
_FLIP = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_SALT = _RNG.integers(0, 1 << 64, BANDS, np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; empty for a text without words."""
    return np.unique(shingle_hashes(text, words).astype(np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of one set; none for an empty one."""
    if not len(found):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1 << 13):  # bounds the memory of a very long text
        part = found[None, at : at + (1 << 13)]
        least = np.minimum(least, ((part ^ _FLIP) * _TIMES).min(axis=1))
    keys = _SALT.copy()
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def prints_of(found: np.ndarray) -> np.ndarray:
    """The ``SEEDS`` fingerprints of one set; the shingles' hashes are mixed anew for each."""
    prints = []
    for flip in _FLIP[:SEEDS, 0]:
        mixed = (found ^ flip) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        prints.append(majority((mixed ^ (mixed >> np.uint64(31))).astype(">u8")))
    return np.array(prints, np.uint64).view(np.int64)


def _node(found: np.ndarray) -> int:
    """The 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(found.tobytes())


def alike(one: np.ndarray, many: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of ``many`` non-empty sets have the similarity with the non-empty set ``one``."""
    sizes = np.array([len(x) for x in many])
    hit = np.zeros(len(many), bool)
    may = np.flatnonzero(np.minimum(sizes, len(one)) >= similarity * np.maximum(sizes, len(one)) - 1e-9)
    if len(may):
        every = np.concatenate([many[i] for i in may])
        spots = np.minimum(np.searchsorted(one, every), len(one) - 1)
        starts = np.cumsum(sizes[may]) - sizes[may]
        both = np.add.reduceat((one[spots] == every).astype(np.int64), starts)
        hit[may] = both >= similarity * (len(one) + sizes[may] - both) - 1e-9
    return hit


def _forest(nodes: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among a key's sets."""
    links, rest = [], list(range(len(nodes)))
    while rest:
        stack, rest = [rest[0]], rest[1:]
        while stack and rest:
            one = stack.pop()
            hit = alike(sets[one], [sets[i] for i in rest], similarity)
            found = [i for i, h in zip(rest, hit, strict=True) if h]
            links += [(nodes[one], nodes[i]) for i in found]
            stack.extend(found)
            rest = [i for i, h in zip(rest, hit, strict=True) if not h]
    return links


def _near_prints(prints: DataFrame) -> DataFrame:
    """``fp``, ``size``, ``key``: a key for each group of sets whose fingerprints are equal or link."""
    every = prints.filter("size > 0").select("fp", "size", F.posexplode("sims").alias("seed", "sim"))
    groups = fingerprint_groups(every.select("seed", F.col("sim").alias("fp")).distinct(), REACH)
    linked = every.join(groups.withColumnRenamed("fp", "sim"), ["seed", "sim"]).select("fp", "size", F.col("group").alias("key"))
    return every.select("fp", "size", F.xxhash64("seed", "sim").alias("key")).unionByName(saved(linked))


def _keys(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``fp``, ``key`` of every set, and ``key``, ``blocks``, ``shared`` of the keys to compare.

    ``shared`` is the set that all blocks of a key get.
    """
    keyed = prints.select("fp", "size", F.explode(F.array_distinct("bands")).alias("key")).unionByName(_near_prints(prints))
    marks = [F.bit_xor(F.xxhash64(F.lit(n), F.col("fp"))).alias(f"m{n}") for n in (1, 2)]
    sizes = (
        keyed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("sum"), F.min_by("fp", F.xxhash64("fp")).alias("shared"), *marks)
        .filter("n > 1")
    )
    # Keys with the same members count once.
    once = sizes.groupBy("n", "m1", "m2").agg(F.min(F.struct("key", "sum", "shared")).alias("k"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("k.sum") * 8 / BLOCK_BYTES)).cast("long")
    return keyed.select("fp", "key"), once.select("k.key", blocks.alias("blocks"), "k.shared")


def _cells(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """``key``, ``cell``, ``fp``: the members of each block, and the set that its key shares."""
    own = keyed.join(keys.select("key", "blocks"), "key").select(
        "key", F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("cell"), "fp"
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("cell")
    shared = keys.filter("blocks > 1").select("key", every, F.col("shared").alias("fp"))
    return own.unionByName(shared).distinct()


def _left_over(keyed: DataFrame, big: DataFrame, roots: DataFrame) -> DataFrame:
    """``key``, ``cell``, ``fp``, ``root``, ``asks``: in each key with many blocks, the sets outside
    its largest group (``asks``), each block of them with each block of all."""
    members = keyed.join(big.select("key", "blocks"), "key").join(roots.toDF("fp", "root"), "fp", "left")
    named = saved(members.withColumn("root", F.coalesce("root", "fp")))
    sizes = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    # A key's rows are joined by its few facts; a large key is cut by the blocks of its members.
    facts = sizes.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    asking = facts.withColumn("ask_blocks", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("long")).filter("ask_blocks > 0")
    rows = named.join(asking.select("key", "main", "ask_blocks"), "key")
    asks = F.col("root") != F.col("main")
    mine, place = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("ask_blocks")), F.pmod(F.xxhash64("fp"), F.col("blocks"))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cell = F.col("_ask") * F.col("blocks") + F.col("_all")
    held = rows.withColumn("_all", place).withColumn("_ask", span("ask_blocks"))
    asked = rows.filter(asks).withColumn("_ask", mine).withColumn("_all", span("blocks"))
    return held.select("key", cell.alias("cell"), "fp", "root", F.lit(False).alias("asks")).unionByName(
        asked.select("key", cell.alias("cell"), "fp", "root", F.lit(True).alias("asks"))
    )


def _roots(prints: DataFrame, keyed_docs: DataFrame, key: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """``node``, ``root``: the components of the distinct sets ``fp`` that link with another one."""
    keyed, keys = _keys(prints.dropDuplicates(["fp"]))
    keys = saved(keys)
    cells = saved(_cells(keyed, keys))
    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_rows(batches):
            sets = [shingle_set(t, words).tobytes() for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets, pa.binary())], ["fp", "found"])

    # Spark sizes texts, and what is made of them, by their compressed files; merged, they are never broadcast.
    named = cells.select("fp").distinct().hint("merge")
    wanted = prints.select("fp", key).join(named, "fp").groupBy("fp").agg(F.min(key).alias(key))
    texts = keyed_docs.select(key, F.col(text_col).cast("string").alias("_text")).join(wanted.hint("merge"), key).dropDuplicates(["fp"])
    sets = texts.select("fp", "_text").mapInArrow(whole, "fp long, found binary")
    big = keys.filter("blocks > 1")
    if large := not big.isEmpty():
        # They are needed twice; the texts are not shuffled again for it.
        sets = saved(sets)

    def solve(table: pa.Table) -> pa.Table:
        found = [np.frombuffer(x, np.uint64) for x in table["found"].to_pylist()]
        ends = np.array(_forest(table["fp"].to_pylist(), found, similarity), np.int64).reshape(-1, 2)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    def ask(table: pa.Table) -> pa.Table:
        found = [np.frombuffer(x, np.uint64) for x in table["found"].to_pylist()]
        fp, root, asks = (table[c].to_numpy(zero_copy_only=False) for c in ("fp", "root", "asks"))
        there = np.flatnonzero(~asks)
        links = set()
        for i in np.flatnonzero(asks):
            others = there[root[there] != root[i]]
            hit = others[alike(found[i], [found[j] for j in others], similarity)] if len(others) else others
            # Links of groups, by the names of their roots.
            links |= {(int(root[i]), int(r)) for r in np.unique(root[hit])}
        ends = np.array(sorted(links), np.int64).reshape(-1, 2)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    links = cells.join(sets, "fp").groupBy("key", "cell").applyInArrow(solve, "a long, b long").distinct()
    roots = connected_components(links)
    if not large:
        return roots
    rest = saved(_left_over(keyed, big, roots))
    if rest.isEmpty():
        return roots
    more = rest.join(sets, "fp").groupBy("key", "cell").applyInArrow(ask, "a long, b long").distinct()
    # Components of components: what is left is a link between two of them each.
    later = connected_components(more).toDF("root", "last")
    named = later.select(F.col("root").alias("node"), "root").join(roots.select("node"), "node", "left_anti")
    return roots.unionByName(named).join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id.

    Among rows that repeat this id the smallest SHA-256 of id and text stays, once; rows
    without an id come last. Texts without words are alike; a text of fewer than ``words``
    words is one shingle. Null texts are like empty ones; columns of any name stay; an empty
    table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    key = free_name(docs, "_key")
    keyed = docs.withColumn(key, F.sha2(F.concat_ws(":", name, text), 256))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_rows(batches):
            sets = [shingle_set(t, words) for t in rows.column(0).to_pylist()]
            nodes = pa.array(np.array([_node(s) for s in sets], np.uint64).view(np.int64))
            keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            sims = pa.array([prints_of(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([nodes, keys, sizes, sims, *rows.columns[1:]], ["fp", "bands", "size", "sims", "doc_id", key])

    slim = keyed.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long").alias("doc_id"), key)
    prints = saved(slim.mapInArrow(run, f"fp long, bands array<long>, size long, sims array<long>, doc_id long, {key} string"))
    roots = _roots(prints, keyed, key, text_col, words, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col(key).alias("key"))
    stay = classes(prints, order, lambda _: roots).select(F.col("least.key").alias(key)).distinct()
    return keyed.join(stay.hint("merge"), key).dropDuplicates([key]).select(*docs.columns)
