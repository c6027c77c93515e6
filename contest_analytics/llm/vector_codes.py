"""Product codes of vectors by dual-tree Lloyd iterations in whole numbers.

Vectors are scaled to integers and cut into equal parts, and every part position has a
codebook of its own. A Lloyd round gives each part to the nearest entry (squared Euclidean
distance, ties to the lower index) and moves each entry to the floored mean of its parts.

**Dual tree.** Inside a task the parts of a block of rows make a balanced k-d tree for each
position, whose nodes cache the box, the sum and the number of their parts; the entries
make a smaller tree. Pairs of nodes, one of each tree, are walked from the roots down. A pair
whose boxes are farther apart than some other entry node can possibly be from the same parts
is dropped. A node of parts with one entry left is assigned whole, its cached sum going to the
entry. Leaves with several entries left compare integer distances. All bounds are integers and
only strictly farther pairs are dropped, so ties are decided as by the plain rule.

**Spark.** Every round is one scan: a task returns one row of sums per position and entry
it used, which combine before the shuffle. What comes to the driver is a codebook of a fixed
size, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contest_analytics.llm.common import saved

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Parts of a tree's leaf; rows of a block.
LEAF, ROWS = 8, 16_384
#: Scaled components of at least this size take no part: their squares would not fit in a long.
LARGEST = 1 << 25
#: Copies of each label's total, so that a label of many rows is joined by many tasks.
SALTS = 32


def scaled(vec: Column, scale: int = SCALE) -> Column:
    """Integer vector of floor(scale * x); null if a component is null, not finite or too large."""
    vec = vec.cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < LARGEST / scale))
    return F.when(fine, F.transform(vec, lambda x: F.floor(x * scale).cast("int")))


@dataclass
class Tree:
    """Entries of one codebook as a binary tree; equal entries are one leaf, with the lower index.

    ``low`` and ``high``: boxes of the nodes; ``children``: two nodes each, -1 below a leaf;
    ``entry``: the index at a leaf, -1 elsewhere. Node 0 is the root.
    """

    low: np.ndarray
    high: np.ndarray
    children: np.ndarray
    entry: np.ndarray


def entry_tree(book: np.ndarray) -> Tree:
    """Halves the entries by their widest component until each is alone."""
    points, first = np.unique(book, axis=0, return_index=True)
    low, high, children, entry = [], [], [], []
    todo = [(np.arange(len(points)), -1, 0)]
    while todo:
        own, parent, side = todo.pop()
        node, held = len(low), points[own]
        if parent >= 0:
            children[parent][side] = node
        low.append(held.min(axis=0))
        high.append(held.max(axis=0))
        children.append([-1, -1])
        entry.append(int(first[own[0]]) if len(own) == 1 else -1)
        if len(own) > 1:
            order = own[np.argsort(held[:, np.argmax(high[-1] - low[-1])], kind="stable")]
            half = len(order) // 2
            todo += [(order[:half], node, 0), (order[half:], node, 1)]
    return Tree(np.array(low), np.array(high), np.array(children), np.array(entry))


@dataclass
class Forest:
    """Balanced k-d trees over the parts of a block, one tree for each position.

    Level ``l`` has 2 ** l nodes a tree; ``order`` lists the rows of the block leaf by leaf
    (trees x rows), with repeats of the last one, of weight 0, to fill the leaves. Lists have one
    array for each level: ``low``, ``high`` and ``sums`` (trees, nodes, components), ``sizes``.
    """

    order: np.ndarray
    weight: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]
    sizes: list[np.ndarray]


def grow(parts: np.ndarray, leaf: int = LEAF) -> Forest:
    """``parts``: (trees, rows, components). Splits every node at the middle of its widest side."""
    trees, rows, width = parts.shape
    depth = max(0, int(np.ceil(np.log2(max(rows, 1) / leaf)))) if rows > leaf else 0
    room = leaf << depth
    order = np.broadcast_to(np.minimum(np.arange(room), rows - 1), (trees, room)).copy()
    weight = np.broadcast_to(np.arange(room) < rows, (trees, room)).copy()
    pick = np.arange(trees)[:, None]
    low, high, sums, sizes = [], [], [], []
    for level in range(depth + 1):
        nodes = 1 << level
        held = parts[pick, order].reshape(trees, nodes, -1, width)
        counted = weight.reshape(trees, nodes, -1)
        low.append(held.min(axis=2))
        high.append(held.max(axis=2))
        sums.append((held * counted[..., None]).sum(axis=2, dtype=np.int64))
        sizes.append(counted.sum(axis=2))
        if level < depth:
            wide = (high[-1] - low[-1]).argmax(axis=2)
            along = np.take_along_axis(held, wide[:, :, None, None], axis=3)[..., 0]
            middle = along.shape[2] // 2
            moved = np.argpartition(along, middle, axis=2)
            order = np.take_along_axis(order.reshape(trees, nodes, -1), moved, axis=2).reshape(trees, -1)
            weight = np.take_along_axis(counted, moved, axis=2).reshape(trees, -1)
    return Forest(order, weight, low, high, sums, sizes)


def _spans(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance between points of two boxes, pair by pair."""
    gap = np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0).astype(np.int64)
    reach = np.maximum(high_a - low_b, high_b - low_a).astype(np.int64)
    return (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)


def _pruned(owner: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which pairs may hold a nearest entry. ``owner``, sorted, names the node of parts."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    best = np.minimum.reduceat(far, starts)
    return near <= np.repeat(best, np.diff(np.r_[starts, len(owner)]))


def walk(
    parts: np.ndarray, forest: Forest, books: list[Tree]
) -> Iterator[tuple[int | None, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Walks both trees of each position; yields whole nodes and single parts with their entry.

    ``(level, (tree, node, entry))`` for nodes assigned whole and
    ``(None, (tree, row, entry))`` for the parts of uncertain leaves.
    """
    trees, depth = parts.shape[0], len(forest.low) - 1
    # Trees of all positions side by side: node numbers get an offset.
    firsts = np.cumsum([0] + [len(b.entry) for b in books])[:-1]
    low_b, high_b = np.concatenate([b.low for b in books]), np.concatenate([b.high for b in books])
    entry = np.concatenate([b.entry for b in books])
    children = np.concatenate([np.where(b.children < 0, -1, b.children + f) for b, f in zip(books, firsts, strict=True)])
    # A pair: the node of parts (tree * nodes + node) and the entry node.
    owner, other = np.arange(trees), firsts.copy()
    level = 0
    while len(owner):
        nodes = 1 << level
        low, high = (x[level].reshape(trees * nodes, -1) for x in (forest.low, forest.high))
        keep = _pruned(owner, *_spans(low[owner], high[owner], low_b[other], high_b[other]))
        owner, other = owner[keep], other[keep]
        alone = np.r_[True, owner[1:] != owner[:-1]] & np.r_[owner[1:] != owner[:-1], True]
        done = alone & (entry[other] >= 0)
        if done.any():
            yield level, (owner[done] // nodes, owner[done] % nodes, entry[other[done]])
        owner, other = owner[~done], other[~done]
        # Entry nodes open where they can; nodes of parts as long as they have children.
        inner = entry[other] < 0
        if level == depth and not inner.any():
            break
        owner = np.repeat(owner, np.where(inner, 2, 1))
        pairs = np.where(inner[:, None], children[other], np.stack([other, np.full_like(other, -1)], axis=1)).ravel()
        other = pairs[pairs >= 0]
        if level < depth:
            owner, other = np.r_[2 * owner, 2 * owner + 1], np.r_[other, other]
            order = np.argsort(owner, kind="stable")
            owner, other = owner[order], other[order]
            level += 1
    if len(owner):
        yield None, _leaves(parts, forest, depth, owner, other, low_b, entry)


def _leaves(
    parts: np.ndarray,
    forest: Forest,
    depth: int,
    owner: np.ndarray,
    other: np.ndarray,
    points: np.ndarray,
    entry: np.ndarray,
) -> tuple[np.ndarray, ...]:
    """Integer distances of the parts of uncertain leaves to the entries left for their leaf."""
    nodes = 1 << depth
    tree, leaf = owner // nodes, owner % nodes
    size = forest.order.shape[1] // nodes
    # Entries of a leaf from the lowest index, so that the first of the nearest wins.
    by_index = np.lexsort((entry[other], owner))
    owner, other, tree, leaf = owner[by_index], other[by_index], tree[by_index], leaf[by_index]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    lengths = np.diff(np.r_[starts, len(owner)])
    rows = forest.order.reshape(-1, nodes, size)[tree, leaf]
    gaps = np.zeros(rows.shape, np.int64)
    for c in range(parts.shape[2]):  # one component at a time bounds the memory
        off = (parts[tree[:, None], rows, c] - points[other, c][:, None]).astype(np.int64)
        gaps += off * off
    best = np.minimum.reduceat(gaps, starts, axis=0)
    # The lowest index among those at the least distance.
    rank = np.where(gaps == np.repeat(best, lengths, axis=0), entry[other][:, None], np.iinfo(np.int64).max)
    winner = np.minimum.reduceat(rank, starts, axis=0)
    real = forest.weight.reshape(-1, nodes, size)[tree[starts], leaf[starts]]
    where = np.broadcast_to(tree[starts][:, None], real.shape)
    return where[real], rows[starts][real], winner[real]


def sums_of(parts: np.ndarray, books: list[Tree], entries: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Sums (positions, entries, components) and numbers of the parts of each entry."""
    forest = grow(parts, leaf)
    sums = np.zeros((len(parts), entries, parts.shape[2]), np.int64)
    sizes = np.zeros((len(parts), entries), np.int64)
    for level, (tree, place, to) in walk(parts, forest, books):
        whole = level is not None
        np.add.at(sums, (tree, to), forest.sums[level][tree, place] if whole else parts[tree, place])
        np.add.at(sizes, (tree, to), forest.sizes[level][tree, place] if whole else 1)
    return sums, sizes


def codes_of(parts: np.ndarray, books: list[Tree], leaf: int = LEAF) -> np.ndarray:
    """The entry of every part, (positions, rows)."""
    forest = grow(parts, leaf)
    trees, room = forest.order.shape
    codes = np.empty((trees, room), np.int64)
    for level, (tree, place, to) in walk(parts, forest, books):
        if level is None:
            codes[tree, place] = to
        else:
            # A node's rows stand together; repeats of the last row get its entry as well.
            rows = forest.order.reshape(trees, 1 << level, -1)[tree, place]
            codes[tree[:, None], rows] = to[:, None]
    return codes[:, : parts.shape[1]]


def _blocks(batches: Iterable[pa.RecordBatch], at: int, width: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of at most ``ROWS`` at a time, and their parts (positions, rows, components).

    Column ``at`` holds integer vectors, filled with zeros to ``width`` components.
    """

    def cut(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        rows = pa.concat_batches(held)
        vectors = rows.column(at)
        sizes = vectors.value_lengths().to_numpy()
        data = np.zeros((rows.num_rows, width), np.int32)
        data[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy()
        return rows, np.ascontiguousarray(data.reshape(len(data), parts, -1).transpose(1, 0, 2))

    held, n = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            piece = batch.slice(start, ROWS)
            if n and n + piece.num_rows > ROWS:
                yield cut(held)
                held, n = [], 0
            held.append(piece)
            n += piece.num_rows
    if n:
        yield cut(held)


def lloyd_round(rows: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks (positions, entries, components) after one assignment of ``rows.vec``."""
    parts, entries, width = book.shape
    trees = [entry_tree(b) for b in book]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64)
        for _, block in _blocks(batches, 0, parts * width, parts):
            more, n = sums_of(block, trees, entries)
            sums += more
            sizes += n
        part, entry = np.nonzero(sizes)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(sums[part, entry].ravel()), width).cast(pa.list_(pa.int64()))
        columns = [pa.array(part), pa.array(entry), pa.array(sizes[part, entry]), lists]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    found = rows.select("vec").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    totals = [F.sum(F.get("sums", F.lit(c))).alias(f"s{c}") for c in range(width)]
    moved = book.copy()
    # At most one row for each position and entry: a fixed number, whatever the data.
    for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():
        moved[row["part"], row["entry"]] = [row[f"s{c}"] // row["n"] for c in range(width)]
    return moved


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (positions, entries, components) of ``rows`` (``vec_id``, ``vec`` of integers).

    They start as the parts of the ``entries`` smallest ids (ties: the smaller vector; fewer
    rows: fewer entries). Vectors shorter than the longest count as filled with zeros, up to a
    multiple of ``parts``. No rows: no entries.
    """
    longest = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    book = np.zeros((len(first), parts * width), np.int32)
    for to, (vec,) in zip(book, first, strict=True):
        to[: len(vec)] = vec
    book = np.ascontiguousarray(book.reshape(len(first), parts, width).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        book = lloyd_round(rows, book)
    return book


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, book: np.ndarray) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (two hex digits for each part) and ``error`` of every row."""
    parts, _, width = book.shape
    trees = [entry_tree(b) for b in book]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, block in _blocks(batches, 2, parts * width, parts):
            codes = codes_of(block, trees)
            off = block.astype(np.int64) - book[np.arange(parts)[:, None], codes]
            text = codes.T.astype(np.uint8).tobytes().hex()
            names = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            error = pa.array((off * off).sum(axis=(0, 2)))
            yield pa.RecordBatch.from_arrays([held.column(0), held.column(1), pa.array(names, pa.string()), error], NAMES)

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "vec").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


NAMES = ["vec_id", "label", "code", "error"]


def label_errors(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the sum of ``error`` over equal labels, nulls together.

    Totals combine before the shuffle; each is copied to ``SALTS`` places, among which its
    rows are dealt out, so a label of nearly all rows is joined by many tasks.
    """
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    copies = total.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).toDF("_label", "label_error", "_salt")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    same = F.col("label").eqNullSafe(F.col("_label")) & (F.col("salt") == F.col("_salt"))
    return salted.join(copies, same).drop("salt", "_label", "_salt")


def compress(
    rows: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every row that takes part.

    ``error`` is the squared distance of a row's scaled vector from its code's entries,
    ``label_error`` its sum over equal labels (null labels together).

    Defined cases: rows whose vector is null, holds a null, a number that is not finite, or one of
    131,072 or more (a square would not fit in a long) take no part; empty vectors count as zeros;
    vectors shorter than the longest are filled with zeros, up to a multiple of ``parts``; a null
    id comes last and stays; repeated rows stay and count each; fewer rows than ``entries`` give
    fewer entries; an empty table gives no rows; other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    slim = rows.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), scaled(F.col(vec_col)).alias("vec")
    ).filter("vec is not null")
    kept = saved(slim)
    book = fit(kept, parts, entries, rounds)
    # Codes are read twice, for the totals and for the rows.
    coded = label_errors(saved(encode(kept, book))) if book.size else kept.selectExpr(
        "vec_id", "label", "'' as code", "0L as error", "0L as label_error"
    )
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))
