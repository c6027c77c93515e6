"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph, the tree's leaf, is a line; lines are cut after a punctuation mark that a
space follows, so that a text of one line has a tree as well. A section is a run of
paragraphs that ends with one whose hash starts with 0 to 3: boundaries follow the
content, and an insertion changes one section and not all later ones. A section's
hash is the SHA-256 of its paragraphs' hashes, the root that of the sections' hashes.

Equal roots mean equal texts. Where roots differ, sections are compared first, and only
those that the other tree lacks are opened: :func:`edit_place` narrows the stretch of
paragraphs that differ down to its ends, :func:`locate_edits` lists every paragraph that was
removed, added or moved.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Zero-width places after a line end, or after punctuation and a space.
CUT = r"(?<=\n)|(?<=\p{Punct} )"
#: Sections are divided between these; a text's hashes hold no such sign.
MARK = "|"
RANGES = 256


def paragraphs(text: Column) -> Column:
    return F.split(text, CUT, -1)


def leaf_hashes(text: Column) -> Column:
    return F.transform(paragraphs(text), lambda p: F.sha2(p, 256))


def branches(leaves: Column) -> Column:
    """The sections in order: structs of ``hash`` and ``size``, the number of paragraphs."""
    ends = F.transform(leaves, lambda h: F.when(h < "4", F.concat(h, F.lit(MARK))).otherwise(h))
    return F.transform(
        F.split(F.array_join(ends, ""), r"\|", -1),
        lambda s: F.struct(F.sha2(s, 256).alias("hash"), (F.length(s) / 64).cast("int").alias("size")),
    )


def root_hash(sections: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sections, lambda s: s["hash"]), ""), 256)


def short(hash_of: Column) -> Column:
    """The first 60 bits of a hash as a long, enough to compare two documents."""
    return F.conv(F.substring(hash_of, 1, 15), 16, 10).cast("long")


def likeness(root: Column, leaves: Column, other_root: Column, other_leaves: Column) -> Column:
    """1 for equal roots, else the share of different paragraphs that both trees hold."""
    both = F.size(F.array_intersect(leaves, other_leaves))
    any_of = F.size(F.array_union(leaves, other_leaves))
    return F.when(root == other_root, F.lit(1.0)).otherwise(both / any_of)


def with_tree(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds ``<prefix>root``, ``<prefix>leaves`` and ``<prefix>sections`` for the column ``text`` (no nulls)."""
    hashed = df.withColumn("_hashes", leaf_hashes(F.col(text))).withColumn("_sections", branches(F.col("_hashes")))
    return hashed.select(
        *df.columns,
        root_hash(F.col("_sections")).alias(f"{prefix}root"),
        F.transform("_hashes", short).alias(f"{prefix}leaves"),
        F.transform("_sections", lambda s: F.struct(short(s["hash"]).alias("hash"), s["size"].alias("size"))).alias(
            f"{prefix}sections"
        ),
    )


def _alike(one: Column, other: Column) -> Column:
    """How many entries two arrays have in common from the start."""
    n = F.least(F.size(one), F.size(other))
    same = F.zip_with(F.slice(one, 1, n), F.slice(other, 1, n), lambda x, y: x == y)
    differs = F.array_position(same, False).cast("int")
    return F.when(differs == 0, n).otherwise(differs - 1)


def _covered(sections: Column, number: Column) -> Column:
    return F.aggregate(F.slice(sections, 1, number), F.lit(0), lambda n, s: n + s["size"])


def _after(leaves: Column, skip: Column) -> Column:
    return F.slice(leaves, skip + 1, F.greatest(F.size(leaves) - skip, F.lit(0)))


def edit_place(df: DataFrame, prefix: str, name: str) -> DataFrame:
    """Adds ``name``: ``first:removed:added`` of the trees without and with ``prefix``.

    The stretch of paragraphs that differ begins at the paragraph ``first``; it has ``removed``
    paragraphs in one tree and ``added`` in the other. Equal leading and trailing sections are
    passed over whole; only in what is left are paragraphs compared. Empty for equal trees.
    """
    one, other = F.col("sections"), F.col(f"{prefix}sections")
    passed = df.withColumn("_front", _covered(one, _alike(one, other)))
    passed = passed.withColumn("_back", _covered(F.reverse(one), _alike(F.reverse(one), F.reverse(other))))
    sides = ("leaves", f"{prefix}leaves")
    begun = passed.withColumn("_first", F.col("_front") + _alike(*[_after(F.col(c), F.col("_front")) for c in sides]))
    # What follows the first difference, from its end; sections there may reach over it.
    rest = begun.withColumns({f"_rest{i}": F.reverse(_after(F.col(c), F.col("_first"))) for i, c in enumerate(sides)})
    least = F.least(F.col("_back"), F.size("_rest0"), F.size("_rest1"))
    ended = rest.withColumn("_back", least).withColumn(
        "_last", F.col("_back") + _alike(*[_after(F.col(f"_rest{i}"), F.col("_back")) for i in range(2)])
    )
    removed, added = (F.size(f"_rest{i}") - F.col("_last") for i in range(2))
    place = F.concat_ws(":", "_first", removed, added)
    return ended.select(*df.columns, F.when(F.col("root") == F.col(f"{prefix}root"), "").otherwise(place).alias(name))


def tree_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tree as rows: ``doc_id``, ``copy``, ``paragraph``, ``start``, ``length`` (code points),
    ``section`` (from 0), ``hash``, ``section_hash``.

    Defined cases: a null text is empty, its tree one empty paragraph; a null id is an id; rows
    that share an id are its copies from 0 on, in the order of their text's SHA-256; an empty
    table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), F.sha2(text, 256).alias("_sha"), text.alias("_text")
    )
    cut = named.select("doc_id", "_row", "_sha", F.posexplode(paragraphs(F.col("_text"))).alias("paragraph", "_p"))
    before = W.partitionBy("doc_id", "_row").orderBy("paragraph").rowsBetween(W.unboundedPreceding, -1)
    closes = F.when(F.col("hash") < "4", 1).otherwise(0)
    rows = (
        cut.withColumn("length", F.length("_p"))
        .withColumn("hash", F.sha2("_p", 256))
        .drop("_p")
        .withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))
        .withColumn("section", F.coalesce(F.sum(closes).over(before), F.lit(0)))
    )
    inside = W.partitionBy("doc_id", "_row", "section").orderBy("paragraph").rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing
    )
    joined = F.array_join(F.collect_list("hash").over(inside), "")
    copy = F.dense_rank().over(W.partitionBy("doc_id").orderBy("_sha", "_row")) - 1
    return rows.withColumn("section_hash", F.sha2(joined, 256)).select(
        "doc_id", copy.alias("copy"), "paragraph", "start", "length", "section", "hash", "section_hash"
    )


def _opened(tree: DataFrame, other: DataFrame) -> DataFrame:
    """Paragraphs of the sections that the other tree does not hold as often."""
    numbered = lambda t: t.select("doc_id", "copy", "section", "section_hash").distinct().withColumn(
        "_nth", F.row_number().over(W.partitionBy("doc_id", "copy", "section_hash").orderBy("section"))
    )
    mine, theirs = numbered(tree).alias("a"), numbered(other).alias("b")
    names = ["doc_id", "copy", "section_hash", "_nth"]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]
    changed = mine.join(theirs, same, "left_anti").select("doc_id", "copy", "section").alias("c")
    here = [F.col(f"t.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("doc_id", "copy", "section")]
    held = tree.alias("t").join(changed, here, "left_semi")
    nth = F.row_number().over(W.partitionBy("doc_id", "copy", "hash").orderBy("paragraph"))
    return held.select("doc_id", "copy", "paragraph", "start", "length", "hash", nth.alias("_nth"))


def locate_edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changed between two tables of :func:`tree_rows`, document by document.

    ``doc_id``, ``copy``, ``edit``, ``hash``, and ``old_paragraph``, ``old_start``, ``new_paragraph``,
    ``new_start``, ``length``. Only sections that the other tree lacks (or holds less often) are
    opened. Their paragraphs are matched one to one, the first with the first of equal ones:
    without a match they were ``removed`` or ``added``; matched ones that no longer stand in the
    same place among the matched have ``moved``. Documents of one table alone are removed or
    added whole.
    """
    a, b = _opened(old, new).alias("a"), _opened(new, old).alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "copy", "hash", "_nth")]
    either = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    paired = a.join(b, same, "full").select(
        either("doc_id"),
        either("copy"),
        either("hash"),
        either("length"),
        *[F.col(f"{side}.{c}").alias(f"{name}_{c}") for side, name in (("a", "old"), ("b", "new")) for c in ("paragraph", "start")],
    )
    both = F.col("old_paragraph").isNotNull() & F.col("new_paragraph").isNotNull()
    place = lambda c: F.row_number().over(W.partitionBy("doc_id", "copy", both).orderBy(c))
    edit = (
        F.when(F.col("new_paragraph").isNull(), "removed")
        .when(F.col("old_paragraph").isNull(), "added")
        .when(place("old_paragraph") != place("new_paragraph"), "moved")
    )
    return paired.withColumn("edit", edit).filter("edit is not null").select(
        "doc_id", "copy", "edit", "hash", "old_paragraph", "old_start", "new_paragraph", "new_start", "length"
    )


def id_ranges(ids: DataFrame, name: str, parts: int) -> Column:
    """A number that grows with the long column ``name``, about ``parts`` different ones.

    At most ``RANGES`` quantiles are gathered, and each range between two is divided evenly.
    Nulls get no number.
    """
    coarse = max(1, min(parts, RANGES))
    fine = -(-parts // coarse)
    shares = [i / coarse for i in range(coarse + 1)]
    found = ids.agg(F.percentile_approx(name, shares, 10_000)).first()[0] or [0, 0]
    lows = sorted(set(found[:-1]))
    highs = [*lows[1:], max(found[-1], lows[-1] + 1)]
    at = F.greatest(F.size(F.filter(F.lit(lows), lambda low: low <= F.col(name))), F.lit(1))
    low, high = F.element_at(F.lit(lows), at), F.element_at(F.lit(highs), at)
    inside = F.floor((F.col(name).cast("double") - low) * fine / (high - low))
    bounded = F.greatest(F.lit(0), F.least(F.lit(fine - 1), inside))
    return F.when(F.col(name).isNotNull(), at.cast("long") * fine + bounded)


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each row of ``doc_id``, ``text`` with the columns of the row after it, named ``next_*``.

    The order is by id, nulls last, then by the text's SHA-256; after the last row comes the
    first. Rows are dealt to ranges of ids, and each range also gets a copy of the first
    row of the next one, so that no task holds more than a range. Texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    place = id_ranges(ids, "doc_id", parts)
    # Rows without an id are dealt by the start of their hash, after all others.
    by_hash = F.conv(F.substring(F.sha2("text", 256), 1, 2), 16, 10).cast("long") + (parts + RANGES) * 4
    ranged = docs.withColumn("_range", F.coalesce(place, by_hash))
    unnamed = F.when(F.col("doc_id").isNull(), F.sha2("text", 256))
    firsts = ranged.groupBy("_range").agg(F.min("doc_id").alias("_id"), F.min(unnamed).alias("_sha"))
    # One row per range: the range before it, for the first one the last.
    line = W.orderBy("_range")
    ends = firsts.select(
        F.col("_range").alias("_first"),
        "_id",
        "_sha",
        F.coalesce(F.lag("_range").over(line), F.max("_range").over(W.partitionBy())).alias("_before"),
    )
    is_first = (
        (F.col("_range") == F.col("_first"))
        & F.col("doc_id").eqNullSafe(F.col("_id"))
        & unnamed.eqNullSafe(F.col("_sha"))
    )
    copies = ranged.join(F.broadcast(ends), is_first).select(
        *docs.columns, F.col("_before").alias("_range"), F.lit(1).alias("_copy")
    )
    both = ranged.withColumn("_copy", F.lit(0)).unionByName(copies)
    order = W.partitionBy("_range").orderBy("_copy", F.col("doc_id").asc_nulls_last(), F.sha2("text", 256))
    nexts = [F.lead(c).over(order).alias(f"next_{c}") for c in docs.columns]
    return both.select(*docs.columns, "_copy", *nexts).filter("_copy = 0").drop("_copy")


def edit_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, and how alike they are.

    ``edit`` is the place of the edit in the tree, see :func:`edit_place`. The edited text is the text with its last ``floor(n_chars / 4)`` code points replaced by
    the first as many of the next document's (see :func:`with_next`).

    Defined cases: a null text is empty and its tree one empty paragraph; a null id stays
    null and comes last in the order; repeated rows stay and are each other's next; a table
    of one row has itself as next; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - quarter).cast("int"))
    paired = (
        with_next(slim)
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), quarter)))
    )
    trees = with_tree(with_tree(with_tree(paired, "text"), "edited", "edited_"), "next_text", "next_")
    trees = edit_place(trees, "edited_", "edit")
    mine = [F.col("root"), F.col("leaves")]
    return trees.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("root").alias("fingerprint"),
        F.col("edited_root").alias("edited_fingerprint"),
        likeness(*mine, F.col("edited_root"), F.col("edited_leaves")).alias("near_edited"),
        likeness(*mine, F.col("next_root"), F.col("next_leaves")).alias("near_next"),
        "edit",
    )
