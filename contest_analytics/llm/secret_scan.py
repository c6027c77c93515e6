"""Secrets in texts, with weak parts reported where complementary parts co-occur.

Three kinds stand on their own: ``assign`` (a password-like name set to 12 characters or
more), ``access`` (access key ids) and ``hex`` (long runs of hexadecimal digits). Many
credentials have several parts that look harmless alone: an identifier, a secret and an
endpoint. Weak candidates for each part are found as well, and an interval join inside
a scope (one paragraph, parts at most ``REACH`` code points apart) reports a weak
candidate only where both other parts are near, strong or weak.

| part | strong | weak |
| --- | --- | --- |
| identifier | access | login, client or key id set to a value |
| secret | assign, hex | a password-like name set to a shorter value; a mixed token of 20 or more |
| endpoint | | address with a scheme; host or IPv4 address with a port |

The interval join is a range frame over the parts of one scope in order of position, so
its work follows the number of parts and never makes pairs. Everything here is
DataFrame functions; only positions are shuffled, never texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contest_analytics.llm.common import free_name

# The patterns of the three base kinds.
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

#: Runs of the right length at once: a shorter run holds no longer one.
LONG_ACCESS = r"AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4)
LONG_HEX = r"[0-9a-f]{%d,}" % MIN_HEX

WEAK_ID = (
    r"""(?i:(client_?id|key_?id|user(?:_?name)?|login|account(?:_?id)?))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
)
WEAK_TOKEN = (
    r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=-]{0,64}[0-9])(?=[a-z0-9+/_=-]{0,64}[A-Z])"
    r"(?=[A-Z0-9+/_=-]{0,64}[a-z])[A-Za-z0-9+/_=-]{20,}"
)
#: A host with a port starts where no host letter stands before it, has a dot and at most 254 letters.
#: Its repeat gives nothing back, so a run of any length is read once.
ENDPOINT = (
    r"""(?:[a-z][a-z0-9+.:-]{1,20}://[^\s"'<>]+"""
    r"""|(?<![a-z0-9.-])(?=[a-z0-9-]{1,253}+\.[a-z0-9-])[a-z0-9][a-z0-9.-]{1,253}+:[0-9]{2,5})"""
)
#: Blank lines part paragraphs; a single line end does not.
BREAK = r"\n\s*\n"

#: Names in the order in which spans that start together are listed.
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "weak_token", "endpoint", "break"]
REACH = 400
MASK = "[SECRET]"
#: Code points of a block that pieces of a text are cut from.
STEP = 1024


def _found(text: Column, pattern: str, kind: str) -> Column:
    """Matches in order: (family, i, gap before it, size, kind).

    The pieces between the matches and the matches themselves give the positions.
    """
    # One array of pieces and one of matches, zipped; the last piece has no match.
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )

    def row(x: Column, i: Column) -> Column:
        hit = x["hit"]
        name = F.lit(KINDS.index(kind))
        if kind == "assign":
            # A short value is only a weak secret.
            strong = F.length(F.regexp_extract(hit, ASSIGN, 2)) >= MIN_ASSIGN
            name = F.when(strong, name).otherwise(F.lit(KINDS.index("weak_secret")))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("family"),
            i.alias("i"),
            F.length(x["piece"]).alias("gap"),
            F.length(hit).alias("size"),
            name.alias("kind"),
        )

    return F.transform(zipped, row)


def candidates(text: Column) -> Column:
    """All matches of one text. Cheap tests leave out patterns that cannot match."""
    none = F.filter(_found(F.lit(""), BREAK, "break"), lambda x: F.lit(False))
    sets = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    named = F.contains(text, F.lit("AKIA")) | (sets & text.rlike(WEAK_ID))
    guarded = [
        (sets & text.rlike(ASSIGN), ASSIGN, "assign"),
        (F.contains(text, F.lit("AKIA")), LONG_ACCESS, "access"),
        (text.rlike(LONG_HEX), LONG_HEX, "hex"),
        # Without an identifier no weak candidate can be reported.
        (named, WEAK_ID, "weak_id"),
        (named, WEAK_TOKEN, "weak_token"),
        (named, ENDPOINT, "endpoint"),
        (named, BREAK, "break"),
    ]
    return F.concat(*[F.when(test, _found(text, p, kind)).otherwise(none) for test, p, kind in guarded])


def _is(*kinds: str) -> Column:
    return F.col("kind").isin([KINDS.index(k) for k in kinds])


def _reported(docs: DataFrame, keep: list[str], text_col: str, reach: int) -> DataFrame:
    """The candidates of every row (``_row``), one row each, and whether they are ``reported``.

    A row without candidates has one row without a place.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Numbered before the rows multiply.
    numbered = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), text.alias("_text"))
    rows = numbered.select(*keep, "_row", F.explode_outer(candidates(F.col("_text"))).alias("_c")).select(
        *keep, "_row", "_c.*"
    )
    # From here on all work on one document is in one partition: a single shuffle.
    by_row = rows.repartition("_row")
    run = W.partitionBy("_row", "family").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(run)
    placed = by_row.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    line = W.partitionBy("_row").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, 0)
    scoped = placed.withColumn("scope", F.sum(_is("break").cast("int")).over(line))
    near = W.partitionBy("_row", "scope").orderBy("start").rangeBetween(-reach, reach)
    parts = {
        "identifier": _is("access", "weak_id"),
        "secret": _is("assign", "hex", "weak_secret", "weak_token"),
        "endpoint": _is("endpoint"),
    }
    # The interval join: which parts lie within reach of this one.
    together = reduce(lambda a, b: a & b, [F.max(has).over(near) for has in parts.values()])
    linked = scoped.withColumn("linked", F.coalesce(together, F.lit(False)))
    reported = F.col("size").isNotNull() & (
        _is("assign", "access", "hex") | (F.col("linked") & ~_is("break"))
    )
    return linked.withColumn("reported", F.coalesce(reported, F.lit(False)))


def spans(docs: DataFrame, keep: list[str], text_col: str = "text", reach: int = REACH) -> DataFrame:
    """``docs``' columns ``keep`` and ``spans``: structs (start, kind, end), sorted.

    One row per input row. Positions are code points from 0, ends exclusive; ``kind`` is a
    place in ``KINDS``.
    """
    span = F.when(F.col("reported"), F.struct("start", "kind", "end"))
    return (
        _reported(docs, keep, text_col, reach)
        .groupBy("_row")
        .agg(*[F.first(c).alias(c) for c in keep], F.array_sort(F.collect_list(span)).alias("spans"))
        .select(*keep, "spans")
    )


def _uncovered(docs: DataFrame, keep: list[str], text_col: str, reach: int = REACH) -> DataFrame:
    """``keep``, ``pieces`` and ``tail`` of rows with spans: what lies before each covered stretch
    (structs ``to``, ``from``, sorted) and where the last stretch ends."""
    line = W.partitionBy("_row").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, -1)
    before = F.max(F.when(F.col("reported"), F.col("end"))).over(line)
    rows = _reported(docs, keep, text_col, reach).withColumn("before", F.coalesce(before, F.lit(0)))
    fresh = F.col("reported") & (F.col("start") >= F.col("before"))
    piece = F.when(fresh, F.struct(F.col("start").alias("to"), F.col("before").alias("from")))
    return (
        rows.filter("reported")
        .groupBy("_row")
        .agg(
            *[F.first(c).alias(c) for c in keep],
            F.array_sort(F.collect_list(piece)).alias("pieces"),
            F.max("end").alias("tail"),
        )
        .drop("_row")
    )


def listed(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    )
    return F.array_join(F.transform(found, one), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Counts and places of the secrets of each row.

    Defined cases: null and empty texts have no spans (the digest is that of an empty
    string); null ids stay null; repeated rows stay; other columns are ignored; an empty
    table gives no rows. Spans of different kinds may overlap; spans that start together
    are in the order of ``KINDS``.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = spans(slim, ["doc_id"], "text", reach)
    base = F.filter("spans", lambda s: s["kind"] <= KINDS.index("hex"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def _masked(text: Column, blocks: Column, pieces: Column, tail: Column) -> Column:
    """The uncovered pieces of ``text``, joined by ``MASK``.

    Positions count code points, which a string only finds from its start; so a piece is cut
    out of ``blocks``, the text's stretches of ``STEP`` code points.
    """

    def block(i: Column) -> Column:
        return F.coalesce(F.get(blocks, i), F.lit(""))

    def cut(start: Column, end: Column) -> Column:
        first, last = F.floor(start / STEP).cast("int"), F.floor(end / STEP).cast("int")
        at, stop = (start % STEP).cast("int"), (end % STEP).cast("int")
        inner = F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0)))
        return F.when(first == last, F.substring(block(first), at + 1, stop - at)).otherwise(
            F.concat(F.substring(block(first), at + 1, F.lit(STEP)), F.array_join(inner, ""), F.substring(block(last), F.lit(1), stop))
        )

    kept = F.transform(pieces, lambda p: cut(p["from"], p["to"]))
    return F.array_join(F.concat(kept, F.array(cut(tail, F.length(text)))), MASK)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its secrets masked and ``n_chars``, if there, recounted.

    Defined cases: rows without any candidate pass unchanged and are not shuffled; null texts
    stay null; rows of any id, null or repeated, are masked alike and stay; columns of any
    other name stay as they are; an empty table gives no rows. Stretches that touch have a
    mask each, those that overlap share one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    may = text.rlike(LONG_HEX) | text.rlike(LONG_ACCESS) | text.rlike(ASSIGN) | text.rlike(WEAK_ID)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    # Equal ids and texts have equal spans, so this key serves repeated rows too.
    key, held, tail, blocks = (free_name(docs, n) for n in ("_key", "_pieces", "_tail", "_blocks"))
    keyed = docs.filter(may).withColumn(key, F.sha2(F.concat_ws(":", name, text), 256))
    once = keyed.select(F.col(key).alias("_key"), F.col(text_col).alias("text")).dropDuplicates(["_key"])
    found = _uncovered(once, ["_key"], "text").toDF(key, held, tail)
    cut = F.when(F.col(held).isNotNull(), F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % STEP), F.lit(0)))
    masked = keyed.join(found, key, "left").withColumn(blocks, cut)
    clean = F.when(F.col(held).isNull(), F.col(text_col)).otherwise(
        _masked(F.col(text_col), F.col(blocks), F.col(held), F.col(tail))
    )
    masked = masked.withColumn(text_col, clean)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.length(text_col).cast(kind))
    return docs.filter(~may).unionByName(masked.select(*docs.columns))
