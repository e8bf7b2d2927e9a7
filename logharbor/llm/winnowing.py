"""Winnowed document fingerprints, in DataFrame functions only.

The words of a text (runs between ASCII white space, lowered) give a hash for every GRAM neighbours. Of every WINDOW
neighbouring hashes the smallest is kept, of equal ones the rightmost, with its position. Two texts that share
WINDOW + GRAM - 1 words in a row share a kept hash, wherever these words stand.

A kept hash and its position are one long, hash first and position falling, so that the minimum is the rule above:
33 bits of hash and 30 of position, which is more words than a text can have.

Results: a text of fewer than GRAM words is one gram of all its words; null and empty texts, and such of white space
only, have no fingerprint, and two texts without one are alike; equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logharbor.llm.common import texts

GRAM, WINDOW = 5, 8
POSITION_BITS = 30
SPACES = " \t\n\x0b\f\r"
#: Neighbouring ids that are ordered in one task, and the most such cells there are.
CELL_IDS, CELLS = 256, 1 << 16


def words(text: Column) -> Column:
    trimmed = F.btrim(F.lower(text), F.lit(SPACES))
    return F.when(trimmed != "", F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The kept (hash, position) codes of a text, by position; null without words."""

    def codes(tokens: Column) -> Column:
        def code(i: Column) -> Column:
            hashed = F.shiftrightunsigned(F.xxhash64(F.slice(tokens, i, gram)), 64 - 33)
            return F.shiftleft(hashed, POSITION_BITS) + (F.lit(1 << POSITION_BITS) - i)

        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (gram - 1), F.lit(1)))
        return F.when(tokens.isNotNull(), F.transform(starts, code))

    def least(coded: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(coded) - (window - 1), F.lit(1)))
        # Minima of neighbouring windows repeat; a code names its position, so repeats are the same hash.
        minima = F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(coded, i, window))))
        return F.when(coded.isNotNull(), minima)

    # Each array is bound once by a transform over a single element.
    one = F.transform(F.array(words(text)), lambda t: codes(t))
    return F.element_at(F.transform(one, least), 1)


def kept_hash(code: Column) -> Column:
    return F.shiftright(code, POSITION_BITS)


def position(code: Column) -> Column:
    """The 1-based number of the gram's first word."""
    return F.lit(1 << POSITION_BITS) - code.bitwiseAND((1 << POSITION_BITS) - 1)


def hashes(codes: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(codes, F.array().cast("array<bigint>")), kept_hash))


def likeness(a: Column, b: Column) -> Column:
    """Shared kept hashes among all of two sets (Jaccard); 1 if neither has any."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / F.greatest(every, F.lit(1)))


def digest(codes: Column) -> Column:
    return F.sha2(F.array_join(F.coalesce(codes, F.array().cast("array<bigint>")).cast("array<string>"), ","), 256)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, position) of every kept gram of every row."""
    codes = texts(docs).select("doc_id", F.explode(winnow(F.col("text"))).alias("_code"))
    return codes.select("doc_id", kept_hash(F.col("_code")).alias("hash"), position(F.col("_code")).alias("position"))


def with_next(rows: DataFrame, *columns: str) -> DataFrame:
    """rows (doc_id, ...) with ``next_`` and the name for each of these columns: their values in the row that follows
    by doc_id; after the last row comes the first. Rows of one doc_id are ordered by the first column's hash; a null doc_id comes first.

    Ids are cut into cells of equal width, at most CELLS of them, so rows are shuffled once, by cell, and the first
    row of each cell is sent to the cell before as well.
    """
    rows = rows.withColumn("_h", F.xxhash64(columns[0]))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = max(CELL_IDS, -(-((high or 0) - (low or 0) + 1) // CELLS))
    rows = rows.withColumn("_cell", F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)) / width), F.lit(-1)))
    id_first = F.col("doc_id").asc_nulls_first()
    first_ids = rows.groupBy("_cell").agg(F.min("doc_id").alias("_id"))
    # The hash is wanted for the first id of a cell only: both steps keep plain longs in their aggregates.
    first = (
        rows.select("_cell", "doc_id", "_h")
        .join(F.broadcast(first_ids), "_cell")
        .filter(F.col("doc_id").eqNullSafe(F.col("_id")))
        .groupBy("_cell")
        .agg(F.min("_h").alias("_first"), F.min("_id").alias("_id"))
    )
    found = sorted(first.collect())  # CELLS + 1 rows at most
    before = [found[i - 1][0] for i in range(len(found))]
    ahead = rows.sparkSession.createDataFrame(
        [(r[0], r[1], r[2], b) for r, b in zip(found, before, strict=True)],
        "_cell bigint, _first bigint, _id bigint, _to bigint",
    )
    # At most CELLS + 1 rows of four longs.
    marked = rows.join(F.broadcast(ahead), "_cell", "left")
    is_first = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_first"))
    here = F.struct(F.col("_cell").alias("_at"), F.lit(False).alias("_ahead"))
    there = F.struct(F.col("_to").alias("_at"), F.lit(True).alias("_ahead"))
    places = F.when(is_first, F.array(here, there)).otherwise(F.array(here))
    dealt = marked.withColumn("_place", F.explode(places)).select(*rows.columns, "_place._at", "_place._ahead")
    order = Window.partitionBy("_at").orderBy("_ahead", id_first, "_h")
    # Column by column: a struct would be built before the shuffle and double it.
    followed = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return followed.filter(~F.col("_ahead")).drop("_h", "_cell", "_at", "_ahead")


def edited_documents(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside those of an edited copy and of the next document.

    The edited text has its last quarter of characters (rounded down) replaced by as many of the next document's
    first ones, or all it has. Columns: doc_id, n_chars, edited, codes, edited_codes, near_edited, near_next.
    """
    # A text's own codes travel with it, so that the next document's need not be made again.
    own = texts(docs).withColumn("codes", winnow(F.col("text")))
    followed = with_next(own, "text", "codes")
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = followed.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        edited.alias("edited"),
        "codes",
        F.col("next_codes").alias("_next"),
    ).withColumn("edited_codes", winnow(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited",
        "codes",
        "edited_codes",
        likeness(hashes(F.col("codes")), hashes(F.col("edited_codes"))).alias("near_edited"),
        likeness(hashes(F.col("codes")), hashes(F.col("_next"))).alias("near_next"),
    )
