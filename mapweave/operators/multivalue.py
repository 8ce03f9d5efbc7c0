"""Several values packed in one field, split into one row each with its place.

All of it is built from array functions. A value with quote marks or backslashes is split on its quote marks; the odd
pieces are literals; the even ones are split on delimiters; a fold over the pieces puts the items together again. In a
value without any, all of it is one even piece, so splitting it on delimiters is the whole job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Noncharacters, which are never text. One stands before a character that a backslash protects; the other, with a
# delimiter after it, for a noncharacter that stands in the value all the same.
_SHIELD, _OTHER = "\uffff", "\ufffe"
_FREE = r"\p{L}\p{M}\p{Nd}\p{Zs}.\-"  # what an item may hold outside quote marks
_BARE = f"(?s)[^{_FREE}]"
_TRIM = r"^[\p{Zs}\s]+|[\p{Zs}\s]+$"


def _plain_items(value: Column) -> Column:
    return F.transform(F.split(value, _BARE, -1), lambda s: F.regexp_replace(s, _TRIM, ""))


def _folded_items(value: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(value, _OTHER, _OTHER + ";"), _SHIELD, _OTHER + ",")
    marked = F.regexp_replace(marked, rf"\\{_OTHER}([;,])", f"{_SHIELD}{_OTHER}{_SHIELD}$1")
    marked = F.regexp_replace(marked, r"(?s)\\(.)", _SHIELD + "$1")
    marked = F.regexp_replace(marked, r"\\$", "")
    pieces = F.split(marked, f'(?<!{_SHIELD})"', -1)
    shielded_bare = f"(?s)(?<!{_SHIELD})[^{_FREE}{_SHIELD}]"

    def add(state: Column, i: Column) -> Column:
        piece = F.element_at(pieces, i)
        literal = i % 2 == 0
        between = (i % 2 == 1) & (i > 1) & (i < F.size(pieces)) & (piece == "")
        parts = F.split(piece, shielded_bare, -1)
        first, last = F.element_at(parts, 1), F.element_at(parts, -1)
        one = F.size(parts) == 1
        grown = F.when(literal, F.concat(state["open"], piece)).when(between, F.concat(state["open"], F.lit('"'))).when(one, F.concat(state["open"], piece)).otherwise(last)
        inner = F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.size(parts) - 2)).otherwise(F.array().cast("array<string>"))
        closed = F.when(literal | between | one, state["done"]).otherwise(F.concat(state["done"], F.array(F.concat(state["open"], first)), inner))
        return F.struct(closed.alias("done"), grown.alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    items = F.aggregate(F.sequence(F.lit(1), F.size(pieces)), start, add, lambda s: F.concat(s["done"], F.array(s["open"])))

    def bare(s: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(s, _SHIELD, ""), _TRIM, "")
        return F.regexp_replace(F.regexp_replace(s, _OTHER + ",", _SHIELD), _OTHER + ";", _OTHER)

    return F.transform(items, bare)


def packed_items(value: Column) -> Column:
    """The items of a packed value as an array of strings, in order.

    Outside quotes and escapes an item has letters with their marks, digits, blanks, hyphens and full stops; anything
    else (tabs and line ends too) parts items. Double quotes or a backslash protect what they cover and do not belong
    to the item; a doubled quote mark inside quotes stands for one; a quote that is never closed reaches to the end.
    Items are trimmed of blanks, empty ones left out. A null value gives null, an empty one an empty array.
    """
    items = F.when(value.rlike(r'["\\]'), _folded_items(value)).otherwise(_plain_items(value))
    return F.when(value.isNotNull(), F.filter(items, lambda s: s != ""))


def split_list_values(rows: DataFrame, row_id: str, keys: str, values: str, list_keys: DataFrame, key_name: str, at_least: int = 2) -> DataFrame:
    """One row per item of each packed value of a list key: ``row_id, tag_pos, item_pos, item``, places from 1.

    ``keys`` and ``values`` are arrays of equal length (a value without a key, or a key without a value, has no
    items); ``list_keys`` has the keys whose values may hold several items in column ``key_name``, compared exactly.
    Values of fewer than ``at_least`` items give no rows. Null arrays, keys and values give none; repeated rows give
    their items again. The key table is small by nature and joined by size, not by force; most values hold a single
    item and have left before anything is moved.
    """
    named = list_keys.select(F.col(key_name).alias("k")).where("k is not null").distinct()
    tags = rows.select(F.col(row_id).alias("rid"), F.posexplode(F.arrays_zip(F.col(keys).alias("k"), F.col(values).alias("v"))).alias("pos", "t"))
    tags = tags.select("rid", (F.col("pos") + 1).alias("tag_pos"), F.col("t.k").alias("k"), F.col("t.v").alias("v"))
    # A value of two items has something between them that parts them.
    may = F.col("v").rlike(f"[^{_FREE}]") if at_least > 1 else F.col("v").isNotNull()
    tags = tags.where(F.col("k").isNotNull() & may).join(named, "k")
    # Filters on the items would be moved below the join and their making repeated in each; none is moved over a column
    # that the optimizer may not compute twice, as one that looks at the row's number, always true, is to it.
    once = F.when(F.monotonically_increasing_id() >= 0, packed_items(F.col("v")))
    items = tags.select("rid", "tag_pos", once.alias("items")).where(F.size("items") >= at_least)
    out = items.select("rid", "tag_pos", F.posexplode("items").alias("p", "item"))
    return out.select(F.col("rid").alias(row_id), F.col("tag_pos").cast("int").alias("tag_pos"), (F.col("p") + 1).cast("int").alias("item_pos"), "item")
