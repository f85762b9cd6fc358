"""Differences of texts as hunks: changed runs of lines with some equal lines around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = 3


def hunks(edits: DataFrame, key: str = "id", context: int = CONTEXT) -> DataFrame:
    """edits (key, op, old_from, old_to, new_from, new_to), cut to hunks, with their number and place.

    Equal runs keep context lines next to a change; where one is longer than twice that, a hunk ends and the next begins. Texts without a change
    have none; a text too large to compare (op null) keeps its one row, as hunk 0.
    """
    along = Window.partitionBy(key).orderBy("old_from", "new_from")
    whole = Window.partitionBy(key)
    marked = edits.withColumns({"n": F.row_number().over(along), "last": F.count("*").over(whole), "changes": F.sum((F.col("op").isNull() | (F.col("op") != "equal")).cast("int")).over(whole)}).where("changes > 0")
    size = F.col("old_to") - F.col("old_from")
    piece = lambda head, tail, opens: F.struct(
        (F.col("old_from") + head).alias("old_from"), (F.col("old_to") - tail).alias("old_to"), (F.col("new_from") + head).alias("new_from"), (F.col("new_to") - tail).alias("new_to"), F.lit(opens).alias("opens")
    )
    spare = F.greatest(size - context, F.lit(0))
    none = F.lit(0)
    pieces = (
        F.when(F.col("op").isNull() | (F.col("op") != "equal"), F.array(piece(none, none, 0)))
        .when(F.col("n") == 1, F.array(piece(spare, none, 0)))
        .when(F.col("n") == F.col("last"), F.array(piece(none, spare, 0)))
        .when(size > 2 * context, F.array(piece(none, spare, 0), piece(spare, none, 1)))
        .otherwise(F.array(piece(none, none, 0)))
    )
    cut = marked.select(key, "op", "n", F.posexplode(pieces).alias("part", "p")).select(key, "op", "n", "part", "p.*")
    order = Window.partitionBy(key).orderBy("n", "part")
    numbered = cut.withColumns({"hunk": F.sum("opens").over(order), "place": F.row_number().over(order)})
    return numbered.select(key, "hunk", "place", "op", "old_from", "old_to", "new_from", "new_to")


def hunk_lines(found: DataFrame, pairs: DataFrame, key: str = "id", old: str = "old", new: str = "new") -> DataFrame:
    """(key, hunk, place, line, op, text): the lines of hunks; a replaced run is its old lines, then the new ones."""
    lines = lambda c: F.split(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029]", "\n"), "\n")
    texts = pairs.select(F.col(key).alias("_k"), lines(old).alias("_old"), lines(new).alias("_new"))
    run = lambda c, a, b, op: F.transform(F.slice(c, F.col(a) + 1, F.col(b) - F.col(a)), lambda t: F.struct(F.lit(op).alias("op"), t.alias("text")))
    rows = F.when(F.col("op") == "equal", run(F.col("_old"), "old_from", "old_to", "equal")).when(F.col("op").isNotNull(), F.concat(run(F.col("_old"), "old_from", "old_to", "delete"), run(F.col("_new"), "new_from", "new_to", "insert")))
    return found.join(texts, F.col(key) == F.col("_k")).select(key, "hunk", "place", F.posexplode(rows).alias("line", "row")).select(key, "hunk", "place", "line", "row.op", "row.text")
