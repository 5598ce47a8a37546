"""Lines of text rebuilt from the boxes of printed glyphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: A gap of over this share of a row's median glyph width is a space; fixed value.
WORD_GAP = 0.3


def rebuilt_text(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and text: the lines of each page, top down, each read from the right.

    glyphs has the keys of a page, `at` (the order in which glyphs were drawn, for equal places; where it is equal too, x1 and the glyph decide), glyph, x0, y0, x1, y1.
    Glyphs whose boxes have the same rounded middle are a row; blank glyphs say nothing, as spaces stand anywhere. Gaps are
    measured with stretches in place, which are then left out; a row without a letter of any width is dropped. A window
    holds one row of a page, a group one page.
    """
    row = [*keys, "_row"]
    own = glyphs.where(X.strip(X.blank(F.col("glyph"))) != "").withColumn("_row", F.bround((F.col("y0") + F.col("y1")) / 2, 0))
    letter = (F.col("x1") > F.col("x0")) & (F.col("glyph") != X.STRETCH) & ~F.col("glyph").rlike(f"^{X.VOWEL_MARKS}")
    width = F.median(F.when(letter, F.col("x1") - F.col("x0"))).over(Window.partitionBy(*row))
    before = F.lag("x0").over(Window.partitionBy(*row).orderBy(F.desc("x0"), "at", "x1", "glyph"))
    measured = own.withColumns({"_width": width, "_before": before}).where(F.col("_width").isNotNull())
    space = F.when(F.col("_before") - F.col("x1") > F.col("_width") * WORD_GAP, " ").otherwise("")
    piece = F.struct((-F.col("x0")).alias("x"), "at", "x1", "glyph", F.concat(space, F.when(F.col("glyph") == X.STRETCH, "").otherwise(F.col("glyph"))).alias("piece"))
    read = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["piece"]), "")
    lines = measured.groupBy(*row).agg(X.merge_orphans(read).alias("_line")).where("_line <> ''")
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "_line"))), lambda x: x["_line"]), "\n")
    return lines.groupBy(*keys).agg(page.alias("text"))
