"""Heading structure of line tables as windows: which section a line stands in, and the headings above it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HEADING, _FENCE, DEEPEST = r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", r"^[ ]{0,3}(```|~~~)", 6


def sections(lines: DataFrame) -> DataFrame:
    """Adds to lines (document_id, pos, line): level (1 to 6 of a heading, else null), heading (its text), section (headings so far, the
    line's own counted; 0 before the first) and ancestors (texts of the headings that the line stands under, outermost first, without its own).

    A heading ends all sections of its level or a deeper one, so of each level only the last heading counts that no shallower one followed.
    Lines within a code fence, and its marks, are no headings. Null lines are text. Positions order a document's lines and are its own.
    """
    order = Window.partitionBy("document_id").orderBy("pos")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    text = F.coalesce("line", F.lit(""))
    mark = text.rlike(_FENCE)
    inside = F.coalesce(F.sum(mark.cast("int")).over(before), F.lit(0)) % 2 == 1
    level = F.when(~inside & ~mark, F.nullif(F.length(F.regexp_extract(text, _HEADING, 1)), F.lit(0)))
    rows = lines.withColumn("level", level).withColumn("heading", F.when(F.col("level").isNotNull(), F.regexp_extract(text, _HEADING, 2)))
    at = {k: F.last(F.when(F.col("level") == k, F.struct("pos", "heading")), ignorenulls=True).over(before) for k in range(1, DEEPEST + 1)}
    rows = rows.withColumns({f"__h{k}": c for k, c in at.items()} | {"section": F.coalesce(F.count("level").over(so_far), F.lit(0))})
    found = []
    for k in range(1, DEEPEST + 1):
        shallower = F.greatest(*(F.col(f"__h{j}.pos") for j in range(1, k)), F.lit(-1), F.lit(-1)) if k > 1 else F.lit(-1)
        found.append(F.when((F.col(f"__h{k}.pos") > shallower) & (F.col("level").isNull() | (F.col("level") > k)), F.col(f"__h{k}.heading")))
    return rows.withColumn("ancestors", F.array_compact(F.array(*found))).drop(*(f"__h{k}" for k in range(1, DEEPEST + 1)))
