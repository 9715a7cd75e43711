"""Cell streams: offsets, control pairs, math groups, runs and their positions.

Cells are (doc_id, pos, mask, page_no, line_no, col_no).  Windows are keyed by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def _doc():
    return Window.partitionBy("doc_id")
#: Control pairs of masks that are no text.
CONTROL_FIRST, CONTROL_SECOND = 24, (2, 54, 4)


def stream_offsets(lines: DataFrame) -> DataFrame:
    """Offsets of pages and lines in the document stream, one blank between lines and between pages.

    Page totals are summed first, so only a page's lines and a document's pages are ever ordered.
    """
    size = F.length("raw_line") + 1
    pages = lines.groupBy("doc_id", "page_no").agg((F.sum(size) - 1).alias("cells"))
    before = _doc().orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.select("doc_id", "page_no", F.coalesce(F.sum(F.col("cells") + 1).over(before), F.lit(0)).alias("page_offset"))
    inside = Window.partitionBy("doc_id", "page_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("inside", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(pages, ["doc_id", "page_no"])
    return rows.select("doc_id", "page_no", "line_no", (F.col("page_offset") + F.col("inside")).alias("line_offset"), "page_offset")


def group_math_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (starts and ends counted) between an opening surplus and balance 0 form a group; surplus ends go to review."""
    page = Window.partitionBy("doc_id", "page_no").orderBy("seq")
    rows = blocks.withColumn("s", F.sum(F.col("starts") - F.col("ends")).over(page))
    rows = rows.withColumn("balance", F.col("s") - F.least(F.lit(0), F.min("s").over(page)))
    rows = rows.withColumn("prev", F.coalesce(F.lag("balance").over(page), F.lit(0)))
    group = F.sum((F.col("prev") == 0).cast("int")).over(page)
    status = F.when(F.col("prev") + F.col("starts") - F.col("ends") < 0, "REVIEW").otherwise("PASS")
    return rows.select("doc_id", "page_no", "seq", group.alias("group_no"), "balance", status.alias("status"))


def strip_control_pairs(cells: DataFrame) -> DataFrame:
    """Remove control pairs; the raw position stays.  No second cell opens a pair, so pairs cannot overlap."""
    own = _doc().orderBy("pos")
    opens = (F.col("mask") == CONTROL_FIRST) & F.lead("mask").over(own).isin(*CONTROL_SECOND)
    closes = (F.lag("mask").over(own) == CONTROL_FIRST) & F.col("mask").isin(*CONTROL_SECOND)
    rows = cells.withColumn("gone", F.coalesce(opens, F.lit(False)) | F.coalesce(closes, F.lit(False))).where("NOT gone").drop("gone")
    return rows.withColumn("raw_pos", F.col("pos")).withColumn("pos", (F.row_number().over(_doc().orderBy("raw_pos")) - 1).cast("long"))
