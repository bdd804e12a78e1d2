"""Which frames of a page are read, and how many documents they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.geometry import low_resolution

# Kinds of frames.
IDENTITY_KINDS = ["teudat_zehut", "teudat_zehut_back", "sefach", "israeli_passport", "foreign_passport", "drivers_license", "senior_citizen_card", "disability_card", "weapon_license"]
CHEQUE_KINDS = ["cheque_front", "cheque_back"]
MAX_CANDIDATES = 4


def candidates(frames: DataFrame, page: str = "page_id") -> DataFrame:
    """The first four possible frames (page, idx, kind) of each page; ``kind`` none is impossible."""
    order = Window.partitionBy(page).orderBy("idx")
    possible = frames.filter(~F.col("kind").eqNullSafe("none"))
    return possible.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= MAX_CANDIDATES).drop("_n")


def selected(frames: DataFrame, page: str = "page_id") -> DataFrame:
    """``frames`` (page, idx, kind, top) with ``read``: all identity frames of a page, or without
    one the topmost cheque front and the topmost back (ties by ``idx``)."""
    whole = Window.partitionBy(page)
    identity = F.col("kind").isin(IDENTITY_KINDS)
    place = F.row_number().over(Window.partitionBy(page, "kind").orderBy("top", "idx"))
    first_side = F.col("kind").isin(CHEQUE_KINDS) & (F.col("_place") == 1)
    ranked = frames.withColumns({"_identity": F.coalesce(F.bool_or(identity).over(whole), F.lit(False)), "_place": place})
    return ranked.withColumn("read", F.coalesce(F.when(F.col("_identity"), identity).otherwise(first_side), F.lit(False))).drop("_identity", "_place")


def back_inherits(frames: DataFrame, page: str = "page_id") -> DataFrame:
    """Add ``confirmed``: a cheque back on a page with a sure front counts as sure."""
    front = F.bool_or((F.col("kind") == "cheque_front") & F.col("sure")).over(Window.partitionBy(page))
    return frames.withColumn("confirmed", F.coalesce(F.col("sure") | ((F.col("kind") == "cheque_back") & front), F.lit(False)))


def mergeable(results: DataFrame, page: str = "page_id") -> DataFrame:
    """Results without other and unreadable ones, unless a page has nothing else."""
    good = ~F.col("document_type").isin("other", "unreadable")
    any_good = F.bool_or(good).over(Window.partitionBy(page))
    return results.withColumn("_any", any_good).filter(good | ~F.col("_any")).drop("_any")


def resolution_warning(frames: DataFrame, page: str = "page_id") -> DataFrame:
    """The lowest resolution of each page's read frames and whether it is too low."""
    lowest = frames.groupBy(page).agg(F.min("dpi").alias("dpi"))
    return lowest.withColumn("low", low_resolution(F.col("dpi")))


def region_order(box: Column) -> list[Column]:
    """Sort keys of boxes: top to bottom, then left to right."""
    return [box[1], box[0]]
