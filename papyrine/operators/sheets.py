"""Which appendix sheet of a page belongs to the card's holder.

Sheets: page_id, pos, id_number, first_name_he, last_name_he, street, children_ids (array),
spouse_id. Cards, one a page: page_id, card_id, card_first, card_last. A sheet without a card
stays as it is.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from papyrine.functions.identifiers import id_check
from papyrine.functions.names import alphanumeric

LAST_NAME_RATIO = 0.8


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def _given(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _same_id(a: Column, b: Column) -> Column:
    return _given(a) & _given(b) & (F.ltrim(a, F.lit("0")) == F.ltrim(b, F.lit("0")))


def _same_name(a: Column, b: Column) -> Column:
    return _given(a) & _given(b) & (alphanumeric(a) == alphanumeric(b))


def same_holder() -> Column:
    """First names equal and last names alike (similarity 0.8)."""
    last = _given(F.col("last_name_he")) & _given(F.col("card_last"))
    return _same_name(F.col("first_name_he"), F.col("card_first")) & last & (_ratio(alphanumeric(F.col("last_name_he")), alphanumeric(F.col("card_last"))) >= LAST_NAME_RATIO)


def matched_by_name(sheets: DataFrame, cards: DataFrame) -> DataFrame:
    """Differing numbers of one holder by name become the valid side's: id_number and card_id are
    corrected where one fails its check digit; two valid numbers stay two people's."""
    joined = sheets.join(cards, "page_id", "left").withColumns({"_s": F.coalesce(id_check(F.col("id_number")), F.lit(False)), "_c": F.coalesce(id_check(F.col("card_id")), F.lit(False)), "_same": same_holder()})
    theirs, ours = F.col("id_number"), F.col("card_id")
    fix = _given(theirs) & _given(ours) & ~_same_id(theirs, ours) & ~(F.col("_s") & F.col("_c")) & F.col("_same")
    card_wins = F.col("_c") | ~F.col("_s")
    return joined.withColumns({"id_number": F.when(fix & card_wins, ours).otherwise(theirs), "card_id": F.when(fix & ~card_wins, theirs).otherwise(ours)}).drop("_s", "_c", "_same")


def holder_verdict(joined: DataFrame) -> DataFrame:
    """Add ``holder`` where numbers differ: ``names`` (both match), ``unread`` (a name is missing)
    or ``other``."""
    differ = _given(F.col("id_number")) & _given(F.col("card_id")) & (alphanumeric(F.col("id_number")) != alphanumeric(F.col("card_id")))
    full = _given(F.col("first_name_he")) & _given(F.col("last_name_he")) & _given(F.col("card_first")) & _given(F.col("card_last"))
    return joined.withColumn("_same", same_holder()).withColumn("holder", F.when(differ, F.when(F.col("_same"), "names").when(full, "other").otherwise("unread"))).drop("_same")


def selected(joined: DataFrame) -> DataFrame:
    """(page_id, pos, id_number, id_confidence, warnings): the first sheet of each page that is not
    another person's."""
    judged = holder_verdict(joined)
    own = Window.partitionBy("page_id")
    kept = F.coalesce(F.col("holder") != "other", F.lit(True))
    told = judged.withColumns(
        {
            "_others": F.count_if(~kept).over(own),
            "_extra": F.count_if(kept).over(own) - 1,
            "_n": F.row_number().over(own.orderBy(F.desc(kept), "pos")),
        }
    ).filter((F.col("_n") == 1) & kept)
    wrong = F.filter(F.transform(F.coalesce("children_ids", F.array().cast("array<string>")), lambda c, i: F.when(~F.coalesce(id_check(c), F.lit(True)), F.format_string("Sefach: child #%d ID number failed its check-digit test", i + 1))), lambda x: x.isNotNull())
    warnings = F.concat(
        F.array_compact(
            F.array(
                F.when(F.col("_others") > 0, F.lit("Ignored a sefach belonging to a different person (ID number differs)")),
                F.when(F.col("holder") == "names", F.lit("Sefach ID number differs from the card, but both names match: kept, with the card's number")),
                F.when(F.col("holder") == "unread", F.lit("Sefach ID number differs from the card and the sheet's own names were not read: kept as it is — check that it belongs to this person")),
                F.when(F.col("_extra") > 0, F.lit("Several sefach regions found — only the first was kept")),
            )
        ),
        wrong,
        F.array_compact(F.array(F.when(~F.coalesce(id_check(F.col("spouse_id")), F.lit(True)), F.lit("Sefach: spouse ID number failed its check-digit test")))),
    )
    number = F.when(F.col("holder") == "names", F.col("card_id")).otherwise(F.col("id_number"))
    confidence = F.when(F.col("holder") == "names", "medium").when(F.col("holder") == "unread", "low").otherwise("high")
    return told.select("page_id", "pos", number.alias("id_number"), confidence.alias("id_confidence"), warnings.alias("warnings"))


def needs_rescue(joined: DataFrame) -> DataFrame:
    """Add ``rescue``: the numbers differ, or the first name is the street (a shifted block)."""
    differ = _given(F.col("id_number")) & _given(F.col("card_id")) & ~_same_id(F.col("id_number"), F.col("card_id"))
    shifted = _given(F.col("card_id")) & _same_name(F.col("first_name_he"), F.col("street"))
    return joined.withColumn("rescue", differ | shifted)


def reread_verdict(id_number: Column, first: Column, last: Column) -> Column:
    """How a re-read holder block is accepted: by id, by names, or not (null)."""
    both = _same_name(first, F.col("card_first")) & _same_name(last, F.col("card_last"))
    return F.when(_same_id(id_number, F.col("card_id")), "id").when(both, "names")


def completed_names(joined: DataFrame) -> DataFrame:
    """Names that are a strict beginning of the card's become the card's; ``cut_short`` lists them."""
    pairs = [("last_name_he", "card_last"), ("first_name_he", "card_first")]
    cut = {a: _given(F.col(a)) & _given(F.col(b)) & (F.col(a) != F.col(b)) & F.col(b).startswith(F.col(a)) for a, b in pairs}
    listed = F.array_compact(F.array(*[F.when(c, F.lit(a)) for a, c in cut.items()]))
    return joined.withColumn("cut_short", listed).withColumns({a: F.when(F.array_contains("cut_short", a), F.col(b)).otherwise(F.col(a)) for a, b in pairs})
