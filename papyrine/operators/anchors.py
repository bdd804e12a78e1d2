"""Values found by their printed labels in a page's transcript (an ordered array of lines).

Labels are transcribed with errors, so longer ones match by sequence similarity. Spark has no
such function: :func:`similarity` runs in Arrow batches, on the few line cores that could reach
the threshold by their lengths.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from papyrine.functions.identifiers import cheque_reference, first_valid_id
from papyrine.functions.names import arabic_core, hebrew_core, without_points

# Labels by field, other label cores of the old card, sex words, thresholds.
FIRST_NAME = ["השםהפרטי", "שםפרטי"]
GATED = {
    "sex": ["המין", "الجنس"],
    "place_of_birth": ["מקוםהלידה", "מקוםלידה", "مكانالولادة"],
    "father_name_he": ["שםהאב", "اسمالأب"],
    "mother_name_he": ["שםהאם", "اسمالأم"],
}
VALIDITY = ["בתוקףעד", "בתוקף", "בתקף"]
OLD_CARD = ["שםהמשפחה", "השםהפרטי", "שםהפרטי", "שםהאב", "שםהאם", "תאריךהלידה", "מקוםהלידה", "המין", "ניתנהב", "ניתןב"]
SEX_WORDS = {"זכר": "M", "נקבה": "F", "ذكر": "M", "زكر": "M", "أنثى": "F", "انثى": "F", "أنثي": "F"}
DISABILITY_TITLES, ID_CARD_TITLES = ["תעודתנכה", "תעודתנכהצהל"], ["תעודתזהות"]
FUZZY, FIRST_NAME_FUZZY, EXACT_UP_TO = 0.75, 0.6, 5
NAME_LIKE = r"^[א-ת][א-ת\s'\"׳״-]{0,24}$"


@F.pandas_udf(ArrayType(DoubleType()))
def _ratios(cores: pd.Series, labels: pd.Series) -> pd.Series:
    def best(core: str, variants: list[str]) -> float:
        # the ratio is at most twice the shorter length over both
        able = [v for v in variants if core and 2 * min(len(core), len(v)) >= 0.5 * (len(core) + len(v))]
        return max((difflib.SequenceMatcher(None, core, v).ratio() for v in able), default=0.0)

    return pd.Series([[best(c, list(v)) for c in lines] for lines, v in zip(cores, labels)])


def similarity(cores: Column, labels: list[str]) -> Column:
    """For each core the best sequence similarity to a label (0 where it is below a quarter)."""
    return _ratios(cores, F.array(*[F.lit(x) for x in labels]))


def label_scores(lines: Column, labels: list[str]) -> Column:
    """Score of each line: similarity for long Hebrew cores, 1 or 0 for short and Arabic ones."""
    hebrew, arabic = [v for v in labels if "א" <= v[0] <= "ת"], [v for v in labels if not "א" <= v[0] <= "ת"]
    cores = F.transform(lines, hebrew_core)
    fuzzy = similarity(cores, hebrew)

    def score(x: Column) -> Column:
        line, core = x["line"], hebrew_core(x["line"])
        exact = (F.length(core) >= 3) & core.isin(hebrew)
        if arabic:
            exact = exact | arabic_core(line).isin(arabic)
        return F.when(exact, 1.0).when(F.length(core) > EXACT_UP_TO, x["ratio"]).otherwise(0.0)

    # Python results are arguments of the lambda's array: they cannot stand inside a lambda
    return F.transform(F.arrays_zip(lines.alias("line"), fuzzy.alias("ratio")), score)


def has_label(lines: Column, labels: list[str]) -> Column:
    return F.exists(label_scores(lines, labels), lambda s: s >= FUZZY)


def printed_labels(lines: Column) -> Column:
    """Gated fields whose label is printed, and date_of_expiry by its validity label."""
    every = GATED | {"date_of_expiry": VALIDITY}
    return F.array_compact(F.array(*[F.when(has_label(lines, labels), F.lit(f)) for f, labels in every.items()]))


def _name_like(line: Column) -> Column:
    bare = without_points(line)
    return F.when((bare != "") & bare.rlike(NAME_LIKE), bare)


def _person(line: Column) -> Column:
    """A name, which no label of the old card is."""
    return F.when(~hebrew_core(line).isin(OLD_CARD), _name_like(line))


def names(lines: Column) -> Column:
    """Struct (last_name_he, first_name_he): the lines above and below the best first-name label. A
    name may be as similar to that label as a garbled one; the labels around it are no names."""
    zipped = F.arrays_zip(lines.alias("line"), similarity(F.transform(lines, hebrew_core), FIRST_NAME).alias("ratio"))
    scores = F.transform(zipped, lambda x: F.when((x["ratio"] >= FIRST_NAME_FUZZY) & (F.length(hebrew_core(x["line"])) >= 4), x["ratio"]).otherwise(0.0))
    best = F.array_max(scores)
    at = F.when(best > 0, F.array_position(scores, best).cast("int") - 1)
    near = lambda i: _person(F.get(lines, i))
    return F.struct(near(at - 1).alias("last_name_he"), near(at + 1).alias("first_name_he"))


def parents(lines: Column) -> Column:
    """Struct (father_name_he, mother_name_he, last_name_he, first_name_he) of an old card: values
    follow their group of labels in order; two values for three labels tell nothing."""
    core_at = lambda core: F.array_position(F.transform(lines, hebrew_core), F.lit(core)).cast("int")
    after = lambda at: F.when(at > 0, F.slice(lines, at + 1, F.size(lines)))
    zero = F.struct(F.array().cast("array<string>").alias("run"), F.lit(False).alias("done"))

    def step(state: Column, line: Column) -> Column:
        name = _person(line)
        ends = name.isNull() & ((F.size(state["run"]) > 0) | (hebrew_core(line) != ""))
        run = F.when(~state["done"] & name.isNotNull(), F.concat(state["run"], F.array(name))).otherwise(state["run"])
        return F.struct(run.alias("run"), (state["done"] | ends).alias("done"))

    run = F.aggregate(after(core_at("שםהאב")), zero, step)["run"]
    nth = lambda n: F.when(F.size(run) >= 3, F.get(run, F.lit(n)))
    father = F.when(F.size(run) == 1, F.get(run, F.lit(0))).otherwise(nth(2))
    mothers = F.filter(F.transform(after(core_at("שםהאם")), _person), lambda x: x.isNotNull())
    mother = F.coalesce(F.try_element_at(mothers, F.lit(1)), F.get(run, F.lit(3)))
    return F.struct(father.alias("father_name_he"), mother.alias("mother_name_he"), nth(0).alias("last_name_he"), nth(1).alias("first_name_he"))


def sex(lines: Column) -> Column:
    """M or F where the label is printed and a line is a sex word."""
    words = F.create_map(*[F.lit(x) for pair in SEX_WORDS.items() for x in pair])
    found = F.filter(F.transform(lines, lambda x: F.try_element_at(words, without_points(x))), lambda x: x.isNotNull())
    return F.when(has_label(lines, GATED["sex"]), F.try_element_at(found, F.lit(1)))


def titled_type(lines: Column) -> Column:
    """disability_card where its title fits a line well and better than the identity card's."""
    own, other = (F.array_max(label_scores(lines, titles)) for titles in (DISABILITY_TITLES, ID_CARD_TITLES))
    return F.when((own >= FUZZY) & (own > other), "disability_card")


def with_anchors(records: DataFrame, lines: str = "lines") -> DataFrame:
    """Add ``anchors`` (map of field to value, names over parents) and ``printed`` (labels)."""
    x = F.col(lines)
    found = {"_names": names(x), "_parents": parents(x), "_sex": sex(x), "_id": first_valid_id(x), "_cheque": cheque_reference(x), "_type": titled_type(x)}
    pairs = [(f, F.col(f"_parents.{f}")) for f in ("father_name_he", "mother_name_he")]
    pairs += [(f, F.col(f"_names.{f}")) for f in ("last_name_he", "first_name_he")]
    pairs += [("sex", F.col("_sex")), ("id_number", F.col("_id")), ("bank_code", F.col("_cheque.bank_code")), ("branch_number", F.col("_cheque.branch_number")), ("_type", F.col("_type"))]
    every = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs]))
    return records.withColumns(found).withColumns({"anchors": F.map_filter(every, lambda k, v: v.isNotNull()), "printed": printed_labels(x)}).drop(*found)
