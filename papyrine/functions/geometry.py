"""Boxes, resolutions and orientation votes of page frames. A box is an array x1, y1, x2, y2 in
thousandths of the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frame gates, physical sizes in mm, target resolutions, vote gates.
MIN_EDGE, MAX_ASPECT, MAX_CONTAINMENT = 250, 3.5, 0.5
CARD_MM, PAGE_MM, SPREAD_MM, CHEQUE_MM, STRIP_MM, A4_MM = 85.6, 125.0, 250.0, 160.0, 210.0, 297.0
PAPER_ASPECT, SPREAD_ASPECT, STRIP_ASPECT = (1.29, 1.45), 2.0, 1.8
CARD_KINDS = ["teudat_zehut", "teudat_zehut_back", "drivers_license", "disability_card", "senior_citizen_card", "weapon_license"]
PASSPORT_KINDS = ["israeli_passport", "foreign_passport"]
CHEQUE_KINDS = ["cheque_front", "cheque_back"]
TARGET_DPI, WARN_DPI, DPI_TOLERANCE, RESAMPLE_TOLERANCE = 300, 150, 0.10, 0.05
MIN_VOTES, MIN_MARGIN, TALL_SHARE = 8, 0.20, 0.8


def area(box: Column) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0)) * F.greatest(box[3] - box[1], F.lit(0))


def overlap(a: Column, b: Column) -> Column:
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    tall = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(wide, F.lit(0)) * F.greatest(tall, F.lit(0))


def contained(box: Column, boxes: Column) -> Column:
    """More than half of the box lies in a strictly larger one."""
    return F.exists(boxes, lambda o: (area(o) > area(box)) & (area(box) > 0) & (overlap(box, o) > MAX_CONTAINMENT * area(box)))


def box_kinds(boxes: Column, width: Column, height: Column) -> Column:
    """For each box ``none`` where no document can be in it, else null (ask the classifier)."""

    def kind(b: Column) -> Column:
        w, h = (b[2] - b[0]) * width / 1000.0, (b[3] - b[1]) * height / 1000.0
        longer, shorter = F.greatest(w, h), F.least(w, h)
        shape = (shorter <= 0) | (longer < MIN_EDGE) | (longer > MAX_ASPECT * shorter)
        return F.when(shape | contained(b, boxes), "none")

    return F.transform(boxes, kind)


def page_is_junk(kinds: Column) -> Column:
    """More than one impossible box, or nothing else."""
    junk = F.size(F.filter(kinds, lambda k: k == "none"))
    return (junk > 1) | ((junk == 1) & (F.size(kinds) == 1))


def whole_page(boxes: Column) -> Column:
    """One box that covers more than 0.8 of the page."""
    return (F.size(boxes) == 1) & (F.coalesce(area(F.try_element_at(boxes, F.lit(1))), F.lit(0)) > 800_000)


def document_edges(width: Column, height: Column, tilt: Column) -> Column:
    """Struct (long, short): edges of a tilted document from the box around it."""
    w, h = F.greatest(width, height).cast("double"), F.least(width, height).cast("double")
    t = F.radians(F.abs(tilt))
    divisor = F.cos(2 * t)
    a = F.try_divide(w * F.cos(t) - h * F.sin(t), divisor)
    b = F.try_divide(h * F.cos(t) - w * F.sin(t), divisor)
    good = (t != 0) & (divisor > 0) & (a > 0) & (b > 0)
    return F.struct(F.when(good, F.greatest(a, b)).otherwise(w).alias("long"), F.when(good, F.least(a, b)).otherwise(h).alias("short"))


def _dpi(pixels: Column, mm: float) -> Column:
    return F.bround(pixels / mm * 25.4).cast("int")


def estimated_dpi(kind: Column, sure: Column, long: Column, short: Column, page_width: Column, page_height: Column, is_page: Column, landscape: Column) -> Column:
    """Resolution of a frame: a paper-shaped page decides, else the size of a sure kind; or null."""
    page_long, page_short = F.greatest(page_width, page_height), F.least(page_width, page_height)
    paper = ~is_page & (page_long / F.greatest(page_short, F.lit(1))).between(*PAPER_ASPECT)
    aspect = long / F.greatest(short, F.lit(1.0))
    return (
        F.when(paper, _dpi(page_long, A4_MM))
        .when(~F.coalesce(sure, F.lit(False)), F.lit(None).cast("int"))
        .when(kind.isin(CARD_KINDS), _dpi(long, CARD_MM))
        .when(kind.isin(PASSPORT_KINDS) & (aspect > SPREAD_ASPECT), _dpi(long, SPREAD_MM))
        .when(kind.isin(PASSPORT_KINDS), _dpi(F.when(landscape, long).otherwise(short), PAGE_MM))
        .when(kind.isin(CHEQUE_KINDS), _dpi(long, CHEQUE_MM))
        .when((kind == "sefach") & (aspect >= STRIP_ASPECT), _dpi(long, STRIP_MM))
    )


def resample_factor(dpi: Column) -> Column:
    factor = F.lit(float(TARGET_DPI)) / F.nullif(dpi, F.lit(0))
    return F.when(F.abs(factor - 1) > RESAMPLE_TOLERANCE, factor).otherwise(F.lit(1.0))


def low_resolution(dpi: Column) -> Column:
    return F.coalesce(dpi < WARN_DPI * (1 - DPI_TOLERANCE), F.lit(False))


def crop_pixels(box: Column, width: Column, height: Column, margin: float = 0.03) -> Column:
    """Pixel box (array of int) with a margin, within the page; boxes beyond 1000 are taken as
    pixels of the longer edge."""
    scale = F.when(F.array_max(box) <= 1000, 1000.0).otherwise(F.greatest(width, height).cast("double"))
    x = lambda i: box[i] / scale * width
    y = lambda i: box[i] / scale * height
    # of the box's own whole numbers: a difference of two rounded edges may miss a whole pixel
    mx, my = (box[2] - box[0]) / scale * width * margin, (box[3] - box[1]) / scale * height * margin
    low = lambda v: F.greatest(v.cast("int"), F.lit(0))
    return F.array(low(x(0) - mx), low(y(1) - my), F.least((x(2) + mx).cast("int"), width), F.least((y(3) + my).cast("int"), height))


def grid_cells(width: Column, height: Column, rows: int, columns: int, margin: float) -> Column:
    """Array of (row, col, box) of a sheet's cells with overlap; column 0 is the rightmost."""
    cells = []
    for row in range(rows):
        for col in range(columns):
            left = columns - 1 - col
            edge = lambda share, size, n: (F.lit(share) * size / n).cast("int")
            box = F.array(
                F.greatest(edge(left - margin, width, columns), F.lit(0)),
                F.greatest(edge(row - margin, height, rows), F.lit(0)),
                F.least(edge(left + 1 + margin, width, columns), width),
                F.least(edge(row + 1 + margin, height, rows), height),
            )
            cells.append(F.struct(F.lit(row).alias("row"), F.lit(col).alias("col"), box.alias("box")))
    return F.array(*cells)


def vote_sums(votes: Column) -> tuple[Column, Column]:
    """Sums of the scores for upright (0) and inverted (180) of an array of (label, score)."""
    total = lambda label: F.aggregate(F.filter(votes, lambda v: v["label"] == label), F.lit(0.0), lambda a, v: a + v["score"])
    return total("0"), total("180")


def decided_rotation(votes: Column) -> Column:
    """0, 180 or null: too few votes or too narrow a margin say nothing."""
    upright, inverted = vote_sums(votes)
    whole = upright + inverted
    sure = (F.size(votes) >= MIN_VOTES) & (whole > 0) & (F.abs(upright - inverted) >= MIN_MARGIN * whole)
    return F.when(sure, F.when(inverted > upright, 180).otherwise(0))


def lies_sideways(tall: Column) -> Column:
    """At least eight text boxes, four fifths of them standing up."""
    return (F.size(tall) >= MIN_VOTES) & (F.size(F.filter(tall, lambda x: x)) >= TALL_SHARE * F.size(tall))


def sideways_rotation(votes_90: Column, votes_270: Column) -> Column:
    """90 or 270: a decisive answer on either turn, else the larger net upright score, else 90."""
    d90, d270 = decided_rotation(votes_90), decided_rotation(votes_270)
    net = lambda v: vote_sums(v)[0] - vote_sums(v)[1]
    return (
        F.when(d90.isNotNull(), F.when(d90 == 0, 90).otherwise(270))
        .when(d270.isNotNull(), F.when(d270 == 0, 270).otherwise(90))
        .when(net(votes_270) > net(votes_90), 270)
        .otherwise(90)
    )


def is_degenerate(lines: Column) -> Column:
    """Twenty lines and more, under a quarter of them distinct."""
    return (F.size(lines) >= 20) & (F.size(F.array_distinct(lines)) < 0.25 * F.size(lines))
