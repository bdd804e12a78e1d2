"""Decisions on requests: engine choice, settings, errors, routes and guards, as columns."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.geometry import area, overlap

# Routes of frame labels.
ROUTES = {"cheque_front": "cheque", "cheque_back": "cheque", "sefach": "sheet"}
LABEL_TYPES = {
    "id_card_front": "teudat_zehut", "id_card_back": "teudat_zehut_back", "passport": "israeli_passport", "drivers_license": "israeli_drivers_license",
    "cheque_front": "cheque", "cheque_back": "cheque_back", "foreign_passport": "foreign_passport", "disability_card": "disability_card",
}
KIND_LABELS = {
    "teudat_zehut": "id_card_front", "teudat_zehut_back": "id_card_back", "sefach": "sefach", "israeli_passport": "passport", "foreign_passport": "foreign_passport",
    "drivers_license": "drivers_license", "disability_card": "disability_card", "cheque_front": "cheque_front", "cheque_back": "cheque_back",
}
UNSUPPORTED = ["senior_citizen_card", "weapon_license"]
SETTINGS = {"store_results": bool, "check_registries": bool, "backend": str, "model": str, "local_model": str}


def _lookup(values: Mapping[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def engine_choice(auth: Column, backend: Column, model: Column, local_model: Column, allowed: list[str]) -> Column:
    """Struct (backend, model): hosted accounts get the cloud and its allowed models only, own
    installations what they chose; null where nothing is chosen."""
    hosted = auth == "hosted"
    side = F.when(hosted, "cloud").when(backend.isin("local", "cloud"), backend)
    chosen = F.when((side == "cloud") & (~hosted | model.isin(allowed)), F.nullif(model, F.lit(""))).when(side == "local", F.nullif(local_model, F.lit("")))
    return F.struct(side.alias("backend"), chosen.alias("model"))


def settings_patch(body: Mapping[str, Any], allowed_models: list[str], by_key: bool) -> dict[str, Any]:
    """The usable part of a settings change: known names of the right type, an allowed model; a
    key may turn storing off but not on."""
    good = {k: v for k, v in body.items() if k in SETTINGS and isinstance(v, SETTINGS[k])}
    if good.get("model") not in (None, *allowed_models):
        del good["model"]
    if by_key and good.get("store_results"):
        del good["store_results"]
    return good


def error_answer(kind: Column) -> Column:
    """Struct (status, code) of a failure; the first rule that fits, null for a stranger's."""
    rules = {
        "overloaded": (503, "OVERLOADED"), "configuration": (503, "MISCONFIGURED"), "extraction": (502, "EXTRACTION"), "key_rejected": (502, "INVALID_KEY"),
        "rate_limited": (429, "UPSTREAM_LIMIT"), "upstream_status": (502, "UPSTREAM"), "unreachable": (502, "UNREACHABLE"), "unreadable": (422, "UNREADABLE"),
    }
    answers = [F.when(kind == k, F.struct(F.lit(s).alias("status"), F.lit(c).alias("code"))) for k, (s, c) in rules.items()]
    return F.coalesce(*answers)


def known_error(code: Column, known: list[str]) -> Column:
    return F.when(code.isin(known), code).otherwise("GENERIC")


def has_prefix(model: Column, prefixes: list[str], but: list[str]) -> Column:
    """Whether a model takes an option: by prefix, with exceptions."""
    starts = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: model.startswith(w))
    return starts(prefixes) & ~starts(but) if but else starts(prefixes)


def frame_label(kind: Column, sure: Column, label: Column) -> Column:
    """A sure classifier kind replaces the detector's label; unsupported kinds have none."""
    return F.when(F.coalesce(sure, F.lit(False)) & (kind != "none"), F.when(kind.isin(UNSUPPORTED), F.lit(None)).otherwise(_lookup(KIND_LABELS, kind))).otherwise(label)


def frame_route(label: Column) -> Column:
    """Struct (route, expected_type): the reader for a label: cheque, sheet or generic."""
    return F.struct(F.coalesce(_lookup(ROUTES, label), F.lit("generic")).alias("route"), _lookup(LABEL_TYPES, label).alias("expected_type"))


def published_type(read_type: Column, kind: Column, sure: Column) -> Column:
    """The reader's type, but an unsupported kind where the reader said other or the kind is sure."""
    return F.when(kind.isin(UNSUPPORTED) & ((read_type == "other") | F.coalesce(sure, F.lit(False))), kind).otherwise(read_type)


def beyond_cap(regions: DataFrame, candidates: DataFrame, page: str = "page_id") -> DataFrame:
    """Regions (page, idx, kind) that are neither candidates nor impossible."""
    return regions.filter(~F.col("kind").eqNullSafe("none")).join(candidates.select(page, "idx"), [page, "idx"], "left_anti")


def islands_overlap(a: Column, b: Column) -> Column:
    """Two boxes share over 0.05 of the smaller one."""
    return overlap(a, b) > 0.05 * F.least(area(a), area(b))


def may_change_user(actor_id: Column, actor_role: Column, user_id: Column, action: Column) -> Column:
    """Admins only, and nobody demotes or deletes themselves."""
    return (actor_role == "admin") & ~((actor_id == user_id) & action.isin("demote", "delete"))
