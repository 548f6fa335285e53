"""Ordered classifiers of instructions, evidence, coverage and packages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of class and instruction names that mark an action.
ACTION_PHRASES = (
    "event flag", "eventflag", "initialize event", "run event", "enable asset", "disable asset", "enable character", "disable character",
    "warp", "change map", "objact", "open map", "map loading", "cutscene", "move map",
)
#: Phrases of an instruction's name and the kind of state evidence it is, the first found counts.
STATE_EVIDENCE = (
    ("set objact state", "objact_state_write"), ("event flag", "event_flag_write_or_control_flow"), ("warp", "transport_or_cutscene_action"),
    ("cutscene", "transport_or_cutscene_action"), ("goto", "control_flow_action"), ("skip", "control_flow_action"), ("end if", "control_flow_action"),
)
#: Words of a transport instruction's name and its role.
TRANSPORT_ROLES = (("player", "player_transport"), ("character", "character_transport"), ("asset", "asset_transport"))


def _first_phrase(text: Column, rules: Sequence[tuple[str, str]], default: str | None) -> Column:
    out = F
    for phrase, name in rules:
        out = out.when(F.contains(text, F.lit(phrase)), F.lit(name))
    return out.otherwise(F.lit(default))


def instruction_kind(class_name: Column, name: Column) -> Column:
    """condition by the class, action by a phrase of class and name, else null."""
    low = F.lower(F.coalesce(class_name, F.lit("")))
    both = F.concat(low, F.lit(" "), F.lower(F.coalesce(name, F.lit(""))))
    some = F.lit(False)
    for p in ACTION_PHRASES:
        some = some | F.contains(both, F.lit(p))
    return F.when(low.startswith("condition"), "condition").when(some, "action")


def transport_role(name: Column) -> Column:
    """The role of a transport instruction; null if its name has no warp in it."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(F.contains(low, F.lit("warp")), _first_phrase(low, TRANSPORT_ROLES, "generic_scripted_transport"))


def state_evidence(kind: Column, name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(kind == "condition", "condition_predicate").otherwise(_first_phrase(low, STATE_EVIDENCE, "event_action"))


def map_coverage(has_native: Column, n_meshes: Column, event_signals: Sequence[Column], static_signals: Sequence[Column]) -> Column:
    """One of five classes of a map, by its native record, then event signals, then static ones; null counts are 0."""
    zero = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0))
    signal, static = F.lit(False), F.lit(0)
    for c in event_signals:
        signal = signal | (zero(c) > 0)
    for c in static_signals:
        static = static + zero(c)
    return (
        F.when(F.coalesce(has_native, F.lit(False)), F.when(zero(n_meshes) > 0, "native_nva_navmesh_backed").otherwise("native_nva_present_without_navmesh"))
        .when(signal, "nva_missing_msbe_event_or_region_signal").when(static > 0, "nva_missing_msbe_static_signal_only")
        .otherwise("nva_missing_no_msbe_playability_signal")
    )


@dataclass(frozen=True)
class RouteRule:
    """A package and what assigns a node to it: any listed value of a column."""

    package: str
    any_of: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False)


def package_of(rules: Sequence[RouteRule], default: str) -> Column:
    """The package of the first rule one of whose columns holds a listed value; nulls are empty texts."""
    out = F
    for r in rules:
        hit = F.lit(False)
        for c, values in r.any_of.items():
            hit = hit | F.coalesce(F.col(c), F.lit("")).isin(*values)
        out = out.when(hit, F.lit(r.package))
    return out.otherwise(F.lit(default)) if rules else F.lit(default)
