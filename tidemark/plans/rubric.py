"""The scoring rubric: fixed values, and a frozen document that what-if overrides are merged into.

The hash covers the merged document, so a changed weight makes a different rubric.
"""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass

# They must equal the published rubric for right results.
EVENT_TYPES = (
    "earnings_beat", "earnings_miss", "guidance_change", "order_win", "litigation", "regulatory_action",
    "auditor_resignation", "auditor_restatement", "exchange_fine", "management_exit", "board_independence",
    "investigation", "rpt_concern", "capacity_expansion", "analyst_action", "operating_update", "dividend", "buyback",
    "split_bonus", "dilution", "merger_acquisition", "management_change_routine", "rpt_routine", "board_change_routine",
    "investigation_closed", "auditor_rotation", "price_move", "mnc_structural_discount", "other", "pledge",
    "insolvency_admission", "demerger", "open_offer_takeover", "rights_issue", "pledge_invocation", "special_dividend",
    "lock_in_expiry", "name_symbol_isin_change", "fy_end_change", "routine_agm_egm", "admin_notice", "noise_notice",
    "index_inclusion", "index_exclusion", "exchange_surveillance",
)

RUBRIC = {
    "sentiment": {
        "window_weights": [[30, 1.0], [90, 0.75], [180, 0.5], [365, 0.25]],
        "half_life_trading_days": 90,
        "trading_days_per_year": 252,
        "recency_floor": 0.15,
        "points_scale": 50,
        "bands": {"plus2": 50, "plus1": 15},
        "band_cutoffs": {"plus2_at": 1.6, "plus1_at": 0.5, "minus1_at": -0.5, "minus2_at": -1.6},
        "aggregation": "signal_events",
        "min_signal_events": 3,
        "plus_two_requires_no_results_offset": False,
        "minus_one_when_results_negative": False,
        "results_dominance_threshold": -0.5,
        "use_source_confidence": False,
        "results_event_types": ["earnings_beat", "earnings_miss", "guidance_change", "operating_update"],
        "noise_zero_types": ["other", "management_change_routine", "board_change_routine", "dilution", "rpt_routine"],
        "min_relevant_articles": 8,
        "require_results_print": True,
        "min_span_days": 270,
        "min_events": 6,
        "min_windows": 2,
        "min_results_events": 1,
        "window_dominance": 0.70,
    },
    "governance": {
        "start": 100,
        "count_mode": "once_per_type",
        "penalties": {
            "auditor_restatement": -25,
            "auditor_resignation": -20,
            "regulatory_action": -20,
            "rpt_concern": -12,
            "investigation": -10,
            "exchange_fine": {"low": -5, "medium": -7, "high": -10},
            "management_exit": -8,
            "board_independence": -8,
            "mnc_structural_discount": -5,
            "pledge_invocation": -20,
            "pledge": {"low": 0, "medium": -5, "high": -10},
            "insolvency_admission": -25,
            "open_offer_takeover": 0,
        },
        "labels": [["Clean", 95], ["Watch", 80], ["Flag", -1000]],
        "historical_penalty": -5,
        "age_taper": {"full_days": 182, "end_days": 365, "end_factor": 0.5},
        "routine_types": ["management_change_routine", "rpt_routine", "board_change_routine", "investigation_closed", "auditor_rotation", "lock_in_expiry"],
        "subject_ok": ["company", "subsidiary", "promoter_or_insider"],
        "people_never_an_exit": ["appointment", "promotion_or_elevation", "reappointment", "planned_exit_or_succession"],
        "exit_requires_role_tier": "cxo_cs_cfo_compliance",
        "materiality_floor_cr": 10.0,
        "procedural_band_penalty": -5,
        "notice_without_order_penalty": -10,
        "severity_caps": {"procedural": -5, "immaterial": -5, "minor": -10},
        "severity_caps_exempt_types": ["management_exit", "auditor_resignation", "auditor_restatement"],
        "floor_exempt_severities": ["integrity", "minor"],
        "dedupe_days": 7,
        "memory_discount_only_if_no_in_window_penalty": True,
        "families": {
            "regulatory_action": "regulatory", "investigation": "regulatory", "exchange_fine": "regulatory", "litigation": "regulatory",
            "management_exit": "people", "board_independence": "people", "auditor_resignation": "auditor", "auditor_restatement": "auditor",
            "rpt_concern": "rpt",
        },
    },
    "actions": {
        "severity": {
            "insolvency_admission": 10, "demerger": 9, "merger_acquisition": 9, "split_bonus": 8, "open_offer_takeover": 8, "rights_issue": 7,
            "pledge": 7, "pledge_invocation": 7, "dilution": 6, "special_dividend": 6, "auditor_resignation": 6, "management_exit": 6,
            "buyback": 5, "lock_in_expiry": 5, "dividend": 4, "name_symbol_isin_change": 3, "fy_end_change": 2, "routine_agm_egm": 2,
            "admin_notice": 1, "noise_notice": 0,
        },
        "stage_multiplier": {"board_intimation": 0.3, "board_approved": 0.6, "approval_obtained": 0.8},
        "stage_default": "board_approved",
        "stages_excluded": ["completed"],
        "timing": {"under_15d": 1.0, "from_15_to_60d": 0.75, "over_60d": 0.5},
        "half_life_days": {
            "dividend": 30, "buyback": 30, "special_dividend": 30, "merger_acquisition": 90, "demerger": 90, "open_offer_takeover": 90,
            "pledge": 180, "pledge_invocation": 180, "auditor_resignation": 180, "management_exit": 180,
        },
        "half_life_default": 90,
        "timing_floor": 0.1,
        "size_bands": [[2, 0.7], [5, 1.0], [10, 1.2], [999, 1.5]],
        "size_by_materiality": {"low": 0.7, "medium": 1.0, "high": 1.5},
        "size_materiality_types": ["dilution", "rights_issue", "pledge", "pledge_invocation", "buyback", "open_offer_takeover"],
        "gate_a_types": ["insolvency_admission", "pledge_invocation"],
        "gate_a_auditor_severity": "integrity",
        "gate_b_types": ["split_bonus", "demerger", "merger_acquisition", "rights_issue", "special_dividend", "name_symbol_isin_change"],
        "tracked_types": ["index_inclusion", "index_exclusion", "exchange_surveillance"],
        "bands": [["Log", 3], ["Watch", 5], ["Review", 7], ["Act", 9], ["Exit", 11]],
        "strict_bands": [[0, 2.9, "Log"], [3, 4.9, "Watch"], [5, 6.9, "Review"], [7, 8.9, "Act"], [9, 10, "Exit"]],
        "opportunity_review_at": 6,
        "dividend_days": 120,
        "other_days": 30,
    },
    "sampling": {
        "windows": [[0, 30, 40], [31, 90, 25], [91, 180, 20], [181, 365, 15]],
        "per_day_cap": 6,
        "governance_quotas": [9, 8, 7, 6],
        "results_per_bucket": 10,
        "results_cap": 40,
        "bucket_days": 90,
        "results_quarters": 4,
    },
    "cluster": {
        "days": 2, "jaccard": 0.5, "shared": 3, "near_jaccard": 0.7, "near_days": 7, "contained": 0.9, "contained_size": 4, "top_tokens": 200,
        "merge_days": 3, "base": 0.40, "slope": 0.15,
    },
    "tier_weight": {"T1": 1.0, "T2": 0.9, "T3": 0.7, "T4": 0.5},
    "low_below_items": 3,
    "winsor_sigma": 3.0,
    "pit_grace_days": 7,
    "backdate_days": 3,
    "label_failure_limit": 0.10,
}


def merged(base: Mapping, over: Mapping) -> dict:
    """``base`` with the leaves of ``over`` put in."""
    out = copy.deepcopy(dict(base))
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


@dataclass(frozen=True)
class Rubric:
    doc: Mapping

    def __getitem__(self, key: str):
        return self.doc[key]

    @property
    def sha(self) -> str:
        return hashlib.sha256(json.dumps(self.doc, sort_keys=True).encode()).hexdigest()


def load_rubric(*overrides: Mapping) -> Rubric:
    """The rubric, with an accepted patch and what-if values merged in, in that order."""
    doc = RUBRIC
    for o in overrides:
        doc = merged(doc, o)
    return Rubric(doc)


DEFAULT = load_rubric()
