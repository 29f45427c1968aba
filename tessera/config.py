"""Settings: built-in values, merged with an optional JSON file over them."""

from __future__ import annotations

import copy
import json
from typing import Any

# The settings that results depend on.
DEFAULTS: dict[str, dict[str, Any]] = {
    "analysis": {
        "confidence_threshold": 0.6,
        "skip_high_risk": True,
        "high_risk_confidence_override": 0.7,
        "max_name_length": 64,
        "min_pseudocode_lines": 3,
        "max_pseudocode_lines": 1000,
        "uncertain_prefix": "maybe_",
        "uncertain_prefix_max_confidence": 0.7,
        "max_imported_apis_shown": 40,
        "max_referenced_strings_shown": 40,
        "max_code_referrers_shown": 20,
        "max_unanalyzed_neighbours_shown": 5,
        "max_call_site_snippet_lines": 20,
        "max_related_summary_chars": 160,
        "profile": "vuln_research",
    },
    "policy": {
        "analysis_candidate_prefixes": ["sub_"],
        "auto_generated_prefixes": ["sub_", "j_", "nullsub_", "locret_", "loc_"],
        "vague_names": (
            "process_data handle_stuff helper wrapper unknown_function do_something function func handle process"
            " execute run init cleanup setup teardown main_func common_func utility_func generic_func sub_routine"
            " routine method callback handler handler_func do_work work task operation perform check get_data"
            " set_data read_data write_data unknown unnamed noname"
        ).split(),
        "conflict_suffix_max": 9,
    },
    "scoring": {
        "sink_bonus": 3,
        "input_reachable_bonus": 5,
        "low_complexity_bonus": 2,
        "low_complexity_threshold": 5,
        "high_complexity_bonus": 3,
        "high_complexity_threshold": 20,
        "high_complexity_caller_max": 3,
        "caller_brackets": [[3, 4], [10, 1], [50, 0], [200, -2]],
        "caller_beyond": -5,
        "candidate_pool_multiplier": 3,
    },
    "graph": {
        "dangerous_sinks": (
            "memcpy memmove strcpy strcat sprintf vsprintf gets recv recvfrom read malloc realloc free RtlCopyMemory"
            " RtlMoveMemory RtlCompareMemory ProbeForRead ProbeForWrite MmProbeAndLockPages ExAllocatePoolWithTag"
            " ExFreePoolWithTag"
        ).split(),
        "input_sink_apis": "recv recvfrom read fgets fread WSARecv ReadFile getchar scanf fscanf".split(),
        "max_import_refs_per_node": 20,
        "max_string_refs_per_node": 20,
        "max_constant_operands_per_node": 64,
    },
    "kb": {"refinement_confidence_skip": 0.7, "repair_max_rounds": 3, "duplicate_name_max_group_size": 3},
    "diff": {"self_consistency_min_prompt_chars": 20000, "tiebreak_model": None, "tiebreak_think": False},
    "search": {
        "min_similarity": 0.55,
        "risk_boost": {"low": 0.0, "medium": 0.03, "high": 0.07},
        "security_relevant_boost": 0.02,
        "semantic_candidate_pool_multiplier": 4,
    },
}


def merged(base: dict, over: dict) -> dict:
    """over wins; maps are merged level by level."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load(path: str | None = None) -> dict:
    """The defaults, under the JSON object at path where that can be read."""
    if path:
        try:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
            if isinstance(found, dict):
                return merged(DEFAULTS, found)
        except (OSError, ValueError):
            pass
    return copy.deepcopy(DEFAULTS)
