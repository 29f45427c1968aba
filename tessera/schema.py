"""Schemas of the engine's tables."""

from __future__ import annotations

NODES = (
    "address long, name string, size_bytes int, basic_block_count int, caller_count long, "
    "callee_addresses array<long>, dangerous_sink_calls array<string>, input_reachable boolean, "
    "string_refs array<string>, import_refs array<string>, constant_operands array<long>"
)
EDGES = "caller long, callee long"
KB = (
    "address string, old_name string, new_name string, confidence double, summary string, "
    "security_relevant boolean, interesting_behaviors array<string>, callee_summaries_used array<string>, "
    "caller_count int, score double, analyzed boolean, refined boolean, embedding_id string, status string, "
    "risk string, reason string, rejection_reason string, applied boolean, applied_name string, "
    "analyzed_at timestamp, num_ctx_used int, prompt_chars int, pseudocode_truncated boolean, body_hash string"
)
AUDIT = "ts timestamp, address string, old_name string, phase string, status string, new_name string, detail string"
RESPONSES = (
    "ts timestamp, address string, old_name string, phase string, model string, raw_response string, validation string"
)
VECTORS = "address string, embedding array<float>"
PROPOSAL = (
    "should_rename string, suggested_name string, confidence string, reason string, summary string, risk string, "
    "security_relevant string, interesting_behaviors array<string>"
)
DIFFERENCE = "meaningful boolean, summary string, security_relevant boolean, risk string, explanation string"
BUILD_INDEX = (
    "map<string, struct<fileInfo: struct<machineType: int, version: string, timestamp: long, virtualSize: long, "
    "size: long>, windowsVersions: map<string, map<string, struct<updateInfo: struct<releaseDate: string>>>>>>"
)
