"""Schemas of the engine's tables."""

from __future__ import annotations

DOCUMENT = "doc_id string, content string, metadata map<string,string>"
SEGMENT = "segment_id string, parent_id string, doc_id string, content string, level int, path array<string>, type string, original_format string, metadata map<string,string>"
VECTOR = "vec_id string, embedding array<float>, payload map<string,string>"
NODE = "id string, type string, label string, description string, properties map<string,string>, source_segment_id string"
EDGE = "source_id string, target_id string, relation_type string, weight double, properties map<string,string>, source_segment_id string"
EVIDENCE = "query_id long, evidence_id string, kind string, content string, score double, source_segment_id string"

SEGMENT_TYPES = ("text", "table", "image", "audio", "code", "other")
KIND_RANK = {"chunk": 0, "relation": 1, "entity": 2, "community": 3}
