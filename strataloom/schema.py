"""Explicit schemas of the engine's tables."""

from __future__ import annotations

POSITION = "struct<line:int,column:int>"
NODES = (
    f"id string, type string, name string, qualified_name string, file string, start {POSITION}, end {POSITION}, modifiers array<string>, "
    "superclass string, interfaces array<string>, is_interface boolean, is_enum boolean, signature string, return_type string, is_constructor boolean, "
    "is_static boolean, is_final boolean, thrown array<string>, data_type string, position int, owner string, props map<string,string>"
)
EDGES = "src string, dst string, type string, props map<string,string>"
CALL_SITES = "caller_id string, caller_class string, receiver_type string, method_name string, is_constructor boolean, file string, line int"
VALUES = "value string, class_fqn string, field_name string, file string, line int"
EXCEPTIONS = "method_qn string, exception_name string, file string, line int, is_assertion boolean"
FIELD_USAGES = "field_qn string, method_qn string, file string, line int"
FILES = "file string, package string, imports array<string>"
TYPE_MENTIONS = "node_id string, type_name string, file string"
FIELD_REFS = "class_fqn string, scope string, name string, method_qn string, file string, line int"
PARSE_ERRORS = "file string, message string"
ASK_LOG = "ts timestamp, project string, question string, matched string, answer_bytes long, ok boolean"
TOOL_EVENTS = "session_id string, seq int, tool string, operation string, is_mutation boolean, target string, reasoning string, result_bytes long, ok boolean"

#: Side tables of a graph and their schemas.
TABLES = {"nodes": NODES, "edges": EDGES, "call_sites": CALL_SITES, "values": VALUES, "exceptions": EXCEPTIONS, "field_usages": FIELD_USAGES, "files": FILES, "type_mentions": TYPE_MENTIONS, "field_refs": FIELD_REFS, "parse_errors": PARSE_ERRORS}

DECLARATIONS = ("PACKAGE", "CLASS", "INTERFACE", "METHOD", "FIELD", "PARAMETER", "VARIABLE")
EDGE_TYPES = ("HAS_METHOD", "HAS_FIELD", "HAS_PARAMETER", "REFERENCES_TYPE", "INHERITS", "IMPLEMENTS", "OVERRIDES", "CALLS")
