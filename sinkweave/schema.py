"""Schemas of the engine's tables, as DDL."""


def names(ddl: str) -> list[str]:
    """Column names of a flat DDL schema."""
    return [field.split()[0] for field in ddl.split(", ")]


FILES = "repo string, path string, lang string, text string"
NODES = "repo string, uid string, name string, file string, line int, end_line int, is_sink boolean, is_entry boolean, is_source boolean, is_builtin boolean, lang string, ordinal bigint"
RAW_EDGES = "repo string, src string, callee string, file string, line int, lang string, ordinal bigint"
CLASSES = "repo string, file string, name string, line int, end_line int"
EDGES = "src_uid string, dst_uid string"
EDGE_SITES = "src_uid string, dst_uid string, file string, line int"
TRACES = "trace_id bigint, path array<string>, sinks array<string>, code_hash string"
VERDICT = "vulnerability boolean, confidence string, reasoning string, exploit string, error string"
SOURCE_CONFIG = (
    "file_patterns array<struct<pattern:string,language:string>>, function_patterns array<string>, function_names array<string>, "
    "source_indicators array<string>, language_specific map<string,struct<patterns:array<string>>>"
)
IR = (
    "repository string, total_files int, files_processed int, "
    "nodes array<struct<uid:string,name:string,file:string,line:int,end_line:int,is_sink:boolean,is_entry:boolean,is_source:boolean,is_builtin:boolean>>, "
    "edges array<struct<src:string,dst:string,file:string,line:int>>"
)
