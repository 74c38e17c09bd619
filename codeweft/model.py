"""Vocabulary and fixed values of the property graph."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
NODE_TYPES = ["Package", "Struct", "Interface", "Function", "Field", "Table", "Column", "Endpoint", "ExternalDependency", "Enum", "Decorator", "Variable", "TypeAlias", "Rationale"]
EDGE_TYPES = ["imports", "calls", "has_method", "has_field", "maps_to_table", "references_fk", "extends", "implements", "injected", "decorated", "routed", "explains", "embeds", "reads_table", "writes_table", "exposes_endpoint"]
EXTRACTED, INFERRED = "EXTRACTED", "INFERRED"
INFERRED_TYPES = ["implements", "maps_to_table", "reads_table", "writes_table", "injected", "decorated", "routed", "explains"]
WEIGHTS = {3: ["calls", "has_method"], 2: ["has_field", "maps_to_table", "references_fk", "reads_table", "writes_table", "exposes_endpoint", "embeds", "implements"]}
#: Types whose summary text is a stretch of their own source.
SPAN_TYPES = ["Struct", "Interface", "Function", "Enum", "Decorator", "Variable", "TypeAlias"]
HIDDEN_TYPES = ["Field", "Column"]
LABEL_STOPWORDS = ["internal", "pkg", "src", "cmd", "lib", "test", "tests", "main", "app", "com", "org", "io", "net", "util", "utils", "common", "core"]
HUBS, RESOLUTION, LOUVAIN_ROUNDS, HOPS, MAX_TOKENS, SEEDS, BOOST = 10, 1.0, 20, 2, 3000, 3, 1
MOST_HOPS, MOST_TOP, MOST_TOKENS = 6, 100, 20000
REPORT_HUBS, REPORT_SURPRISES, REPORT_QUESTIONS = 15, 10, 5
NO_SUMMARY = "(no summary yet)"

NODES = T.StructType([
    T.StructField("repo_path", T.StringType()), T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("file", T.StringType()),
    T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("signature", T.StringType()), T.StructField("hash", T.StringType()),
    T.StructField("properties", T.StringType()), T.StructField("updated_at", T.LongType()),
])
EDGES = T.StructType([
    T.StructField("repo_path", T.StringType()), T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("src_id", T.StringType()),
    T.StructField("dst_id", T.StringType()), T.StructField("confidence", T.StringType()), T.StructField("properties", T.StringType()), T.StructField("built_at", T.TimestampType()),
])
SUMMARIES = T.StructType([
    T.StructField("repo_path", T.StringType()), T.StructField("node_id", T.StringType()), T.StructField("level", T.StringType()), T.StructField("hash", T.StringType()),
    T.StructField("summary", T.StringType()), T.StructField("model", T.StringType()), T.StructField("stale", T.IntegerType()),
])
