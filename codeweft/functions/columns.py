"""Column expressions: identities, typed properties, weights, tokens, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeweft import model


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Identities: pure functions of content. Fixed formats.
def package_id(path): return F.concat(F.lit("pkg:"), c(path))
def type_id(path, name): return F.concat_ws(".", c(path), c(name))
def function_id(path, name, receiver=None): return F.concat(F.concat_ws(".", c(path), *([F.nullif(c(receiver), F.lit(""))] if receiver is not None else []), c(name)), F.lit("()"))
def field_id(owner, field): return F.concat(c(owner), F.lit("#"), c(field))
def table_id(t): return F.concat(F.lit("table:"), c(t))
def column_id(t, col): return F.concat(F.lit("table:"), c(t), F.lit("."), c(col))
def endpoint_id(method, path): return F.concat(F.lit("endpoint:"), c(method), F.lit(" "), c(path))
def dependency_id(path): return F.concat(F.lit("ext:"), c(path))
def edge_id(kind, src, dst): return F.concat_ws("|", c(kind), c(src), c(dst))
def prefixed_id(prefix, path, name): return F.concat(F.lit(prefix + ":"), c(path), F.lit("."), c(name))
def rationale_id(file, line, kind): return F.concat(F.lit("rationale:"), c(file), F.lit(":"), c(line).cast("string"), F.lit(":"), c(kind))
def content_hash(text): return F.sha2(c(text), 256)
def project_key(path): return F.left(F.sha2(c(path), 256), F.lit(16))


def prop(bag, key: str) -> Column:
    """A property as text; null for a missing key, a null bag or a bag that does not parse."""
    return F.get_json_object(c(bag), f"$.{key}")


def int_prop(bag, key: str, default: int) -> Column:
    """Numbers come back as int or as float, depending on who wrote them."""
    return F.coalesce(prop(bag, key).try_cast("double").cast("int"), F.lit(default))


def bool_prop(bag, key: str) -> Column:
    return F.coalesce(prop(bag, key).try_cast("boolean"), F.lit(False))


def text_prop(bag, key: str) -> Column:
    return F.coalesce(prop(bag, key), F.lit(""))


def community(bag) -> Column: return int_prop(bag, "community", -1)
def degree(bag) -> Column: return int_prop(bag, "degree", 0)
def is_hub(bag) -> Column: return bool_prop(bag, "god_node")
def community_label(bag) -> Column: return text_prop(bag, "community_label")


def edge_weight(kind) -> Column:
    w = F.when(c(kind).isin(model.WEIGHTS[3]), 3)
    return w.when(c(kind).isin(model.WEIGHTS[2]), 2).otherwise(1)


def confidence(kind, given) -> Column:
    """The given confidence, or the one its type implies where none is given."""
    return F.coalesce(F.nullif(c(given), F.lit("")), F.when(c(kind).isin(model.INFERRED_TYPES), model.INFERRED).otherwise(model.EXTRACTED))


def tokens(text) -> Column:
    """Lower-case words of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(c(text), F.lit(""))), F.lit("[a-z0-9_]+"), 0)


def estimate_tokens(text) -> Column:
    n = F.octet_length(F.coalesce(c(text), F.lit("")))
    return F.when(n == 0, 0).otherwise(F.floor(n / 3).cast("int") + 1)


def base_name(path) -> Column:
    return F.substring_index(c(path), "/", -1)


def dir_name(path) -> Column:
    """Folder of a path, empty where it has none."""
    return F.regexp_extract(c(path), r"^(.*)/[^/]*$", 1)


def path_tokens(path) -> Column:
    """Words of a path's folders that can label a community."""
    words = F.split(F.lower(F.regexp_replace(dir_name(F.coalesce(c(path), F.lit(""))), "[^a-zA-Z0-9]+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(model.LABEL_STOPWORDS))


def snake_case(name) -> Column:
    s = F.regexp_replace(c(name), "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1_$2"))


def plural(word) -> Column:
    w = c(word)
    return (
        F.when(w.rlike("[^aeiou]y$"), F.regexp_replace(w, "y$", "ies"))
        .when(w.rlike("(s|sh|ch|x)$"), F.concat(w, F.lit("es")))
        .otherwise(F.concat(w, F.lit("s")))
    )


def join_path(base, path) -> Column:
    """A class's route and a method's: one slash between them; a single slash where both are empty."""
    b, p = F.regexp_replace(c(base), "/$", ""), c(path)
    return F.when(p == "", F.coalesce(F.nullif(b, F.lit("")), F.lit("/"))).otherwise(F.concat(b, F.when(F.startswith(p, F.lit("/")), "").otherwise("/"), p))


def join_route(base, path) -> Column:
    """Routes without leading or trailing slashes."""
    trim = lambda x: F.nullif(F.regexp_replace(c(x), "^/+|/+$", ""), F.lit(""))
    return F.concat_ws("/", trim(base), trim(path))


def source_lines(text, start, end) -> Column:
    """Lines start to end of a text, counted from 1, both included; empty where there are none."""
    ok = (c(start) >= 1) & (c(end) >= c(start))
    return F.when(ok, F.array_join(F.slice(F.split(c(text), "\n"), F.greatest(c(start), F.lit(1)), F.greatest(c(end) - c(start) + 1, F.lit(0))), "\n")).otherwise("")


def human_size(n) -> Column:
    n = c(n).cast("double")
    return (
        F.when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.format_string("%.1f KiB", n / 1024))
        .when(n < 1024**3, F.format_string("%.1f MiB", n / 1024**2))
        .otherwise(F.format_string("%.1f GiB", n / 1024**3))
    )
