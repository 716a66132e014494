"""Scalar functions on nodes and edges: attributes in JSON metadata, type families, names and patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Node types that stand for a program's outer edge, and prefixes of types with outside effects.
ENDPOINT_TYPES = ("db:query", "http:request", "http:endpoint", "EXTERNAL", "fs:operation", "SIDE_EFFECT")
SIDE_EFFECT_PREFIXES = ("db:", "http:", "fs:", "net:", "SIDE_EFFECT", "EVENT_LISTENER")


def _step(key: str) -> str:
    return f'["{key}"]' if "'" in key else f"['{key}']"


def _primitive(metadata: Column, path: str) -> Column:
    """The text of a JSON value that is neither object nor array."""
    variant = F.try_parse_json(metadata)
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    text = F.try_variant_get(variant, path, "string") if '"' in path else F.get_json_object(metadata, path)  # the latter knows single quotes only
    return F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), text)


def json_attribute(metadata: Column, key: str) -> Column:
    """The value of a metadata key as text: the exact key if present, else the dotted path; null for objects, arrays
    and paths with an empty step. An exact key whose value is no primitive has no value and hides the path."""
    exact = _primitive(metadata, "$" + _step(key))
    steps = key.split(".")
    if len(steps) == 1:
        return exact
    path = _primitive(metadata, "$" + "".join(map(_step, steps))) if all(steps) else F.lit(None).cast("string")
    return F.when(F.coalesce(F.array_contains(F.json_object_keys(metadata), key), F.lit(False)), exact).otherwise(path)


def json_is_text(metadata: Column, key: str) -> Column:
    """Whether a metadata key holds a JSON string (rather than a number or boolean)."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(metadata), "$" + _step(key), "variant")) == "STRING"


def node_attribute(name: str, prefix: str = "") -> Column:
    """An attribute of a node as text: name, file, type, id and exported are columns, anything else is metadata."""
    column = {"name": "name", "file": "file", "type": "node_type", "id": "id"}.get(name)
    if column:
        return F.col(prefix + column)
    if name == "exported":
        return F.coalesce(F.col(prefix + "exported").cast("string"), json_attribute(F.col(prefix + "metadata"), name))
    return json_attribute(F.col(prefix + "metadata"), name)


def type_matches(node_type: Column, pattern: str) -> Column:
    """Equality, or a prefix test for patterns that end in '*'."""
    return node_type.startswith(pattern[:-1]) if pattern.endswith("*") else node_type == pattern


def namespace(node_type: Column) -> Column:
    """The part before the first ':'; null without one."""
    return F.when(node_type.contains(":"), F.substring_index(node_type, ":", 1))


def base_name(node_type: Column) -> Column:
    """The part after the first ':'; the whole without one."""
    return F.when(node_type.contains(":"), F.regexp_replace(node_type, "^[^:]*:", "")).otherwise(node_type)


def is_endpoint(node_type: Column) -> Column:
    return F.coalesce(node_type.isin(*ENDPOINT_TYPES), F.lit(False))


def has_side_effect(node_type: Column) -> Column:
    hit = F.lit(False)
    for p in SIDE_EFFECT_PREFIXES:
        hit |= node_type.startswith(p)
    return F.coalesce(hit, F.lit(False))


def receiver(name: Column) -> Column:
    """What stands before the last dot; null without one."""
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", ""))


def method(name: Column) -> Column:
    """What stands after the last dot."""
    return F.substring_index(name, ".", -1)


def parent_dir(file: Column) -> Column:
    """The directory of a path; empty without one."""
    return F.when(file.contains("/"), F.regexp_replace(file, "/[^/]*$", "")).otherwise("")


def glob_pattern(glob: str) -> str:
    """A regular expression for a whole path: '**' crosses directories, '*' and '?' do not, {a,b} are choices."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    return f"^{out}$"


def identifier(node_type: Column, name: Column, file: Column) -> Column:
    """TYPE:name@file."""
    return F.concat(node_type, F.lit(":"), F.coalesce(name, F.lit("")), F.lit("@"), F.coalesce(file, F.lit("")))


def semantic_id(file: Column, node_type: Column, name: Column, scope: Column | None = None, number: Column | None = None) -> Column:
    """file->scope->TYPE->name, with #number where it is above 0."""
    parts = [file, *([scope] if scope is not None else []), node_type, name]
    out = F.concat_ws("->", *parts)
    return out if number is None else F.when(number > 0, F.concat(out, F.lit("#"), number.cast("string"))).otherwise(out)
