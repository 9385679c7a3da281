"""Front matter as columns: YAML of the JSON schema, parsed in Arrow batches.

A note whose front matter is missing, unclosed, empty, invalid or not a mapping has no
metadata (a null struct), and never an error.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import front_yaml

PROMOTED = ("type", "status", "priority", "created", "due", "project")
META = T.StructType([*(T.StructField(k, T.StringType()) for k in PROMOTED), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("json", T.StringType())])


class JsonSchemaLoader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """Only null, true and false, numbers; everything else is text. No tags, no dates."""


JsonSchemaLoader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("null", r"(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("bool", r"(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
    ("int", r"[-+]?(?:0b[01_]+|0x[0-9a-fA-F_]+|0o[0-7_]+|[0-9][0-9_]*)$", list("-+0123456789")),
    ("float", r"(?:[-+]?(?:[0-9][0-9_]*)(?:\.[0-9_]*)?(?:[eE][-+]?[0-9]+)?|[-+]?\.[0-9_]+(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+.0123456789")),
):
    JsonSchemaLoader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), _first)


def _int(loader: JsonSchemaLoader, node: yaml.ScalarNode) -> int:
    return int(loader.construct_scalar(node).replace("_", ""), 0) if re.match(r"[-+]?0[box]", node.value) else int(node.value.replace("_", ""))


JsonSchemaLoader.add_constructor("tag:yaml.org,2002:int", _int)


def load(text: str | None) -> dict | None:
    """The mapping that a front matter holds, or None."""
    if not text:
        return None
    try:
        value = yaml.load(text, JsonSchemaLoader)  # noqa: S506
    except (yaml.YAMLError, ValueError, TypeError, RecursionError):
        return None
    return value if isinstance(value, dict) and value else None


def as_text(value: object) -> str | None:
    """A value as filters compare it: lists comma-joined, whole floats without a point."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return str(int(value)) if math.isfinite(value) and value == int(value) else str(value)
    if isinstance(value, list):
        return ",".join("" if v is None else as_text(v) for v in value)
    if isinstance(value, dict):
        return "[object Object]"
    return str(value)


def _row(text: str | None) -> dict:
    value = load(text)
    if value is None:
        return dict.fromkeys([f.name for f in META])
    value = {as_text(k) or "null": v for k, v in value.items()}
    tags = value.get("tags")
    tags = [as_text(t) for t in tags if t not in (None, "", False, 0)] if isinstance(tags, list) else None
    promoted = {k: v if isinstance(v := value.get(k), str) else None for k in ("type", "status")} | {k: as_text(value.get(k)) for k in PROMOTED[2:]}
    return promoted | {"tags": tags, "fields": {k: as_text(v) for k, v in value.items()}, "json": json.dumps(value, ensure_ascii=False, default=str)}


@F.pandas_udf(META)
def _parsed(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_row(t) for t in text], columns=[f.name for f in META], index=text.index, dtype=object)


_parsed = _parsed.asNondeterministic()  # else filters on it go below the projection, and it runs twice


def parsed(content: Column) -> Column:
    """The metadata struct of META; its fields are null where there is no metadata."""
    return _parsed(front_yaml(content))


def with_meta(notes: DataFrame) -> DataFrame:
    """The notes with their metadata in ``meta``; null where there is none. Parsed once a row."""
    meta = F.col("meta")
    return notes.withColumn("meta", parsed(F.col("content"))).withColumn("meta", F.when(meta["json"].isNotNull(), meta))


def dump(value: dict) -> str:
    """Block-style YAML that loads to the same mapping; keys keep their order."""
    return yaml.dump(value, Dumper=_Dumper, sort_keys=False, allow_unicode=True, width=math.inf, default_flow_style=False)


class _Dumper(yaml.SafeDumper):
    """Writes texts plainly unless JsonSchemaLoader would read them as something else."""

    def increase_indent(self, flow: bool = False, indentless: bool = False) -> None:
        return super().increase_indent(flow, False)

    def ignore_aliases(self, data: object) -> bool:
        return True


_Dumper.yaml_implicit_resolvers = JsonSchemaLoader.yaml_implicit_resolvers
