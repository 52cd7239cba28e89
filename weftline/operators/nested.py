"""JSON texts as columns: PARSE_JSON, JSON_GET and EXPAND_JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import strip

PATH = re.compile(r"^\$(\.[A-Za-z_]\w*|\[\d+\]|\[(['\"])[^'\"]+\2\])*$")


def variant(c: Column, kind: T.DataType) -> Column:
    """A VARIANT of a JSON text; null where the text is not JSON."""
    return c if isinstance(kind, T.VariantType) else F.try_parse_json(strip(c.cast("string")))


def check_path(opts) -> list[str]:
    return [] if PATH.match(str(opts.get("path", ""))) else [f"bad path {opts.get('path')!r}"]


def parse_json(args, opts, ctx) -> Column:
    return variant(*args[0])


def json_get(args, opts, ctx) -> Column:
    """The value at ``path`` as ``type`` (default string); null where it is absent or of another type."""
    return F.try_variant_get(variant(*args[0]), opts["path"], opts.get("type", "string"))


def inferred(df: DataFrame, column: str) -> T.StructType:
    """The fields of the JSON objects in ``column``, with the types that all of them fit, in one aggregation."""
    v = variant(F.col(f"`{column}`"), df.schema[column].dataType)
    found = df.agg(F.schema_of_variant_agg(v).alias("s")).first().s or "VOID"
    kind = T.DataType.fromDDL(found.replace("OBJECT<", "STRUCT<").replace("OBJECT", "STRUCT<>"))
    return kind if isinstance(kind, T.StructType) else T.StructType([])


def expand_json(args, opts, ctx):
    """The table with a column for each field of the JSON objects in ``column``, called ``prefix`` and the field's name.

    ``fields`` (name to type) spares the pass that finds fields and types. Fields whose values have no common
    type stay VARIANT.
    """
    rel, c, prefix = ctx.relation(args[0]), opts["column"], opts.get("prefix", "")
    fields = opts.get("fields")
    if fields is None:
        fields = {f.name: f.dataType.simpleString() for f in inferred(rel.df, c).fields}
    v = variant(F.col(f"`{c}`"), rel.df.schema[c].dataType)
    path = lambda name: f"$.{name}" if re.fullmatch(r"[A-Za-z_]\w*", name) else f"$['{name}']"
    new = {f"{prefix}{n}": F.try_variant_get(v, path(n), "string" if t == "void" else t) for n, t in fields.items()}
    if clash := set(new) & set(ctx.plain(rel).columns):
        raise ValueError(f"columns {sorted(clash)} exist; give a prefix")
    return ctx.derive(rel, rel.df.withColumns(new))
