"""Aggregates and table functions of the user's own.

An aggregate has three steps: ``partial`` (a pandas Series of a key's values to a state), ``merge`` (a list of
states to a state) and ``finish`` (a state to the result). Tasks make a state per key and batch and merge them as they go; only
states are shuffled, so a key that holds a third of all rows sends one row a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .meeting import listed

#: Keys that a task holds states of; beyond that it hands them on and begins anew.
HELD_KEYS = 50_000


@dataclass(frozen=True)
class UserAggregate:
    partial: Callable[[pd.Series], Any]
    merge: Callable[[list], Any]
    finish: Callable[[Any], Any]
    state: str
    result: str


@dataclass(frozen=True)
class UserTable:
    function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
    schema: str


AGGREGATES: dict[str, UserAggregate] = {}
TABLES: dict[str, UserTable] = {}


def register_aggregate(name: str, partial: Callable, merge: Callable, finish: Callable, state: str, result: str) -> None:
    """``state`` and ``result`` are Spark types, as in ``struct<n:bigint,s:double>`` (a dict) or ``double``."""
    if name in AGGREGATES:
        raise ValueError(f"aggregate {name} exists")
    AGGREGATES[name] = UserAggregate(partial, merge, finish, state, result)


def register_table_function(name: str, function: Callable, schema: str) -> None:
    """``function`` turns an iterator of pandas tables (a partition's batches) into one of tables of ``schema``."""
    if name in TABLES:
        raise ValueError(f"table function {name} exists")
    TABLES[name] = UserTable(function, schema)


def check_aggregate(opts) -> list[str]:
    return [] if opts.get("function") in AGGREGATES else [f"no aggregate {opts.get('function')!r} is registered"]


def check_table(opts) -> list[str]:
    return [] if opts.get("function") in TABLES else [f"no table function {opts.get('function')!r} is registered"]


def aggregate_by(args, opts, ctx):
    """A registered aggregate of ``column`` by ``by``, as column ``output`` (default: the function's name). Rows with a null key are left out; nulls reach the aggregate."""
    rel, by, own = ctx.relation(args[0]), listed(opts["by"]), AGGREGATES[opts["function"]]
    keys = [f"k{i}" for i in range(len(by))]
    rows = rel.df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)), F.col(f"`{opts['column']}`").alias("v")).dropna(subset=keys)
    kinds = [T.StructField(k, rows.schema[k].dataType) for k in keys]
    states = T.StructType([*kinds, T.StructField("state", T.DataType.fromDDL(own.state))])
    result = T.StructType([*kinds, T.StructField("value", T.DataType.fromDDL(own.result))])
    table = lambda held, last: pd.DataFrame([(*k, s) for k, s in held.items()], columns=[*keys, last])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Any] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False)["v"]:
                state = own.partial(part)
                held[key] = own.merge([held[key], state]) if key in held else state
            if len(held) > HELD_KEYS:
                yield table(held, "state")
                held = {}
        if held:
            yield table(held, "state")

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, own.finish(own.merge(list(pdf["state"]))))], columns=[*keys, "value"])

    out = rows.mapInPandas(partial, states).groupBy(*keys).applyInPandas(merged, result)
    return ctx.fresh(out.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), F.col("value").alias(opts.get("output") or opts["function"])))


def apply_table(args, opts, ctx):
    """A registered table function over the table's partitions; ``columns`` (default all) are what it gets."""
    df, own = ctx.plain(ctx.relation(args[0])), TABLES[opts["function"]]
    return ctx.fresh(df.select(*(F.col(f"`{c}`") for c in listed(opts.get("columns")) or df.columns)).mapInPandas(own.function, own.schema))
