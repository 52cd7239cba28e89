"""SAMPLE: so many rows, of the table or of each stratum, the same ones on every run."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import hidden, keep
from .frames import numbered
from .meeting import listed


def check_sample(opts) -> list[str]:
    n = opts.get("n")
    return [] if isinstance(n, int) and not isinstance(n, bool) and n >= 0 else ["SAMPLE needs n, a whole number"]


def sample(args, opts, ctx):
    """The ``n`` rows of lowest hash of each stratum (``by``; null is one), all of it if it has fewer.

    The hash is the MD5 of ``seed`` and the ``key`` columns (default: all). A first pass counts hashes in
    65,536 bins a stratum, which gives the bin where the limit falls; a second keeps the bins below and ranks
    the rows of that one bin along a dealt-out order, so no stratum passes through one task.
    """
    rel, by = ctx.relation(args[0]), listed(opts.get("by"))
    own = [c for c in ctx.plain(rel).columns]
    keys, n, seed = listed(opts.get("key")) or own, int(opts["n"]), opts.get("seed", 42)
    text = F.concat_ws("|", F.lit(str(seed)), F.lit("sample"), *(F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\x00")) for k in keys))
    h, b, cut, below, need = (hidden(x) for x in ("hash", "bin", "cut", "below", "need"))
    strata = [hidden(f"by_{i}") for i in range(len(by))] or [hidden("all")]
    rows = rel.df.withColumn(h, F.md5(text)).withColumn(b, F.conv(F.substring(h, 1, 4), 16, 10).cast("int"))
    rows = rows.withColumns({s: F.to_json(F.struct(F.col(f"`{c}`"))) for s, c in zip(strata, by, strict=False)} or {strata[0]: F.lit("")})
    counts = rows.groupBy(*strata, b).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*strata).orderBy(b).rowsBetween(Window.unboundedPreceding, 0)
    limits = counts.withColumn(below, F.sum("n").over(upto) - F.col("n")).where((F.col(below) < n) & (F.col(below) + F.col("n") >= n))
    limits = keep(limits.select(*strata, F.col(b).alias(cut), (n - F.col(below)).alias(need)))
    met = rows.join(limits, strata, "left") if n else rows.join(limits, strata, "left").where(F.lit(False))
    sure = met.where(F.col(cut).isNull() | (F.col(b) < F.col(cut))).select(*rel.df.columns)
    border, _ = numbered(met.where(F.col(b) == F.col(cut)).withColumn(hidden("tie"), F.monotonically_increasing_id()), [*(F.col(s) for s in strata), F.col(h), F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in own)), F.col(hidden("tie"))])
    firsts = border.groupBy(*strata).agg(F.min(hidden("pos")).alias(hidden("least")))
    some = border.join(firsts, strata).where(F.col(hidden("pos")) - F.col(hidden("least")) < F.col(need)).select(*rel.df.columns)
    return ctx.derive(rel, sure.unionByName(some))
