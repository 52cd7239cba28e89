"""Gap sessionisation over client by gap-width time cells.

Clicks are summed up into cells as wide as the gap (least and greatest time); two clicks of
one cell are never a gap apart, so gap islands follow from the cells alone. Islands are joined
back to the clicks, which are then split by final clicks and by length.

One client may hold a third of all rows and never pause, so neither a client's clicks nor an
island's ever meet in one task. The unit is a *block* of a client, some cells long: windows
run inside blocks, and what goes over a border (the last time, whether a final click came
last, the open session's start) is carried through one row a block. Inside a block, clicks
between gaps and finals form a *piece*. Length splits depend on where the open session
began, so a block that has neither gap nor final maps the start it is given to the start it
leaves; chains of such blocks are composed by doubling.

Defined cases: rows without client or time count for nothing; of rows with one ``click_id``
(null is one id) the least by time, client, arrival, value counts; a null arrival is timely;
a null, NaN or infinite value is worth 0 and never final; empty tables give no sessions;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise, small_batches

MINUTE = 60_000_000
#: Cells in a block.
CELLS = 24
FINAL_KINDS = ("purchase", "signup")
FINAL_VALUE = 60
#: Stands for a null click_id.
_NO_ID = -(2**63)
_PART = "client long, block long, piece long, start_us long, start_id long, hi long, n long, cents long, ids array<long>, closed string, head boolean, tail boolean"
_MAP = "chain long, client long, pos long, at array<long>, out_us array<long>, out_id array<long>"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; a time without a zone is read as UTC, whatever the session's zone."""
    c = df[name]
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        seconds = (F.unix_date(F.to_date(c)) * 24 + F.hour(c)) * 60 + F.minute(c)
        return seconds.cast("long") * MINUTE + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_micros(c.cast("timestamp"))


def _floor(us: str, width: int) -> Column:
    return F.col(us) - F.pmod(F.col(us), F.lit(width))


def once(clicks: DataFrame, late: int, final: Column | None = None) -> DataFrame:
    """(client, us, id, cents, final, late) of every click that counts, once for each click_id."""
    value = F.when(~F.isnan(clicks["value"]) & (F.abs(clicks["value"]) < float("inf")), clicks["value"])
    us, arrived = micros(clicks, "ts"), micros(clicks, "arrived_at")
    rows = clicks.where(clicks["client_id"].isNotNull() & clicks["ts"].isNotNull()).select(
        F.coalesce(clicks["click_id"].cast("long"), F.lit(_NO_ID)).alias("id"), clicks["client_id"].cast("long").alias("client"), us.alias("us"), arrived.alias("arrived"),
        F.coalesce(F.floor(100 * value + 0.5), F.lit(0)).cast("long").alias("cents"),
        F.coalesce((value >= FINAL_VALUE) & clicks["kind"].isin(*FINAL_KINDS) if final is None else final, F.lit(False)).alias("final"),
    )
    first = Window.partitionBy("id").orderBy("us", "client", "arrived", "cents", "final")
    return rows.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("client", "us", "id", "cents", "final", F.coalesce(F.col("arrived") - F.col("us") > late, F.lit(False)).alias("late"))


def island_starts(timely: DataFrame, gap: int) -> DataFrame:
    """(client, block, starts): times at which gap islands of the client begin inside the block.

    Cells are compared inside their block; a block's first cell is compared with the last
    time of the client's block before.
    """
    cells = timely.groupBy("client", _floor("us", gap * CELLS).alias("block"), _floor("us", gap).alias("cell")).agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    before = F.lag("hi").over(Window.partitionBy("client", "block").orderBy("cell"))
    inside = cells.withColumn("start", F.when(F.col("lo") - before >= gap, F.col("lo")))
    blocks = inside.groupBy("client", "block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list("start").alias("inside"))
    last = F.lag("hi").over(Window.partitionBy("client").orderBy("block"))
    opens = last.isNull() | (F.col("lo") - last >= gap)
    return blocks.select("client", "block", F.when(opens, F.concat(F.array("lo"), "inside")).otherwise(F.col("inside")).alias("starts"))


def pieces(timely: DataFrame, starts: DataFrame, gap: int) -> DataFrame:
    """Clicks of a block between gaps and after finals, with their clicks in order.

    (client, block, piece, lo, hi, n, cents, by_gap, final, clicks); piece counts from 0 or 1 in its block.
    """
    rows = timely.select("client", _floor("us", gap * CELLS).alias("block"), "us", "id", "cents", "final").join(starts, ["client", "block"])
    inside = Window.partitionBy("client", "block").orderBy("us", "id")
    gone = F.lag("us").over(inside)
    rows = rows.select("client", "block", "us", "id", "cents", "final", (F.array_contains("starts", F.col("us")) & (gone.isNull() | (gone < F.col("us")))).alias("by_gap"), F.coalesce(F.lag("final").over(inside), F.lit(False)).alias("after"))
    rows = rows.withColumn("piece", F.sum((F.col("by_gap") | F.col("after")).cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("client", "block", "piece").agg(
        F.min("us").alias("lo"), F.max("us").alias("hi"), F.count("*").alias("n"), F.sum("cents").alias("cents"), F.max("by_gap").alias("by_gap"), F.max("final").alias("final"),
        F.sort_array(F.collect_list(F.struct("us", "id", "cents"))).alias("clicks"),
    )


def borders(parts: DataFrame) -> DataFrame:
    """One row a block: whether its first piece goes on with an open session (``open``), whether the next block's does, and what chain of blocks without a break it is part of."""
    first, last = (F.min_by(F.struct("lo", "by_gap"), "piece"), F.max_by(F.struct("hi", "final"), "piece"))
    blocks = parts.groupBy("client", "block").agg(first.alias("first"), last.alias("last"), F.min("piece").alias("head"), F.max("piece").alias("tail"))
    order = Window.partitionBy("client").orderBy("block")
    blocks = blocks.select(
        "client", "block", "head", "tail", F.col("last.hi").alias("hi"),
        (~F.col("first.by_gap") & ~F.coalesce(F.lag("last.final").over(order), F.lit(True))).alias("open"),
        F.lag("last.hi").over(order).alias("before"), F.lead("first.by_gap").over(order).alias("next_gap"), F.col("last.final").alias("final"),
    )
    through = F.col("open") & (F.col("head") == F.col("tail"))
    blocks = blocks.withColumn("through", through).withColumn("goes_on", F.coalesce(F.lead("open").over(order), F.lit(False)))
    # blocks of a chain follow a block that is not run through; chain: its start
    chain = F.max(F.when(~F.col("through"), F.col("block"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumn("chain", chain).withColumn("pos", F.count("*").over(Window.partitionBy("client", "chain").orderBy("block")))


def _last_starts(us: np.ndarray, length: int) -> np.ndarray:
    """For each click as a session's start: the last start that length splits lead to."""
    at = np.searchsorted(us, us + length, side="right")
    at = np.where(at == len(us), np.arange(len(us)), at)
    while True:
        further = at[at]
        if np.array_equal(further, at):
            return at
        at = further


def _start_maps(length: int):
    """Per block that is run through: the entries that an open session can lead to, and the starts that they leave."""

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                us, ids = np.array(r.us, dtype=np.int64), np.array(r.ids, dtype=np.int64)
                entries = int(np.searchsorted(us, r.before + length, side="right")) + 1
                ends = _last_starts(us, length)[:entries]
                out.append((r.chain, r.client, r.pos, us[:entries], us[ends], ids[ends]))
            yield pd.DataFrame(out, columns=["chain", "client", "pos", "at", "out_us", "out_id"])

    return maps


def _led(at: np.ndarray, out_us: np.ndarray, out_id: np.ndarray, us: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where starts (us, ids) are led to; those beyond all entries stay."""
    k = np.searchsorted(at, us + length, side="right")
    stay = k == len(at)
    k = np.minimum(k, len(at) - 1)
    return np.where(stay, us, out_us[k]), np.where(stay, ids, out_id[k])


def _composed(length: int):
    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                us, ids = _led(np.array(r.at2), np.array(r.us2), np.array(r.id2), np.array(r.out_us), np.array(r.out_id), length)
                out.append((r.chain, r.client, r.pos, r.at, us, ids))
            yield pd.DataFrame(out, columns=["chain", "client", "pos", "at", "out_us", "out_id"])

    return compose


def _followed(length: int):
    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                us, ids = _led(np.array(r.at), np.array(r.out_us), np.array(r.out_id), np.array([r.s_us]), np.array([r.s_id]), length)
                out.append((r.client, r.chain, r.pos + r.step, int(us[0]), int(ids[0])))
            yield pd.DataFrame(out, columns=["client", "chain", "pos", "s_us", "s_id"])

    return follow


def open_starts(parts: DataFrame, blocks: DataFrame, length: int) -> DataFrame:
    """(client, block, s_us, s_id): the session's start that each open block begins with.

    Where the block before ends in a piece of its own, that piece's splits give it. Along a
    chain of blocks that are run through, the maps of 1, 2, 4, ... blocks are composed, so
    the rounds are the logarithm of the longest chain.
    """
    ended = blocks.where("goes_on AND NOT through").select("client", "block", "chain", "pos", "tail")
    ended = ended.join(parts.select("client", "block", F.col("piece").alias("tail"), "clicks"), ["client", "block", "tail"])
    heads = blocks.where("open").select("client", "block", "chain", "pos")

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                us = np.array(r.us, dtype=np.int64)
                k = _last_starts(us, length)[0]
                out.append((r.client, r.block, int(us[k]), int(r.ids[k])))
            yield pd.DataFrame(out, columns=["client", "chain", "s_us", "s_id"])

    # a block that is not run through heads the chain of those behind it
    flat = ended.select("client", "block", F.col("clicks.us").alias("us"), F.col("clicks.id").alias("ids"))
    known = flat.mapInPandas(last, "client long, chain long, s_us long, s_id long").select("client", "chain", F.lit(1).cast("long").alias("pos"), "s_us", "s_id")
    known = materialise(known, "session-open")
    through = blocks.where("through")
    longest = through.agg(F.max("pos")).first()[0]
    if longest:
        maps = through.join(parts.select("client", "block", "clicks"), ["client", "block"]).select("chain", "client", "pos", "before", F.col("clicks.us").alias("us"), F.col("clicks.id").alias("ids"))
        maps = materialise(maps.mapInPandas(_start_maps(length), _MAP), "session-maps")
        step = 1
        while step <= longest:
            led = known.join(maps, ["client", "chain", "pos"]).withColumn("step", F.lit(step))
            found = led.mapInPandas(_followed(length), "client long, chain long, pos long, s_us long, s_id long")
            known = materialise(known.unionByName(found), "session-open")
            if 2 * step <= longest:
                behind = maps.select("client", "chain", (F.col("pos") - step).alias("pos"), F.col("at").alias("at2"), F.col("out_us").alias("us2"), F.col("out_id").alias("id2"))
                maps = materialise(maps.join(behind, ["client", "chain", "pos"]).mapInPandas(_composed(length), _MAP), "session-maps")
            step *= 2
    return heads.join(known, ["client", "chain", "pos"]).select("client", "block", "s_us", "s_id")


def _split(length: int):
    """Pieces that need length splits or begin with an open session, to parts of sessions."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["client", "block", "piece", "start_us", "start_id", "hi", "n", "cents", "ids", "closed", "head", "tail"]
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                us, ids, cents = (np.array(x, dtype=np.int64) for x in (r.us, r.ids, r.each))
                begin, k = ([], 0)
                if not pd.isna(r.s_us):
                    k = int(np.searchsorted(us, int(r.s_us) + length, side="right"))
                    if k:
                        begin.append((0, int(r.s_us), int(r.s_id)))
                while k < len(us):
                    begin.append((k, int(us[k]), int(ids[k])))
                    k = int(np.searchsorted(us, us[k] + length, side="right"))
                for i, (a, s_us, s_id) in enumerate(begin):
                    last = i + 1 == len(begin)
                    b = len(us) if last else begin[i + 1][0]
                    head = i == 0 and not pd.isna(r.s_us) and s_us == r.s_us and s_id == r.s_id
                    out.append((r.client, r.block, r.piece, s_us, s_id, int(us[b - 1]), b - a, int(cents[a:b].sum()), ids[a:b], r.closed if last else "length", head, bool(r.tail and last)))
            yield pd.DataFrame(out, columns=names)

    return split


def sessions(clicks: DataFrame, gap_minutes: int = 15, length_minutes: int = 60, late_minutes: int = 15, final: Column | None = None) -> DataFrame:
    """One row a session: client_id, session_id, start_us, end_us, n_clicks, n_late, value_cents, closed_by, path (click ids in order).

    A client's timely clicks, by time and id, go on with its session unless the one before is
    final, or at least the gap earlier, or the session's first is more than the length earlier.
    """
    gap, length = gap_minutes * MINUTE, length_minutes * MINUTE
    if length > (CELLS - 2) * gap:
        raise ValueError(f"a session's length must stay below {CELLS - 2} gaps")  # a block that is run through is longer than a session
    base = materialise(once(clicks, late_minutes * MINUTE, final), "session-clicks")
    timely = base.where("NOT late")
    parts = materialise(pieces(timely, island_starts(timely, gap), gap), "session-pieces")
    blocks = materialise(borders(parts.drop("clicks")), "session-blocks")
    with small_batches(clicks.sparkSession):
        opened = open_starts(parts, blocks, length)
    # why a piece's last part is closed: null while the next block goes on with it
    why = F.when(F.col("final"), "end").when(F.col("piece") < F.col("tail_piece"), "gap").when(F.col("next_gap").isNull(), "none").when(~F.col("goes_on"), "gap")
    ends = blocks.select("client", "block", F.col("tail").alias("tail_piece"), "next_gap", "goes_on", F.when(F.col("open"), F.col("head")).alias("open_piece"))
    rows = parts.join(ends, ["client", "block"]).withColumn("closed", why).withColumn("tail", (F.col("piece") == F.col("tail_piece")) & F.col("goes_on"))
    special = (F.col("hi") - F.col("lo") > length) | F.col("piece").eqNullSafe(F.col("open_piece"))
    plain = rows.where(~special).select(
        "client", "block", "piece", F.col("lo").alias("start_us"), F.col("clicks")[0]["id"].alias("start_id"), "hi", "n", "cents", F.col("clicks.id").alias("ids"), "closed", F.lit(False).alias("head"), "tail"
    )
    hard = rows.where(special).join(opened.select("client", "block", F.lit(True).alias("was_open"), "s_us", "s_id"), ["client", "block"], "left")
    mine = F.col("piece").eqNullSafe(F.col("open_piece"))
    hard = hard.select("client", "block", "piece", F.col("clicks.us").alias("us"), F.col("clicks.id").alias("ids"), F.col("clicks.cents").alias("each"), "closed", "tail", F.when(mine, F.col("s_us")).alias("s_us"), F.when(mine, F.col("s_id")).alias("s_id"))
    with small_batches(clicks.sparkSession):
        split = materialise(hard.mapInPandas(_split(length), _PART), "session-parts")
    both = plain.unionByName(split)
    whole = both.where("NOT head AND NOT tail").select("client", "start_us", "start_id", "hi", "n", "cents", "ids", "closed")
    # a session over a border has a part on either side; it is short, so it has no more
    crossing = both.where("head OR tail").groupBy("client", "start_us", "start_id").agg(
        F.max("hi").alias("hi"), F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("hi", "ids"))), lambda x: x["ids"])).alias("ids"), F.coalesce(F.max("closed"), F.lit("length")).alias("closed"),
    )
    found = whole.unionByName(crossing)
    counted = late_counts(base.where("late").select("client", "us"), found.select("client", "start_us", "start_id"), gap)
    out = found.join(counted, ["client", "start_us", "start_id"], "left")
    return out.select(
        F.col("client").alias("client_id"), F.nullif(F.col("start_id"), F.lit(_NO_ID)).alias("session_id"), "start_us", F.col("hi").alias("end_us"), F.col("n").alias("n_clicks"), F.coalesce("n_late", F.lit(0)).cast("long").alias("n_late"),
        F.col("cents").alias("value_cents"), F.col("closed").alias("closed_by"), F.transform("ids", lambda x: F.nullif(x, F.lit(_NO_ID))).alias("path"),
    )


def late_counts(late: DataFrame, starts: DataFrame, gap: int) -> DataFrame:
    """(client, start_us, start_id, n_late): late clicks from a session's start to before the next one's.

    The last start at or before a click is found inside its block, or carried over from the
    client's last block that has one.
    """
    session = F.struct("start_us", "start_id")
    rows = starts.select("client", F.col("start_us").alias("us"), F.lit(0).alias("kind"), session.alias("session")).unionByName(late.select("client", "us", F.lit(1).alias("kind"), F.lit(None).cast("struct<start_us:bigint,start_id:bigint>").alias("session")))
    rows = rows.withColumn("block", _floor("us", gap * CELLS))
    order = Window.partitionBy("client", "block").orderBy("us", "kind", "session.start_id")
    rows = rows.withColumn("mine", F.last("session", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    summed = rows.groupBy("client", "block").agg(F.max("session").alias("last"), F.sum("kind").alias("late"))
    carried = summed.select("client", "block", "late", F.last("last", ignorenulls=True).over(Window.partitionBy("client").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried")).where("late > 0")
    found = rows.where("kind = 1").join(carried.select("client", "block", "carried"), ["client", "block"]).select("client", F.coalesce("mine", "carried").alias("s"))
    return found.where("s IS NOT NULL").groupBy("client", F.col("s.start_us").alias("start_us"), F.col("s.start_id").alias("start_id")).agg(F.count("*").alias("n_late"))


def session_digests(clicks: DataFrame) -> DataFrame:
    """The sessions with the SHA-256 of their comma-joined click ids in place of the path."""
    out = sessions(clicks)
    path = F.concat_ws(",", F.col("path").cast("array<string>"))
    return out.withColumn("path_sha256", F.sha2(path.cast("binary"), 256)).drop("path")
