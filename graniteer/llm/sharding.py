"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of the ring; a key belongs to the first point clockwise of
its hash. A shard takes its own keys in ring order until it is full; the keys that overflow
continue clockwise, first come first served, to the next shards with room. The capacities
add up to the number of rows (two shards differ by one at most), so that balance is exact.
Keys move only when their shard, or one on their way, changes.

The walk needs only the number of keys in each arc (shards * vnodes of them, whatever the
input), so it is a fold over one bounded array; rows are then placed by their rank in the
arc. All of it is built-in functions.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import each_copy, ranked, reject, row_key, staged

#: The ring's length; cells are for finding a key's arc.
RING_BITS, CELL_BITS = 52, 12


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard), in ring order; a shard's points do not depend on the other shards."""
    points = {}
    for s in range(shards):
        for v in range(vnodes):
            at = int(hashlib.md5(f"shard-{s}#{v}".encode()).hexdigest()[:13], 16)
            while at in points:
                at = (at + 1) % (1 << RING_BITS)
            points[at] = s
    return sorted(points.items())


def _arc_ranges(points: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(cell, low, high, arc): which arc a hash in [low, high] of a cell belongs to."""
    size, out = 1 << (RING_BITS - CELL_BITS), []
    at = [p for p, _ in points]
    for cell in range(1 << CELL_BITS):
        low = cell * size
        while low < (cell + 1) * size:
            arc = bisect.bisect_left(at, low)
            high = min((cell + 1) * size - 1, at[arc] if arc < len(at) else 1 << RING_BITS)
            out.append((cell, low, high, arc % len(at)))
            low = high + 1
    return out


def shard_rows(df: DataFrame, key: str, shards: int = 8, vnodes: int = 64) -> DataFrame:
    """Add `shard` (0 to shards-1) and `slot` (gapless from 0 in each shard) to every row.

    key may be null (null is one key) and may repeat: rows of one key share an arc, in the order of a hash of the whole row.
    Rows alike in all columns are held once with their number; which of them has which slot cannot be told. An empty input gives
    an empty result. Columns named shard, slot or __* must not be in the input (ValueError); other columns pass through.
    The rows are written once to the shared folder and counted, ranked and placed from there.
    """
    reject(df, "shard", "slot")
    spark, points = df.sparkSession, ring(shards, vnodes)
    text = ";".join(",".join(map(str, r)) for r in _arc_ranges(points))
    parts = spark.range(1).select(F.explode(F.split(F.lit(text), ";")).alias("t")).select(F.split("t", ",").alias("p"))
    arcs = parts.select(*[F.col("p")[i].cast(k).alias(c) for i, (c, k) in enumerate((("__rc", "long"), ("__low", "long"), ("__high", "long"), ("__arc", "int")))])
    at = F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\x00null")).cast("binary")), 1, 13), 16, 10).cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    held = df.select(row, row_key(df).alias("__key"), at.alias("__at")).groupBy("__key").agg(F.first("__row").alias("__row"), F.first("__at").alias("__at"), F.count(F.lit(1)).alias("__n"))
    held = held.withColumn("__rc", F.shiftrightunsigned("__at", RING_BITS - CELL_BITS))
    # The arc table's size is fixed by shards and vnodes: 4096 + shards * vnodes rows.
    held = held.join(F.broadcast(arcs), (held["__rc"] == arcs["__rc"]) & held["__at"].between(arcs["__low"], arcs["__high"])).drop("__rc", "__low", "__high", "__at")
    held = staged(held, "arcs")
    plan = staged(_walk(held, points, shards), "walk")  # a row for each arc
    held = each_copy(ranked(held, ["__arc"], attach=plan))
    spill = F.col("__over") + F.col("__rank") - F.col("__taken")
    event = F.element_at(F.filter("__events", lambda e: (spill >= e["from"]) & (spill < e["from"] + e["len"])), 1)
    home = F.col("__rank") < F.col("__taken")
    placed = held.withColumn("__e", F.when(~home, event))
    return placed.select(
        "__row.*",
        F.when(home, F.col("__home")).otherwise(F.col("__e.shard")).cast("int").alias("shard"),
        F.when(home, F.col("__base") + F.col("__rank")).otherwise(F.col("__e.base") + spill - F.col("__e.from")).cast("long").alias("slot"),
    )


def _walk(held: DataFrame, points: list[tuple[int, int]], shards: int) -> DataFrame:
    """One row per arc: keys taken at home, their first slot, and where the rest goes."""
    n = len(points)
    empty = held.sparkSession.range(n).select(F.col("id").cast("int").alias("__arc"))
    counts = held.groupBy("__arc").agg(F.sum("__n").alias("n"))
    per_arc = empty.join(counts, "__arc", "left").select("__arc", F.coalesce("n", F.lit(0)).alias("n"))
    one = per_arc.agg(F.transform(F.sort_array(F.collect_list(F.struct("__arc", "n"))), lambda x: x["n"]).alias("ns"), F.sum("n").alias("total"))
    one = one.where(F.col("total") > 0)
    owner = F.array(*[F.lit(s) for _, s in points])
    caps = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.floor(F.col("total") / shards) + F.when(j < F.col("total") % shards, 1).otherwise(0))
    zero = "cast(array() as array<struct<arc:int,shard:int,taken:long,base:long,over:long,n:long>>)"
    # First round: own keys, in ring order.
    homes = F.expr(f"""
        aggregate(sequence(0, {n - 1}),
          struct(room, {zero} as arcs, transform(room, r -> 0L) as used, 0L as over),
          (s, a) -> struct(
            transform(s.room, (r, j) -> case when j = owner[a] then r - least(r, ns[a]) else r end) as room,
            concat(s.arcs, array(struct(a as arc, owner[a] as shard, least(s.room[owner[a]], ns[a]) as taken,
                   s.used[owner[a]] as base, s.over as over, ns[a] as n))) as arcs,
            transform(s.used, (u, j) -> case when j = owner[a] then u + least(s.room[owner[a]], ns[a]) else u end) as used,
            s.over + ns[a] - least(s.room[owner[a]], ns[a]) as over))""")
    none = "cast(array() as array<struct<from:long,len:long,shard:int,base:long>>)"
    # Then the overflow walks on, twice round: an arc's overflow joins the queue's end as the walk leaves it.
    walked = F.expr(f"""
        aggregate(sequence(0, {2 * n - 1}),
          struct(h.room as room, h.used as used, 0L as queued, 0L as placed, {none} as events),
          (s, e) -> named_struct(
            'room', transform(s.room, (r, j) -> case when j = owner[e % {n}] then r - least(r, s.queued) else r end),
            'used', transform(s.used, (u, j) -> case when j = owner[e % {n}] then u + least(s.room[j], s.queued) else u end),
            'queued', s.queued - least(s.room[owner[e % {n}]], s.queued) + case when e < {n} then h.arcs[e].n - h.arcs[e].taken else 0L end,
            'placed', s.placed + least(s.room[owner[e % {n}]], s.queued),
            'events', case when least(s.room[owner[e % {n}]], s.queued) > 0 then
                 concat(s.events, array(named_struct('from', s.placed, 'len', least(s.room[owner[e % {n}]], s.queued),
                        'shard', owner[e % {n}], 'base', s.used[owner[e % {n}]]))) else s.events end))""")
    done = one.select("ns", owner.alias("owner"), caps.alias("room")).withColumn("h", homes).withColumn("w", walked)
    events = F.expr("filter(w.events, e -> e.from < a.over + a.n - a.taken and e.from + e.len > a.over)")
    return done.select("w", F.explode("h.arcs").alias("a")).select(
        F.col("a.arc").alias("__arc"), F.col("a.shard").alias("__home"), F.col("a.taken").alias("__taken"),
        F.col("a.base").alias("__base"), F.col("a.over").alias("__over"), events.alias("__events"),
    )
