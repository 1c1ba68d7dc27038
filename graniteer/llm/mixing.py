"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are cut into blocks. Targets are integer shares; a frame has
`share` blocks of each source that still has that many (what it has left otherwise), so a
frame's composition follows from the frame's number and the sources' block counts alone. In a frame of L slots, block i
of a source with k blocks may run from slot floor(L*i/k) and must be done by slot ceil(L*(i+1)/k);
earliest-deadline-first over these windows always meets them, so that after any slot a
source is less than one block away from its exact share of the frame. When a source has run
out, the others go on in their proportions. Nothing is dropped. Built-in functions only.

Frames of one composition are alike. The composition changes where a source comes to its last frames, twice for each source
at most: the frames between two changes are a phase, and one frame of each phase is scheduled. A block's slot is then
arithmetic on its number, with no table of frames or blocks. The schedule's size follows sources and shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import each_copy, null_key, ranked, reject, row_key, staged


def phases(blocks: DataFrame) -> DataFrame:
    """blocks: (src, share int, n long), one row per source. Returns (src, share, phases), for each source with blocks.

    A phase: frames [first, last), the first frame's first slot `start`, length `len`, the source's blocks `k` in a frame, and their
    slots `at` in the frame. Only the source table is gathered in one row.
    """
    one = blocks.where("n > 0").agg(F.sort_array(F.collect_list(F.struct("src", "share", "n"))).alias("s")).where(F.size("s") > 0)
    edges = "array_sort(array_distinct(concat(array(0L), flatten(transform(s, x -> array(x.n div x.share, (x.n + x.share - 1) div x.share))))))"
    each = one.withColumn("e", F.expr(edges)).select("s", F.explode(F.expr("transform(sequence(1, size(e) - 1), i -> struct(e[i - 1] as first, e[i] as last))")).alias("p"))
    each = each.select("s", "p.first", "p.last").repartition("first")
    each = each.withColumn("k", F.expr("transform(s, x -> greatest(0L, least(cast(x.share as bigint), x.n - x.share * first)))"))
    each = each.withColumn("start", F.expr("aggregate(s, 0L, (a, x) -> a + least(x.n, x.share * first))"))
    each = each.withColumn("len", F.expr("aggregate(k, 0L, (a, x) -> a + x)"))
    best = "array_min(transform(k, (n, x) -> case when a.next[x] < n and (len * a.next[x]) div n <= t then struct((len * (a.next[x] + 1) + n - 1) div n as d, x as x) end))"
    run = each.withColumn("run", F.expr(f"""
        aggregate(sequence(0L, len - 1),
          named_struct('next', transform(k, n -> 0L), 'out', cast(array() as array<int>)),
          (a, t) -> transform(array({best}), b -> named_struct(
              'next', transform(a.next, (v, x) -> case when x = b.x then v + 1 else v end),
              'out', concat(a.out, array(b.x))))[0]).out"""))
    live = run.select("first", "last", "start", "len", "k", "run", F.posexplode("s").alias("x", "src")).where("k[x] > 0")
    at = F.expr("transform(filter(transform(run, (y, t) -> struct(y as y, cast(t as bigint) as t)), z -> z.y = x), z -> z.t)")
    of = F.struct("first", "last", "start", "len", F.expr("k[x]").alias("k"), at.alias("at"))
    return live.groupBy(F.col("src.src").alias("src"), F.col("src.share").alias("share")).agg(F.sort_array(F.collect_list(of)).alias("phases"))


def in_schedule(df: DataFrame, block: str = "block", share: str = "share", listed: str = "phases") -> DataFrame:
    """Add slot, release and deadline (absolute slots) to rows with a block's number, its source's share and phases."""
    held = df.withColumn("__f", F.expr(f"{block} div {share}")).withColumn("__p", F.expr(f"filter({listed}, p -> __f >= p.first and __f < p.last)[0]"))
    held = held.withColumn("__i", F.expr(f"{block} % {share}")).withColumn("__s", F.expr("__p.start + (__f - __p.first) * __p.len"))
    return held.withColumns(
        {
            "slot": F.expr("__s + __p.at[cast(__i as int)]"),
            "release": F.expr("__s + (__p.len * __i) div __p.k"),
            "deadline": F.expr("__s + (__p.len * (__i + 1) + __p.k - 1) div __p.k"),
        }
    ).drop("__f", "__p", "__i", "__s")


def mix(df: DataFrame, shares: dict[str, int] | None = None, source: str = "source", block_rows: int = 64) -> DataFrame:
    """Add block, slot, place (0 to block_rows-1), release and deadline: reading in order of (slot, place) gives the mixture.

    shares: positive integers by source, 1 for a source that has none. A null source is a
    source of its own. Rows of a source are taken in the order of a hash of the whole row, so the result depends on the rows alone;
    rows alike in all columns are held once, with their number, until the end. An empty table gives an empty result. Columns named
    as those added, or __*, must not be in the input (ValueError); other columns pass through.
    """
    shares = {k: int(v) for k, v in (shares or {}).items()}
    if any(v < 1 for v in shares.values()):
        raise ValueError("shares must be positive integers")
    reject(df, "block", "place", "slot", "release", "deadline")
    keyed = df.withColumns({"__key": row_key(df), "__src": null_key(F.col(source))})
    copies = staged(keyed.groupBy("__key", "__src").agg(F.count(F.lit(1)).alias("__n")), "row-keys")
    share = F.lit(1)
    for k, v in sorted(shares.items()):
        share = F.when(F.col("src") == f"v{k}", v).otherwise(share)
    counts = copies.groupBy(F.col("__src").alias("src")).agg(F.sum("__n").alias("c"))
    plan = phases(counts.select("src", share.cast("int").alias("share"), F.expr(f"(c + {block_rows} - 1) div {block_rows}").alias("n")))
    plan = staged(plan.select(F.col("src").alias("__src"), F.col("share").alias("__share"), F.col("phases").alias("__phases")), "phases")
    ranks = each_copy(ranked(copies, ["__src"], attach=plan))
    ranks = ranks.withColumns({"block": F.expr(f"__rank div {block_rows}"), "place": F.col("__rank") % block_rows})
    slots = in_schedule(ranks, share="__share", listed="__phases").drop("__src", "__rank", "__share", "__phases")
    rows = keyed.groupBy("__key").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("__row"))
    return rows.join(slots, "__key").select("__row.*", "block", "place", "slot", "release", "deadline")
