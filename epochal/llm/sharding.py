"""Balanced label propagation: linked documents move towards their neighbours' shards.

Documents with equal texts are linked. A shard is a document's label. The law
is ``rows``: shards' document counts differ by one at most. The state of the
propagation is the table of cells ``(group, shard, count)``; documents of one
cell are alike, so a group of any size is at most ``n_shards`` rows. In each
round every group aims for the shard that holds most of it, and its other cells
move there. What may move from shard to shard is settled on the table of flows,
``n_shards`` by ``n_shards`` numbers: a shard takes in what it has room for,
counting what leaves it in the same round, so that full shards exchange. The
movers of a flow share its quota by prefix sums over hash buckets. Ties between
a group's cells are drawn anew each round. A round that doesn't lessen the
number of cells (the cut) is taken back; in the next, groups aim for the largest
of their shards with room. After ``PATIENCE`` such rounds the propagation ends.
Groups larger than ``1 / HEAVY`` of a shard (at most ``HEAVY *
n_shards`` exist) get their first labels by first fit on the driver, whole or
cut at shard ends. Unlinked documents cut no edge, so they fill what the groups
leave, exactly up to each shard's quota.

Null text counts as empty text (size 16, checksum 0). Repeated ids are documents
of their own, null ids too. Ties between shards go by a hash of group, shard and
round; rows that agree in id, size and checksum may take each other's slots. Texts of
any length count by their bytes. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, distributed_rank, saved

SHARDS = 40
HEAVY = 4
#: Rounds without progress, after which the propagation ends; every other one of them sends groups to shards with room.
PATIENCE = 4


def _first_fit(groups: list[tuple[str, int]], quota: list[int]) -> list[tuple[str, int, int]]:
    """Cells for the heavy groups: the emptiest shard that holds the group, else whole shards from the emptiest on."""
    room, cells = list(quota), []
    for g, n in sorted(groups, key=lambda x: (-x[1], x[0])):
        while n:
            s = max(range(len(room)), key=lambda i: (room[i], -i))
            take = min(n, room[s])
            if not take:
                raise ValueError("quotas are smaller than the groups")
            cells.append((g, s, take))
            room[s] -= take
            n -= take
    return cells


def _loads(cells: DataFrame, n_shards: int) -> list[int]:
    load = [0] * n_shards
    for r in cells.groupBy("s").agg(F.sum("n").alias("n")).collect():  # n_shards rows at most
        load[r["s"]] = r["n"]
    return load


def settle_flows(wanted: list[list[int]], room: list[int]) -> list[list[int]]:
    """What may move from shard to shard: ``room`` (less than 0 where a shard is too full) and what leaves bound what comes in."""
    k = len(room)
    flow = [list(row) for row in wanted]
    while True:
        calm = True
        for t in range(k):
            coming = sum(flow[s][t] for s in range(k))
            most = max(0, room[t] + sum(flow[t]))
            if coming > most:
                calm = False
                share = [flow[s][t] * most // coming for s in range(k)]
                rest = most - sum(share)
                for s in sorted(range(k), key=lambda s: (share[s] - flow[s][t], s)):  # those cut most get the rest
                    more = min(rest, flow[s][t] - share[s])
                    flow[s][t], rest = share[s] + min(more, 1), rest - min(more, 1)
        if calm:
            return flow


def _round(cells: DataFrame, quota: list[int], number: int, free: bool, buckets: int) -> DataFrame | None:
    """The cells after one round; None if nothing moves. ``free``: aims are shards that have room now."""
    spark, k = cells.sparkSession, len(quota)
    room = [q - x for q, x in zip(quota, _loads(cells, k))]
    by_group = Window.partitionBy("g")
    rooms = F.array(*[F.lit(r > 0) for r in room])  # n_shards flags
    here = cells.withColumn("free", F.element_at(rooms, F.col("s") + 1) if free else F.lit(True))
    best = F.struct("free", "n", F.xxhash64("g", "s", F.lit(number)).alias("h"), "s")
    here = here.withColumn("best", F.max(best).over(by_group)).filter("best.free AND best.s <> s")
    moving = movers = saved(here.select("g", "s", "n", F.col("best.s").alias("aim"), F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int").alias("b")), "movers")
    flows = totals = saved(movers.groupBy("s", "aim", "b").agg(F.sum("n").alias("t")), "flows")
    wanted = [[0] * k for _ in range(k)]
    for r in totals.groupBy("s", "aim").agg(F.sum("t").alias("t")).collect():  # n_shards squared rows at most
        wanted[r["s"]][r["aim"]] = r["t"]
    flow = settle_flows(wanted, room)
    allowed = [(s, t, x) for s, row in enumerate(flow) for t, x in enumerate(row) if x]
    if not allowed:
        discard(moving, flows)
        return None
    allowed = spark.createDataFrame(allowed, "s int, aim int, most long")
    upto = Window.partitionBy("s", "aim").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("s", "aim", "b", F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("before"))
    inner = Window.partitionBy("s", "aim", "b").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    movers = movers.withColumn("here", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(totals, ["s", "aim", "b"]).join(F.broadcast(allowed), ["s", "aim"])
    moved = F.greatest(F.lit(0), F.least(F.col("n"), F.col("most") - F.col("before") - F.col("here")))
    moves = saved(movers.select("g", "s", "aim", moved.cast("long").alias("m")).filter("m > 0"), "moves")
    change = moves.select("g", "s", (-F.col("m")).alias("n")).unionByName(moves.select("g", F.col("aim").alias("s"), F.col("m").alias("n")))
    after = saved(cells.unionByName(change).groupBy("g", "s").agg(F.sum("n").alias("n")).filter("n > 0"), "cells")
    discard(moving, flows, moves)
    return after


def propagate(cells: DataFrame, quota: list[int], buckets: int = 256) -> DataFrame:
    """Cells ``(g, s, n)`` after balanced label propagation: no shard above its quota, a group in few shards."""
    cells = saved(cells, "cells")
    n, groups = cells.agg(F.count("*"), F.countDistinct("g")).first()
    calm = number = 0
    while n > groups and calm < PATIENCE:
        after = _round(cells, quota, number, calm % 2 == 1, buckets)
        number += 1
        if after is not None and (now := after.count()) < n:
            discard(cells)
            cells, n, calm = after, now, 0
        else:
            calm += 1
    return cells


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, size, text_crc32, group (digest of its text), group_size, shard, slot."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = saved(docs.select(F.col(id_col), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.md5(t).alias("g")), "shard")
    sizes = base.groupBy("g").agg(F.count("*").alias("group_size"))
    linked_groups = saved(sizes.filter("group_size > 1"), "groups")
    total = base.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    heavy_size = max(1, total // n_shards // HEAVY)
    heavy = [(r["g"], r["group_size"]) for r in linked_groups.filter(F.col("group_size") > heavy_size).collect()]  # fewer than total / heavy_size
    placed = _first_fit(heavy, quota)
    room = [q - sum(n for _, at, n in placed if at == s) for s, q in enumerate(quota)]  # for the other groups
    linked = base.join(linked_groups, "g")

    # First labels by hash, in proportion to the shards' room.
    bounds = F.array(*[F.lit(sum(room[: s + 1])).cast("long") for s in range(n_shards)])
    draw = F.pmod(F.xxhash64(F.col(id_col), "g", F.lit(5)), F.lit(max(1, sum(room))))
    first = F.least(F.size(F.filter(bounds, lambda e: e <= draw)), F.lit(n_shards - 1))
    light = linked.filter(F.col("group_size") <= heavy_size)
    cells = propagate(light.groupBy("g", first.cast("int").alias("s")).agg(F.count("*").alias("n")), room)
    load = _loads(cells, n_shards)
    if over := [s for s in range(n_shards) if load[s] > room[s]]:
        cells, load = _spill(cells, load, room, over)
    cells = cells.unionByName(spark.createDataFrame(placed, "g string, s int, n long"))
    load = [x + q - r for x, q, r in zip(load, quota, room)]

    upto = Window.partitionBy("g").orderBy("s")
    ends = cells.withColumn("end", F.sum("n").over(upto)).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("end", "s"))).alias("ends"))  # n_shards ends at most
    ends = saved(ends, "ends")  # so that the join below can split a hot group
    placed = distributed_rank(linked, ["g"], [id_col, "size", "text_crc32"], "r").join(ends, "g")
    placed = placed.withColumn("shard", F.filter("ends", lambda e: e["end"] > F.col("r"))[0]["s"]).drop("ends", "r")

    left, ends_of_shards = 0, []
    for s in range(n_shards):
        left += quota[s] - load[s]
        ends_of_shards.append(left)
    single = base.join(linked_groups, "g", "left_anti").withColumns({"group_size": F.lit(1).cast("long"), "__one": F.lit(0)})
    single = distributed_rank(single, ["__one"], ["g", id_col], "r").drop("__one")
    single = single.withColumn("shard", F.size(F.filter(F.array(*map(F.lit, ends_of_shards)), lambda e: e <= F.col("r"))).cast("int")).drop("r")
    out = placed.unionByName(single)
    return distributed_rank(out, ["shard"], [id_col, "size", "text_crc32"], "slot").withColumnRenamed("g", "group")


def _spill(cells: DataFrame, load: list[int], quota: list[int], over: list[int]) -> tuple[DataFrame, list[int]]:
    """Moves what is above a quota to shards with room: only where hash luck put too many linked documents on a shard."""
    k, spark = len(quota), cells.sparkSession
    room = [max(0, q - x) for q, x in zip(quota, load)]
    excess = spark.createDataFrame([(s, load[s] - quota[s]) for s in over], "s int, excess long")
    b = F.pmod(F.xxhash64("g"), F.lit(256)).cast("int")
    c = cells.join(F.broadcast(excess), "s").withColumn("b", b)
    before = c.groupBy("s", "b").agg(F.sum("n").alias("t"))
    before = before.select("s", "b", F.coalesce(F.sum("t").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = Window.partitionBy("s", "b").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    c = c.join(before, ["s", "b"]).withColumn("p", F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
    m = F.greatest(F.lit(0), F.least(F.col("n"), F.col("excess") - F.col("p")))
    # The excess of all shards in one row of numbers, dealt over the room in another.
    starts, at = {}, 0
    for s in over:
        starts[s], at = at, at + load[s] - quota[s]
    shift = spark.createDataFrame(list(starts.items()), "s int, shift long")
    c = c.withColumn("m", m).filter("m > 0").join(F.broadcast(shift), "s").withColumn("from", F.col("p") + F.col("shift"))
    slots, end = [], 0
    for s in range(k):
        if room[s]:
            slots.append((s, end, end + room[s]))
            end += room[s]
    slots = spark.createDataFrame(slots, "to int, lo long, hi long")
    pieces = c.join(F.broadcast(slots), (F.col("from") < F.col("hi")) & (F.col("from") + F.col("m") > F.col("lo")))
    pieces = saved(pieces.select("g", "s", "to", (F.least(F.col("from") + F.col("m"), F.col("hi")) - F.greatest("from", "lo")).alias("m")), "spill")
    change = pieces.select("g", "s", (-F.col("m")).alias("n")).unionByName(pieces.select("g", F.col("to").alias("s"), F.col("m").alias("n")))
    cells = saved(cells.unionByName(change).groupBy("g", "s").agg(F.sum("n").alias("n")).filter("n > 0"), "cells")
    return cells, _loads(cells, k)
