"""Sharding by longest-processing-time scheduling of groups that stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, utf8
from .prefix import in_order, prefix_sums

#: Rows numbered by one task at a time: 2^17.
_RUN_BITS = 17


def schedule(sizes: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Longest processing time first: each item, by falling size (ties by falling
    name), goes to the least-loaded shard (ties to the smallest number)."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for size, name in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        placed[name] = s
        heapq.heappush(heap, (load + size, s))
    return placed


def deal(load: list[int], count: int, size: float) -> list[tuple[int, list[int]]]:
    """Longest processing time for ``count`` items of one size: [(first rank, shards)], where
    from a rank on, until the next entry's, items go to the shards in turn.

    The item that meets shard s as its j-th does so at load[s] + j * size; items go in
    the order of these loads. So the least-loaded shard alone is filled up to the
    next one, then these two take turns, and so on until all shards do.
    """
    order, out, rank = sorted(range(len(load)), key=lambda s: (load[s], s)), [], 0
    # when each shard takes part: the turn is sorted by the loads that are left over
    reached = [float(load[s]) for s in order]
    for i, s in enumerate(order):
        if rank >= count:
            break
        until = reached[i + 1] if i + 1 < len(order) else None
        active = order[:i + 1]
        # the loads of the active shards now, and how many items each takes before the next joins
        now = [reached[j] for j in range(i + 1)]
        turn = sorted(range(i + 1), key=lambda j: (now[j], active[j]))
        out.append((rank, [active[j] for j in turn]))
        if until is None:
            break
        taken = [max(0, -int((now[j] - until) // size)) for j in turn]
        rounds = min(taken)
        rank += rounds * len(turn)
        late = [j for j, n in zip(turn, taken) if n > rounds]              # these take one more each
        if late:
            out.append((rank, [active[j] for j in late]))
            rank += len(late)
        for j, n in zip(turn, taken):
            reached[j] += n * size
    return [(r, shards) for r, shards in out if r < count]


def assign_shards(docs: DataFrame, shards: int = 16, units: int = 16384, classes: int = 64, group: Column | None = None) -> DataFrame:
    """Put rows into shards of nearly equal bytes; groups stay together.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1; a group is the
    rows with equal texts unless ``group`` (any string or binary expression over
    ``docs``) says otherwise. Groups go by falling size to the least-loaded shard.
    Those of at least a ``units``-th of all bytes, at most ``units``, go through a
    heap one by one. The smaller ones are numbered by falling size in size classes
    (``classes`` for each doubling, so sizes in a class differ by about 1 %); the
    driver gets a count and a sum for each class, deals a class as items of its mean
    size, and each group finds its shard by its number. So the driver holds at most
    ``units`` sizes and 64 * ``classes`` class rows, however large the table, and
    every group is placed by its size.

    Returns (doc_id, size, text_crc32, shard, slot): slots number a shard's rows
    from 0 without gaps, in the order of the input's partitions. Null texts equal
    empty ones, repeated rows are kept, further columns are ignored, a null group
    is a group, and an empty table gives an empty result.
    """
    name = F.sha2(F.coalesce(group.cast("binary"), F.lit(b"\0null")) if group is not None else utf8(), 256)
    rows = stage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(utf8()) + F.lit(1)).cast("long").alias("size"),
        F.crc32(utf8()).alias("text_crc32"), F.unhex(name).alias("group"), F.monotonically_increasing_id().alias("row")))
    # sizes of groups; the rows of a group are added up before and after the shuffle
    sizes = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    groups = in_order(sizes.withColumn("class", F.floor(F.log2("bytes") * classes).cast("int")), F.desc("class"), F.desc("bytes"), F.col("group"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") * F.lit(units) >= F.lit(total)
    # both lists are bounded by parameters, not by the table
    own = [(r["bytes"], r["group"]) for r in groups.where(large).select("bytes", "group").toLocalIterator()]
    shard_of = schedule([(n, bytes(g)) for n, g in own], shards)
    load = [0] * shards
    for n, g in own:
        load[shard_of[bytes(g)]] += n
    dealt = []
    for r in groups.where(~large).groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).orderBy(F.desc("class")).collect():
        mean, plan = r["bytes"] / r["n"], deal(load, r["n"], r["bytes"] / r["n"])
        ends = [first for first, _ in plan[1:]] + [r["n"]]
        for (first, turn), end in zip(plan, ends):
            dealt.append((r["class"], first, end, turn))
            for k, s in enumerate(turn):
                load[s] += mean * ((end - first - k + len(turn) - 1) // len(turn))
    spark = docs.sparkSession
    turns = spark.createDataFrame(dealt, "class int, first long, end long, turn array<int>")
    ranked = prefix_sums(groups.where(~large), {"rank": F.lit(1)}, [F.desc("bytes"), F.col("group")], ["class"])
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    at = F.element_at("turn", ((F.col("rank") - F.col("first")) % F.size("turn") + 1).cast("int"))
    small = ranked.join(F.broadcast(turns), ["class"]).where(inside).select("group", at.alias("shard"))       # at most 2 * shards rows a class
    big = spark.createDataFrame([(bytearray(g), s) for g, s in shard_of.items()], "group binary, shard int")
    put = (rows.join(small.unionByName(big), "group")
           .select("doc_id", "size", "text_crc32", "shard", "row", F.shiftright("row", _RUN_BITS).alias("run")))
    return (prefix_sums(stage(put), {"slot": F.lit(1)}, [F.col("row")], ["shard"])
            .select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot")))
