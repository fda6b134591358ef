"""Balanced label propagation: linked documents move together while shards keep even row counts.

Documents with equal texts are linked. Labels start balanced and as scattered as can be: the members of a group that
fits a shard are dealt to all of them. In each round every cut group chooses the shard that holds most of its members,
and its other members ask to go there. Requests are summed by the pair of shards they lead from and to; quotas let
through what keeps all counts as they are: requests in opposite directions and around cycles cancel, and unlinked
documents go elsewhere in exchange for linked ones. Requests are admitted in an order up to their quota, and the
labels are updated by a join. Members of a group in one shard are alike, so a row stands for all of them, with their
number: a group that holds a third of all rows is at most one row per shard. Groups larger than a shard fill one shard
after the other. The few groups that quotas leave cut at last change places with small whole ones. Rows are numbered
by range partitions, so no group and no shard is gathered into one task.
"""

from __future__ import annotations

import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialkit.llm.common import forget, numbered, stored
from trialkit.operators.blocks import GroupSizes, running_sums

SHARDS = 8
#: Most rounds; they end when few groups are cut that fit a shard, or nothing moves for all choices of equal shards.
ROUNDS = 32
#: At most so many cut groups are settled at last; while half as many requests are made, rounds go on.
SETTLED = 64
#: The smallest group of a shard in each of this many parts of the hash range can give way.
PARTS = 16
#: Bits for the sums of sizes by which groups are chosen to fill a shard; beyond that they go where they fit best.
SUM_BITS = 1 << 28
GROUP = ["g_low", "g_high", "size"]


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: one row per document.

    The law is ``rows``: shard counts are at most one apart, and ``grown_shard`` is NULL. ``size`` is the
    bytes of the text plus 1. NULL texts have size 1 and no links; empty texts are equal to each other.
    Rows with equal or NULL ``doc_id`` are rows of their own. Other columns are not read. An empty table
    gives no rows.
    """
    bare = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(bare) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(bare, "UTF-8")).alias("text_crc32"),
        # NULL texts get a value of their own each, so that they are linked with nothing
        F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.xxhash64(bare)).alias("g_low"),
        F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.xxhash64(F.lit(1), bare)).alias("g_high"),
    )
    base = stored(base, "shard-base").withColumn("row", F.monotonically_increasing_id())
    groups = base.where(F.col("g_low").isNotNull()).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))
    groups = stored(groups.where("n > 1"), "shard-groups")
    linked = base.join(groups, GROUP, "left").withColumn("alone", F.col("n").isNull()).withColumn("few", -F.col("n"))
    rows = numbered(linked, ["alone", "few", "g_low", "g_high", "size", "doc_id", "row"], "rank", "shard-rows")
    total = rows.count()
    caps = [total // shards + (s < total % shards) for s in range(shards)]
    n_large = rows.agg(F.count_if(F.col("n") > max(caps))).first()[0]
    rows = rows.withColumn("home", _scattered(F.col("rank"), caps, total, n_large).cast("int"))
    held = dict(rows.where("alone").groupBy("home").agg(F.count(F.lit(1))).collect())
    free = [held.get(s, 0) for s in range(shards)]
    cells = rows.where(~F.col("alone")).groupBy(*GROUP, F.col("home").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    cells = propagate(stored(cells, "shard-cells"), caps, free, rounds)

    placed = _placed(rows, cells, caps)
    in_order = numbered(placed, ["shard", "doc_id", "rank"], "at", "shard-slots")
    starts = [0, *accumulate(caps)]
    first = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in starts]), F.col("shard") + 1)
    return in_order.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("at") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _scattered(rank: Column, caps: list[int], total: int, n_large: int) -> Column:
    """Balanced first labels: the first ``n_large`` rows by ranges, of the others neighbours far apart.

    The others are read column by column instead of row by row, in as many columns as there are shards, which is
    one to one; ranges of that order fill what the large groups have left of the shards.
    """
    shards, rest = len(caps), total - n_large
    at = rank - F.lit(n_large)
    column, step = F.pmod(at, F.lit(shards)), rest // shards
    place = column * F.lit(step) + F.least(column, F.lit(rest % shards)) + F.floor(at / shards)
    ends = list(accumulate(caps))
    left = [min(cap, max(0, end - n_large)) for cap, end in zip(caps, ends, strict=True)]
    return F.when(at < 0, _range_of(rank, caps)).otherwise(_range_of(place, left))


def quotas(asked: dict[tuple[int, int], int], free: list[int]) -> tuple[dict[tuple[int, int], int], list[int]]:
    """Rows that may go from shard to shard without changing any count, and the unlinked rows of each shard then.

    First requests in opposite directions cancel, then those around longer cycles; what is left over of a request is
    let through as far as the shard it leads to has unlinked rows to give back.
    """
    left = {pair: n for pair, n in sorted(asked.items()) if n > 0}
    out = dict.fromkeys(left, 0)

    def cycle() -> list[tuple[int, int]] | None:
        """The shortest cycle of requests, the first of equally short ones."""
        best = None
        for start in sorted({a for a, _ in left}):
            paths, seen = [[start]], {start}
            while paths and best is None or paths and len(paths[0]) < len(best):
                path = paths.pop(0)
                for b in sorted(b for a, b in left if a == path[-1]):
                    if b == start:
                        best = list(zip(path, [*path[1:], start], strict=True))
                        paths = []
                        break
                    if b not in seen:
                        seen.add(b)
                        paths.append([*path, b])
        return best

    while (found := cycle()) is not None:
        n = min(left[pair] for pair in found)
        for pair in found:
            out[pair] += n
            left[pair] -= n
            if not left[pair]:
                del left[pair]
    free = list(free)
    for (a, b), n in sorted(left.items(), key=lambda x: (-x[1], x[0])):
        n = min(n, free[b])
        out[a, b] += n
        free[b] -= n
        free[a] += n
    return out, free


def one_round(
    cells: DataFrame, shards: int, cap: int, turn: int, free: list[int], by_size: bool = True
) -> tuple[DataFrame | None, list[int], int]:
    """One round over the cells of all groups: the cells then (None if nothing moves), the unlinked rows of the shards
    then, and the requests that were made. Groups larger than ``cap`` make none.

    A group chooses the shard with most of its members, and of equal ones another each ``turn``; without ``by_size``
    any of the shards it is in. Members go where others of their group are, so no round makes pieces.
    """
    tie = F.pmod(F.col("shard") + F.pmod(F.col("g_low"), F.lit(shards)) + F.lit(turn), F.lit(shards))
    choice = F.struct("n", tie) if by_size else tie
    goals = cells.groupBy(*GROUP).agg(
        F.max_by("shard", choice).alias("goal"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("whole")
    )
    goals = goals.where((F.col("parts") > 1) & (F.col("whole") <= cap)).select(*GROUP, "goal")
    asks = cells.join(goals, GROUP).where("shard <> goal").select(*GROUP, "shard", "goal", "n")
    asks = stored(asks, "shard-asks")
    # as many rows as there are pairs of shards
    sums = asks.groupBy("shard", "goal").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("asks")).collect()
    n_asks = sum(r["asks"] for r in sums)
    quota, after = quotas({(r["shard"], r["goal"]): r["n"] for r in sums}, free)
    if not any(quota.values()):
        forget(asks)
        return None, free, n_asks
    limits = cells.sparkSession.createDataFrame([(a, b, n) for (a, b), n in quota.items()], "shard int, goal int, quota long")
    queue = running_sums(asks, ["shard", "goal"], [*GROUP], {"upto": F.col("n")}, sizes=GroupSizes(n_asks, n_asks))
    queue = queue.join(F.broadcast(limits), ["shard", "goal"])
    admitted = F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("upto") + F.col("n")))
    moves = queue.withColumn("m", admitted).where("m > 0")
    ends = moves.select(*GROUP, F.explode(F.array(
        F.struct(F.col("shard").alias("shard"), (-F.col("m")).alias("n")), F.struct(F.col("goal").alias("shard"), F.col("m").alias("n"))
    )).alias("x")).select(*GROUP, "x.*")
    moved = cells.select(*GROUP, "shard", "n").unionByName(ends).groupBy(*GROUP, "shard").agg(F.sum("n").alias("n"))
    out = stored(moved.where("n > 0"), "shard-cells")
    forget(asks)
    return out, after, n_asks


def propagate(cells: DataFrame, caps: list[int], free: list[int], rounds: int) -> DataFrame:
    """Move the members of groups between shards; ``cells`` holds ``n`` by group and ``shard``.

    ``caps`` are the rows of each shard and stay as they are; ``free`` the unlinked ones among them. Rounds go on
    while many groups that fit a shard are cut. The last few, at most ``SETTLED``, are settled on the driver.
    """
    still, before = 0, None
    for turn in range(rounds):
        moved, free, n_asks = one_round(cells, len(caps), max(caps), turn, free, by_size=not still)
        still = still + 1 if moved is None else 0
        if moved is not None:
            if before is not None:
                forget(before)
            cells = before = moved
        if n_asks <= SETTLED // 2 or still > len(caps):
            break
    spread = cells.groupBy(*GROUP).agg(*_by_shard(len(caps)), F.count(F.lit(1)).alias("parts"))
    # groups that fit a shard and are cut all the same, and those that do not fit one
    sizes = F.expr(" + ".join(f"n{s}" for s in range(len(caps))))
    cut = spread.where("parts > 1").orderBy(sizes > max(caps), *GROUP).limit(SETTLED + len(caps))
    cut = _counts(cut.drop("parts"))
    if not cut:
        return cells
    best = _settled(cut, free, max(caps), rounds)
    if _still_cut(best, max(caps)):
        # small whole groups of every shard may change places with them
        part = F.pmod(F.xxhash64(*GROUP), F.lit(PARTS))
        least = F.min(F.struct("n", *GROUP, "shard")).alias("least")
        whole = spread.where("parts = 1").join(cells, GROUP).groupBy("shard", part.alias("part")).agg(least)
        givers = _counts(whole.select("least.*").groupBy(*GROUP).agg(*_by_shard(len(caps))))
        other = _settled(cut | givers, free, max(caps), rounds)
        if _cost(other, max(caps)) < _cost(best | givers, max(caps)):
            best = other
    rows = [(*group, s, n) for group, held in best.items() for s, n in enumerate(held) if n]
    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in [*GROUP, "shard", "n"])
    settled = F.broadcast(cells.sparkSession.createDataFrame(rows, kinds))
    kept = cells.select(*GROUP, "shard", "n").join(settled.select(*GROUP), GROUP, "left_anti")
    return stored(kept.unionByName(settled), "shard-cells")


def _by_shard(shards: int) -> list[Column]:
    """The members that each shard has."""
    return [F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in range(shards)]


def _counts(groups: DataFrame) -> dict[tuple, list[int]]:
    return {tuple(r[: len(GROUP)]): list(r[len(GROUP) :]) for r in groups.orderBy(*GROUP).collect()}


def _cost(held: dict[tuple, list[int]], cap: int) -> tuple[int, int]:
    """Cut groups that fit a shard, and pieces of all groups."""
    return _still_cut(held, cap), sum(sum(n > 0 for n in v) for v in held.values())


def _still_cut(held: dict[tuple, list[int]], cap: int) -> int:
    return sum(sum(v) <= cap and max(v) < sum(v) for v in held.values())


def _settled(groups: dict[tuple, list[int]], free: list[int], cap: int, rounds: int) -> dict[tuple, list[int]]:
    """Where the groups go when all of them ask at once: the round that leaves fewest of them cut."""
    room = [n + sum(held[s] for held in groups.values()) for s, n in enumerate(free)]
    small_first = sorted(groups, key=lambda g: sum(groups[g]))
    best, rng = groups, random.Random(1)
    for k in range(rounds):
        if k == 0:
            got = _admitted(groups, room, small_first)
        elif k == 1:
            got = _admitted(groups, room, small_first[::-1])
        else:
            order = sorted(range(len(room)), key=lambda s: room[s] if k == 2 else rng.random())
            got = _filled(groups, room, small_first[::-1], order, cap)
        if _cost(got, cap) < _cost(best, cap):
            best = got
        if not _still_cut(best, cap):
            break
    return best


def _admitted(groups: dict[tuple, list[int]], room: list[int], order: list[tuple]) -> dict[tuple, list[int]]:
    """Each group in ``order`` goes to the shard with most of its members that has room for all of it.

    Of several shards the one with least room is taken. Groups that fit nowhere share what is left, the
    widest room first.
    """
    room, out, rest = list(room), {}, []
    for g in order:
        n = sum(groups[g])
        fits = [s for s in range(len(room)) if room[s] >= n]
        if not fits:
            rest.append(g)
            continue
        goal = max(fits, key=lambda s: (groups[g][s], -room[s], -s))
        room[goal] -= n
        out[g] = [n if s == goal else 0 for s in range(len(room))]
    for g in rest:
        n, out[g] = sum(groups[g]), [0] * len(room)
        for s in sorted(range(len(room)), key=lambda s: -room[s]):
            out[g][s] = min(n, room[s])
            room[s] -= out[g][s]
            n -= out[g][s]
    return out


def _filled(groups: dict[tuple, list[int]], room: list[int], large_first: list[tuple], shards: list[int], cap: int) -> dict[tuple, list[int]]:
    """One shard after the other takes the groups that fill it best; what is left over is admitted as it fits."""
    room, out = list(room), {}
    left = [g for g in large_first if sum(groups[g]) <= cap]
    for s in shards:
        sizes = [sum(groups[g]) for g in left]
        width = min(room[s], sum(sizes))
        if width * len(sizes) > SUM_BITS:
            continue
        # the sums of the first sizes, as bits
        sums = [1]
        for n in sizes:
            sums.append((sums[-1] | sums[-1] << n) & ((1 << width + 1) - 1))
        at, stay = sums[-1].bit_length() - 1, []
        for i in reversed(range(len(left))):
            if sums[i] >> at & 1:
                stay.append(left[i])
            else:
                at -= sizes[i]
                room[s] -= sizes[i]
                out[left[i]] = [sizes[i] if t == s else 0 for t in range(len(room))]
        left = stay[::-1]
    rest = [g for g in large_first if g not in out]
    return out | _admitted({g: groups[g] for g in rest}, room, rest)


def _range_of(at: Column, counts: list[int]) -> Column:
    """The shard whose run of ``counts`` covers position ``at``."""
    out = F.lit(len(counts) - 1)
    for s, end in reversed(list(enumerate(accumulate(counts)))):
        out = F.when(at < end, F.lit(s)).otherwise(out)
    return out


def _placed(rows: DataFrame, cells: DataFrame, caps: list[int]) -> DataFrame:
    """Give every row its shard: members of a group by their number in it, the others where room is left."""
    held = dict(cells.groupBy("shard").agg(F.sum("n")).collect())
    room = [cap - held.get(s, 0) for s, cap in enumerate(caps)]
    # per group: where its run of ranks begins and how many members each shard has
    members = rows.where(~F.col("alone")).groupBy(*GROUP).agg(F.min("rank").alias("begin"))
    plan = cells.groupBy(*GROUP).agg(*_by_shard(len(caps))).join(members, GROUP)
    inside = F.col("rank") - F.col("begin")
    upto, ends = F.lit(0), []
    for s in range(len(caps)):
        upto = upto + F.col(f"n{s}")
        ends.append(upto)
    shard = F.lit(len(caps) - 1)
    for s in range(len(caps) - 1, -1, -1):
        shard = F.when(inside < ends[s], F.lit(s)).otherwise(shard)
    kept = ["doc_id", "size", "text_crc32", "rank"]
    together = rows.where(~F.col("alone")).join(plan, GROUP).select(*kept, shard.cast("int").alias("shard"))
    n_linked = F.lit(sum(held.values()))
    alone = rows.where("alone").select(*kept, _range_of(F.col("rank") - n_linked, room).cast("int").alias("shard"))
    return together.unionByName(alone)
