"""Groups of equal texts stay whole on tables that leave shards little room."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from test_quality_and_language import check_shards

from trialkit.llm.sharding import one_round, propagate, quotas, shard_documents


def homes_of(got):
    homes = {}
    for r in got:
        homes.setdefault(r["text_crc32"], set()).add(r["shard"])
    return homes


@pytest.mark.parametrize("alone", [0, 8])
def test_groups_stay_together_where_hardly_a_document_is_unlinked(spark, alone):
    rows = [(i, f"copy {i // 2}") for i in range(800)] + [(1000 + i, f"text {i}") for i in range(alone)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    check_shards(rows, got)
    assert all(len(shards) == 1 for shards in homes_of(got).values())


def test_groups_of_several_sizes_fill_all_shards_whole(spark):
    rows = [(10 * i + j, f"copy {i}") for i, n in enumerate([2, 3, 5, 2, 3, 2, 4] * 32) for j in range(n)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(rows, got)
    assert all(len(shards) == 1 for shards in homes_of(got).values())


def test_opposite_requests_cancel(spark):
    cells = [(g, g, 5, s, n) for g in range(40) for s, n in ((0, 1 + g % 2), (1, 2 - g % 2))]
    df = spark.createDataFrame(cells, "g_low long, g_high long, size long, shard int, n long")
    out = propagate(df, [60, 60], [0, 0], 5).collect()
    assert len(out) == 40 and all(r["n"] == 3 for r in out)
    assert sum(r["n"] for r in out if r["shard"] == 0) == 60


@pytest.mark.parametrize("alone", [40, 200])
def test_with_groups_larger_than_a_shard_all_others_stay_whole(spark, alone):
    large = [240, 160]
    texts = [f"large {k}" for k, n in enumerate(large) for _ in range(n)]
    texts += [f"copy {i // 2}" for i in range(800 - sum(large) - alone)] + [f"text {i}" for i in range(alone)]
    rows = list(enumerate(texts))
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(rows, got)
    homes = homes_of(got)
    # shards of 100 rows: 2.4 and 1.6 of them
    assert [len(homes.pop(zlib.crc32(f"large {k}".encode()))) for k in range(2)] == [3, 2]
    assert all(len(shards) == 1 for shards in homes.values())


def test_cells_in_full_shards_move_and_shards_open_again(spark):
    """Shard 0 is full, single rows ask to leave it, and shard 2 has room only for those that hold nothing there."""
    cells = [(1, 1, 5, 0, 300), (1, 1, 5, 1, 100)] + [(g, g, 5, s, 1) for g in range(2, 102) for s in (1, 2)]
    df = spark.createDataFrame(cells, "g_low long, g_high long, size long, shard int, n long")
    out = propagate(df, [300, 300, 300], [0, 100, 200], 16).collect()
    held = [sum(r["n"] for r in out if r["shard"] == s) for s in range(3)]
    assert max(held) <= 300 and sum(held) == 600
    assert sum(r["g_low"] != 1 for r in out) == 100


def plain_round(cells, shards, cap, turn, free, by_size):
    """The same round over a dictionary of counts by (group, shard)."""
    groups = defaultdict(dict)
    for (g, s), n in cells.items():
        groups[g][s] = n
    queues = defaultdict(list)
    for g, held in sorted(groups.items()):
        if len(held) > 1 and sum(held.values()) <= cap:
            tie = {s: (s + g[0] % shards + turn) % shards for s in held}
            goal = max(held, key=lambda s: (held[s], tie[s]) if by_size else tie[s])
            for s, n in held.items():
                if s != goal:
                    queues[s, goal].append((g, n))
    quota, after = quotas({pair: sum(n for _, n in q) for pair, q in queues.items()}, free)
    if not any(quota.values()):
        return None, free
    out = Counter(cells)
    for (a, b), queue in queues.items():
        left = quota[a, b]
        for g, n in queue:
            m = min(n, left)
            left -= m
            out[g, a] -= m
            out[g, b] += m
    return {k: n for k, n in out.items() if n}, after


@pytest.mark.parametrize("seed", range(3))
def test_rounds_equal_plain_python(spark, seed):
    rng = random.Random(seed)
    shards, cap = 5, 40
    cells = {}
    for g in range(60):
        for s in rng.sample(range(shards), rng.randrange(1, shards + 1)):
            cells[(rng.randrange(-9, 9) * 100 + g, g, 5), s] = rng.choice([1, 1, 2, 7, 30])
    keep = {}
    for (g, s), n in cells.items():  # one key per group
        keep.setdefault(g[1], g)
    cells = {(keep[g[1]], s): n for (g, s), n in cells.items()}
    free = [rng.choice([0, 3, 20]) for _ in range(shards)]
    df = spark.createDataFrame([(*g, s, n) for (g, s), n in cells.items()], "g_low long, g_high long, size long, shard int, n long")
    totals = [sum(n for (_, s), n in cells.items() if s == t) + free[t] for t in range(shards)]
    for turn in range(4):
        by_size = turn != 2
        moved, got_free, _ = one_round(df, shards, cap, turn, free, by_size)
        want, want_free = plain_round(cells, shards, cap, turn, free, by_size)
        assert got_free == want_free
        if want is None:
            assert moved is None
            continue
        got = {((r["g_low"], r["g_high"], r["size"]), r["shard"]): r["n"] for r in moved.collect()}
        assert got == want
        # no round makes pieces, and no shard changes its number of rows
        assert len(got) <= len(cells)
        assert totals == [sum(n for (_, s), n in got.items() if s == t) + got_free[t] for t in range(shards)]
        cells, free, df = got, got_free, moved


def test_quotas_keep_all_counts():
    rng = random.Random(4)
    for _ in range(300):
        shards = rng.randrange(2, 7)
        asked = {(a, b): rng.randrange(0, 9) for a in range(shards) for b in range(shards) if a != b}
        free = [rng.choice([0, 0, 5]) for _ in range(shards)]
        quota, after = quotas(asked, free)
        assert all(0 <= n <= asked[pair] for pair, n in quota.items()) and min(after) >= 0
        for s in range(shards):
            gone = sum(n for (a, _), n in quota.items() if a == s) - sum(n for (_, b), n in quota.items() if b == s)
            assert after[s] - free[s] == gone
    assert quotas({(0, 1): 4, (1, 0): 3}, [0, 0])[0] == {(0, 1): 3, (1, 0): 3}
    assert quotas({(0, 1): 4, (1, 2): 2, (2, 0): 9}, [0, 0, 0])[0] == {(0, 1): 2, (1, 2): 2, (2, 0): 2}
    assert quotas({}, [1, 2]) == ({}, [1, 2])
