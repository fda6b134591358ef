import random
import re

import pytest

from trialkit.llm import ngram_jaccard as nj
from trialkit.llm.line_dedup import dedup_lines

BLANK = re.compile("[\x20\x09-\x0d]+")


def shingles(text):
    words = [w for w in BLANK.split("".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([(len(words), *words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def groups_of(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(seed, n=240):
    """Near copies at every distance, short texts, one passage that is nearly everywhere."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(30)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 9, 11, 25, 60, 150]))] for _ in range(n // 8)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.4:
            words += passage[: rng.choice([8, 30])]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return rows


@pytest.mark.parametrize(("costly", "rounds"), [(50, 1), (50, 3), (500, 0), (3, 1), (0, 0)])
def test_components_equal_brute_force(spark, monkeypatch, costly, rounds):
    monkeypatch.setattr(nj, "COSTLY", costly)
    monkeypatch.setattr(nj, "PIVOT_ROUNDS", rounds)
    rows = corpus(costly + rounds)
    got = nj.jaccard_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == groups_of(rows)


def test_texts_are_found_by_shuffle_as_well(spark, monkeypatch):
    monkeypatch.setattr(nj, "BROADCAST_ROWS", 0)
    rows = corpus(77, 120)
    got = nj.jaccard_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == groups_of(rows)


def test_linked_sets_meet_in_enough_keys():
    """The pigeonhole bound itself: sets at the threshold share more keys than the guard."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(2))
    for _ in range(400):
        r = int(rng.integers(1, 200))
        s = int(rng.integers(r, r * 4 // 3 + 1))
        common = -(-3 * (r + s) // 7)
        if common > r:
            continue
        ids = np.unique(rng.integers(0, 2**63, r + s - common + 9, dtype=np.uint64))[: r + s - common]
        rng.shuffle(ids)
        a, b = np.sort(ids[:r]), np.sort(ids[r - common :])
        assert len(b) == s
        keys = [set(nj.segment_keys(x, len(x) // 3 + 1 + nj.guard(len(x))).tolist()) for x in (a, b)]
        assert len(keys[0] & keys[1]) >= 1 + (min(map(nj.guard, (r, s))) if r > nj.SMALLEST else 0)


def test_one_deletion_meets_in_the_smallest_band():
    import numpy as np

    a = np.array([5, 9, 2**62, 2**63], np.uint64)
    assert set(nj.segment_keys(a, 4).tolist()) & set(nj.segment_keys(a[[0, 2, 3]], 3).tolist())


def connected_brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        x, y = sorted((root(u), root(v)))
        parent[y] = x
    return {x: root(x) for x in parent if x != root(x)}


def test_connected_finds_the_smallest_reachable(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    edges = [(u, v) for u, v in edges if u != v]
    got = nj.connected(spark.createDataFrame(edges, "u long, v long"))
    assert {r["id"]: r["comp"] for r in got.collect()} == connected_brute(edges)


def test_first_of_each_group_stays(spark):
    rows = corpus(4, 120)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, hash_of string")
    kept = nj.first_of_groups(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in groups_of(rows).values()}


def lines_left(rows, least):
    """Drop every line of a shortest run of ``least`` words, from its start or its end, that came before."""
    seen, gone = set(), {}
    per_doc = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        wordy = [(k, x, len([w for w in BLANK.split(x) if w])) for k, x in enumerate(lines)]
        wordy = [x for x in wordy if x[2]]
        spans = set()
        for a in range(len(wordy)):
            for b in range(a, len(wordy)):
                if sum(x[2] for x in wordy[a : b + 1]) >= least:
                    spans.add((a, b))
                    break
        for b in range(len(wordy)):
            for a in range(b, -1, -1):
                if sum(x[2] for x in wordy[a : b + 1]) >= least:
                    spans.add((a, b))
                    break
        for a, b in sorted(spans):
            key = tuple(x[1] for x in wordy[a : b + 1])
            if key in seen:
                gone.setdefault(i, set()).update(x[0] for x in wordy[a : b + 1])
            seen.add(key)
        per_doc[i] = lines
    return {i: None if dict(rows)[i] is None else "\n".join(x for k, x in enumerate(lines) if k not in gone.get(i, ())) for i, lines in per_doc.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"v{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 3, 7, 12]))) for _ in range(40)]
    runs = [rng.choices(pool, k=rng.randint(2, 6)) for _ in range(8)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines += rng.choice(runs) if rng.random() < 0.5 else [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 9)))]
            lines += rng.choice([[], [], [""], ["  "]])
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs, min_words=10).collect()}
    assert got == lines_left(rows, 10)


def test_a_run_is_found_whatever_surrounds_it(spark):
    run = [f"line {k} of a passage with some words in it" for k in range(7)]
    rows = [(i, "\n".join([f"own start {i} " * (i + 1), *run, f"own end {i}"])) for i in range(5)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {0: 0, 1: 7, 2: 7, 3: 7, 4: 7}
    assert all(r["text"].split("\n")[-1] == f"own end {r['doc_id']}" for r in got)


def test_native_plan(spark):
    """No Python runs on the main path of the line dedup."""
    docs = spark.createDataFrame([(1, "a b\nc"), (2, "a b\nc")], "doc_id long, text string")
    plan = dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
