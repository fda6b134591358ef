"""Ranked search against plain Python, block by block and as a whole."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trialkit.llm import lexical_search
from trialkit.llm.common import text_chunks
from trialkit.llm.lexical_search import Best, Block, Queries, Sieve, build_block, search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, top):
    bags = [(doc, Counter(terms(text))) for doc, text in docs]
    bags = [(doc, bag, sum(bag.values())) for doc, bag in bags if bag]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        asked = set(terms(text))
        scores = []
        for doc, bag, n in bags:
            m = 10 + (90 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t in asked & set(bag)
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, k, None if null else doc, -s) for k, (s, null, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2])))


def corpus(seed, n=400):
    rng = random.Random(seed)
    names = [f"w{k}" for k in range(300)] + ["Ärger", "é1"]
    spread = [1 / (k + 1) for k in range(len(names))]
    docs = [(k, " ".join(rng.choices(names, spread, k=rng.randrange(1, 80)))) for k in range(n)]
    docs += [(n + 1, docs[3][1]), (n + 2, docs[3][1]), (None, docs[5][1].upper()), (n + 3, None), (n + 4, " . ")]
    items = [(k, " ".join(rng.choices(names, k=rng.randrange(1, 25)))) for k in range(30)]
    items += [(100, docs[7][1]), (100, "w1 w1 w2"), (None, "w4 unheard"), (101, ""), (102, None), (103, "unheard of")]
    return docs, items


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2])))


@pytest.mark.parametrize("top", [1, 10])
def test_against_plain_python(spark, monkeypatch, top):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 50)
    docs, items = corpus(top)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found(search(df, asked, top=top)) == plain(docs, items, top)
    assert found(search(df, asked, top=top, batch_bytes=200)) == plain(docs, items, top)


def test_empty_tables(spark):
    docs, items = corpus(1, 10)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert search(df, asked.limit(0)).collect() == []
    assert search(df.limit(0), asked).collect() == []
    assert search(df.limit(0), asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_pair_bounds_hold_and_skip_more():
    """No document of a group exceeds its bound, and pairs read fewer postings than single terms for the same result."""
    docs, items = corpus(9, 3000)
    docs = [d for d in docs if d[0] is not None]
    queries = Queries.of(items)
    sieve = Sieve(queries.vocabulary)
    parts = list(text_chunks(pa.array([t for _, t in docs], pa.string())))
    sizes, spot, term, tf = sieve.postings(*parts[0][1:])
    queries.weigh(int(np.count_nonzero(sizes)), np.bincount(term, minlength=len(queries.vocabulary)))
    rows, step = [], 200
    for low in range(0, len(docs), step):
        here = (spot >= low) & (spot < low + step)
        ids = pa.array([d for d, _ in docs[low : low + step]])
        row = build_block(ids, sizes[low : low + step], spot[here] - low, term[here], tf[here], queries, len(docs), int(sizes.sum()))
        row["docs"] = ids.to_numpy()
        rows.append({k: np.asarray(v, np.int64) for k, v in row.items()})
    read, results = {}, {}
    for use_pairs in (True, False):
        best = [Best(10) for _ in items]
        read[use_pairs] = 0
        for row in rows:
            block = Block(row, queries)
            for k, b in enumerate(best):
                block.search(k, b, use_pairs)
                for bound, alone, pair, its in block.split(k, b.beaten, use_pairs)[0]:
                    sums = np.zeros(len(block.keys), np.int64)
                    for t in its:
                        sums[block.spots[block.low[t] : block.high[t]]] += block.impacts[block.low[t] : block.high[t]]
                    assert sums.max() <= bound
                    if pair >= 0:
                        sums[block.pair_spots[block.pair_low[pair] : block.pair_high[pair]]] = 0
                        assert sums.max() <= alone
            read[use_pairs] += block.read
        results[use_pairs] = [(b.scores.tolist(), b.keys.tolist()) for b in best]
    everything = sum(len(row["spots"][np.isin(np.repeat(row["terms"], row["counts"]), t)]) for row in rows for t in queries.terms)
    assert results[True] == results[False]
    assert read[True] < read[False] < everything
