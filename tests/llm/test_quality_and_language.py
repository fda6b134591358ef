import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest

from trialkit.llm import quality_rules as qr
from trialkit.llm.language_id import UNDETERMINED, LanguageModel, codewords, language_report
from trialkit.llm.quality_classifier import (
    N_FEATURES,
    PASSAGE_BYTES,
    AttentionModel,
    _gradients,
    fit_attention,
    passage_features,
    quality_scores,
)
from trialkit.llm.sharding import propagate, shard_documents

BLANK = "[\x20\x09-\x0d]+"


def base_counts(text):
    text = text or ""
    words = [w for w in re.split(BLANK, text) if w]
    places = {}
    for k in range(len(words) - 4):
        places.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {p for v in places.values() if len(v) > 1 for k in v for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall("[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def texts(seed=1):
    rng = random.Random(seed)
    plain = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows = [f"{plain(30)}.\n{plain(30)}." for _ in range(200)]
    rows += [" ".join(w + "$$$" for w in plain(60).split()) for _ in range(15)]
    rows += [(plain(8) + "\n") * 9 for _ in range(15)]
    rows += [" ".join(w.upper() + "!!" for w in plain(60).split()) for _ in range(15)]
    rows += ["a b " * 3, "x y z x y z x y z x y z x y z", "", None, "\n", "#*$ é漢\U0001f600 <b>", "one two three four five six seven eight nine"]
    return list(enumerate(rows))


def test_base_counts_and_estimate(spark):
    rows = texts()
    judged, model = qr.judged(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["judged"] for r in judged.collect()}
    names = list(model.right_good)
    votes = {}
    for i, text in rows:
        want = base_counts(text)
        assert {k: got[i][k] for k in want} == want
        n, repeated = want["n_words"], want["n_repeat_words"]
        assert got[i]["base_failed"] == (n < 10 or 100 * repeated > 20 * n)
        votes[i] = [got[i]["votes"][k] for k in names]
    prior, good, bad = plain_estimate(list(votes.values()))
    assert math.isclose(prior, model.prior, rel_tol=1e-9)
    for i, v in votes.items():
        q = posterior(v, prior, good, bad)
        assert math.isclose(q, got[i]["posterior"], rel_tol=1e-6, abs_tol=1e-9)
        assert got[i]["kept"] == (not got[i]["base_failed"] and q >= 0.5)
    assert all(got[i]["kept"] for i in range(200))
    assert not any(got[i]["kept"] for i in range(200, 245))


def posterior(votes, prior, good, bad):
    yes, no = prior, 1 - prior
    for v, g, b in zip(votes, good, bad, strict=True):
        if v is not None:
            yes *= g if v else 1 - g
            no *= 1 - b if v else b
    return yes / (yes + no)


def plain_estimate(rows):
    k = len(rows[0])
    clip = lambda x, b: min(max(x, b[0]), b[1])
    prior, good, bad = 0.85, [0.997] * k, [0.3] * k
    few = qr.SMOOTHING * len(rows)
    for _ in range(qr.ITERATIONS):
        q = [posterior(v, prior, good, bad) for v in rows]
        old = prior, bad
        good = [clip((sum(p for p, v in zip(q, rows, strict=True) if v[j] == 1) + few * 0.997) / (sum(p for p, v in zip(q, rows, strict=True) if v[j] is not None) + few), qr.GOOD_BOUNDS) for j in range(k)]
        bad = [clip((sum(1 - p for p, v in zip(q, rows, strict=True) if v[j] == 0) + few * 0.3) / (sum(1 - p for p, v in zip(q, rows, strict=True) if v[j] is not None) + few), qr.BAD_BOUNDS) for j in range(k)]
        prior = clip(sum(q) / len(q), qr.PRIOR_BOUNDS)
        if max(abs(prior - old[0]), *(abs(a - b) for a, b in zip(bad, old[1], strict=True))) < 1e-5:
            break
    return prior, good, bad


def test_no_python_runs_for_the_rules(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = qr.quality_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_filter_keeps_texts_and_columns(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts()], "doc_id long, text string, judged string")
    kept = qr.quality_filter(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in kept.collect()}.items() <= dict(texts()).items()


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 7, 20):
        code = codewords(n)
        assert all(abs(int(c.sum())) < n for c in code.T)
        least = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert least >= (2 ** (n - 2) if n <= 6 else 8)


LANGS = {"aa": "bcdfg aeiou", "bb": "klmnp aoe", "cc": "rstvw öäü", "dd": "zxqjh éèç"}


def language_rows(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(LANGS))
        words = ["".join(rng.choice(LANGS[lang].replace(" ", "")) for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words), lang if rng.random() < 0.9 else None))
    return rows


def test_languages_of_held_out_texts(spark):
    rows = language_rows(3) + [(900, None, "aa"), (901, "12 34 !!", "bb"), (902, "", None)]
    got = {r["doc_id"]: r for r in language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    right = total = 0
    for i, _, lang in rows[:400]:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i]["score"] <= 1
        if got[i]["held_out"] and lang:
            right, total = right + (got[i]["lang_pred"] == lang), total + 1
    assert right >= 0.97 * total > 30
    assert all(got[i]["lang_pred"] == UNDETERMINED for i in (900, 901, 902))


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = language_rows(4, 200)
    lie = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = (sorted(language_report(spark.createDataFrame(x, "doc_id long, text string, lang string")).collect()) for x in (rows, lie))
    assert a == b


def test_loss_weighted_decoding_prefers_the_right_codeword():
    counts = np.zeros((3, 1 << 14))
    for i in range(3):
        counts[i, i * 10 : i * 10 + 10] = 1.0
    model = LanguageModel.of(["x", "y", "z"], counts)
    margins = (counts / counts.sum(axis=1, keepdims=True)) @ model.weights
    assert list(model.losses(margins).argmin(axis=1)) == [0, 1, 2]


def test_gradients_are_right():
    rng = np.random.Generator(np.random.PCG64(5))
    sizes = np.array([1, 3, 2])
    starts = np.cumsum(sizes) - sizes
    x, y = rng.normal(size=(6, 5)), np.array([1.0, 0.0, 1.0])
    w = {"encode": rng.normal(size=(5, 4)), "encode0": rng.normal(size=4), "attend": rng.normal(size=(4, 3)), "gate": rng.normal(size=(4, 3)), "focus": rng.normal(size=3), "score": rng.normal(size=4), "score0": rng.normal(size=1)}
    model = AttentionModel(weights=w)

    def loss():
        p = model.forward(x, starts, sizes)["p"]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for name, grad in _gradients(model, x, y, starts, sizes).items():
        for at in np.ndindex(w[name].shape):
            keep, step = w[name][at], 1e-6
            w[name][at] = keep + step
            up = loss()
            w[name][at] = keep - step
            slope = (up - loss()) / (2 * step)
            w[name][at] = keep
            assert math.isclose(slope, grad[at], rel_tol=1e-4, abs_tol=1e-7)


def test_passages_cover_whole_texts():
    texts_ = pa.array(["", None, "a" * PASSAGE_BYTES, "b" * (3 * PASSAGE_BYTES + 1), "Ab cd"])
    (x, bounds), *_ = passage_features(texts_)
    assert list(np.diff(bounds)) == [1, 1, 1, 4, 1]
    assert x.shape[1] == N_FEATURES and np.allclose(x[2:7, 1], 1)


def test_attention_finds_the_passage_that_matters():
    rng = np.random.Generator(np.random.PCG64(6))
    bags, labels = [], []
    for i in range(300):
        bag = rng.normal(size=(rng.integers(1, 9), 6)).astype(np.float32)
        if i % 2:
            bag[rng.integers(len(bag)), 0] = 6
        bags.append(bag)
        labels.append(float(i % 2))
    model = fit_attention(bags[:200], np.array(labels[:200]))
    sizes = [len(b) for b in bags[200:]]
    scores = model.scores(np.concatenate(bags[200:]), np.concatenate([[0], np.cumsum(sizes)]))
    assert ((scores > 0.5) == np.array(labels[200:])).mean() > 0.9


def test_quality_of_held_out_texts(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(10, 300))]
        good = rng.random() < 0.8
        rows.append((i, " ".join(words if good else [w + rng.choice(["%%", "##"]) for w in words])))
        labels.append((i, int(good)))
    got = quality_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    held = [r for r in got.collect() if r["held_out"]]
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in held)
    assert sum(r["predicted"] == dict(labels)[r["doc_id"]] for r in held) > 0.95 * len(held) > 50


def check_shards(rows, got, shards=8):
    assert len(got) == len(rows)
    sizes = [sum(r["shard"] == s for r in got) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == want


def test_shards_are_even_and_groups_stay_together(spark):
    rng = random.Random(2)
    rows = [(i, f"text {i}") for i in range(300)]
    rows += [(1000 + i, f"copy {rng.randrange(30)}") for i in range(120)]
    rows += [(None, None), (None, "copy 1"), (5, "text 5"), (6, None)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    check_shards(rows, got)
    homes = {}
    for r in got:
        homes.setdefault(r["text_crc32"], set()).add(r["shard"])
    texts_ = {t for _, t in rows if t}
    assert all(len(homes[zlib.crc32(t.encode())]) == 1 for t in texts_)


def test_a_group_larger_than_a_shard_is_split_evenly(spark):
    rows = [(i, "the same") for i in range(100)] + [(200 + i, f"other {i}") for i in range(100)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(rows, got)
    same = {r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"the same")}
    assert len(same) <= 6


def test_moves_respect_the_quota(spark):
    cells = spark.createDataFrame([(1, 1, 5, 0, 6), (1, 1, 5, 1, 4), (2, 2, 5, 1, 3), (2, 2, 5, 0, 1)], "g_low long, g_high long, size long, shard int, n long")
    out = propagate(cells, [10, 10], [3, 3], 5).collect()
    held = {s: sum(r["n"] for r in out if r["shard"] == s) for s in (0, 1)}
    assert all(n <= 10 for n in held.values()) and sum(held.values()) == 14


def plain_grams(text):
    """Hashed n-grams of a text, letter by letter."""
    letters = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode()]
    out = []
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            if letters[i + (n - 1) // 2] != 32:
                gram = sum(x * 256 ** (n - 1 - k) for k, x in enumerate(letters[i : i + n]))
                out.append((((gram + n * 0x1000193) * 0x9E3779B97F4A7C1) & 0x7FFFFFFFFFFFFFFF) >> 49)
    return out


def plain_languages(rows):
    """Codeword decoding written out in plain Python: name and score per text."""
    shares = {}
    for doc, text, lang in rows:
        if zlib.crc32(str(doc).encode()) % 4 != 2 and lang is not None:
            grams = plain_grams(text or "")
            for g in grams:
                own = shares.setdefault(lang, {})
                own[g] = own.get(g, 0.0) + 1 / len(grams)
            shares.setdefault(lang, {})
    names = sorted(shares)
    total = sum(sum(v.values()) for v in shares.values())
    for v in shares.values():
        whole = max(sum(v.values()), 1)
        for g in v:
            v[g] /= whole
    code = codewords(len(names)).tolist()
    small = 0.5 / max(total / len(names), 1.0)
    cache = {}

    def weight(g, bit):
        if (g, bit) not in cache:
            sides = {1: [], -1: []}
            for name, word in zip(names, code, strict=True):
                sides[word[bit]].append(shares[name].get(g, 0.0))
            inside, outside = (sum(x) / max(len(x), 1) + small for x in (sides[1], sides[-1]))
            cache[g, bit] = math.log(inside / outside)
        return cache[g, bit]

    bits = range(len(code[0]))
    worth = [
        [max(code[k][b] * sum(x * weight(g, b) for g, x in shares[name].items()), 1e-6) for b in bits]
        for k, name in enumerate(names)
    ]
    scale = [sum(w[b] for w in worth) / len(names) for b in bits]
    out = {}
    for doc, text, _ in rows:
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            out[doc] = ("und", 0.0)
            continue
        grams = plain_grams(text)
        margin = [sum(weight(g, b) for g in grams) / len(grams) for b in bits]
        losses = [
            sum(math.exp(-min(max(margin[b] / scale[b], -3), 3) * code[k][b]) * worth[k][b] / sum(worth[k]) for b in bits)
            for k in range(len(names))
        ]
        odds = [math.exp(-4.0 * (x - min(losses))) for x in losses]
        best = max(range(len(names)), key=lambda k: odds[k])
        out[doc] = (names[best], odds[best] / sum(odds))
    return out


def test_languages_equal_plain_python(spark):
    rows = [*language_rows(8, 120), (900, None, "aa"), (901, "12 34 !!", "bb"), (902, "", None), (903, "² ½", "aa")]
    rows += [(904, "\u2167 \u2460", "bb"), (905, "\u01c5", "bb"), (906, "\u4e2d", None), (907, "Éa B", "aa")]
    want = plain_languages(rows)
    got = language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    for r in got:
        name, score = want[r["doc_id"]]
        assert r["lang_pred"] == name, r
        assert r["score"] == pytest.approx(score, abs=1e-4)
    assert {r["doc_id"] for r in got if r["lang_pred"] == UNDETERMINED} == {900, 901, 902, 903, 904}


def test_a_column_of_the_name_of_the_result_stays(spark):
    from trialkit.llm.language_id import predict_languages

    docs = spark.createDataFrame([(1, "text", "mine")], "doc_id long, text string, lang_found string")
    out = predict_languages(docs, None)
    assert out.columns == ["doc_id", "text", "lang_found", "lang_found_"]
    assert out.first()["lang_found"] == "mine" and out.first()["lang_found_"]["lang_pred"] == UNDETERMINED
