"""Language identification by error-correcting output codes over byte n-grams.

Every learned language has a codeword. For each bit a binary n-gram classifier tells the languages whose
codewords have a 1 there from those with a 0: a naive Bayes log-ratio per hashed n-gram, from counts over
all training documents. A text's margins, one per bit, are decoded to the codeword with the least loss; bits
weigh, for each language, as much as their classifier's margin is worth on that language. Texts whose two
best languages are close are flagged.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.llm.common import fresh, text_chunks

#: Hashed n-grams of one, two and three bytes.
FEATURE_BITS = 14
FEATURES = 1 << FEATURE_BITS
NGRAMS = (1, 2, 3)
SMOOTHING = 0.5
#: Up to so many languages every useful split is a bit; beyond, ``BITS_PER_LANGUAGE`` times log2 random ones.
EXHAUSTIVE = 6
BITS_PER_LANGUAGE = 10
SHARPNESS = 4.0
#: Share of the score that the best language must be ahead by; otherwise the text is ambiguous.
CLEAR = 0.2
UNDETERMINED = "und"


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """One row of -1 and 1 per language; rows differ in as many places as can be had, no column is constant."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= EXHAUSTIVE:
        others = range(1, n)
        splits = [set(c) for k in range(n - 1) for c in combinations(others, k)]
        return np.array([[1 if i == 0 or i in s else -1 for s in splits] for i in range(n)], np.int8)
    bits = math.ceil(BITS_PER_LANGUAGE * math.log2(n))
    rng = np.random.Generator(np.random.PCG64(seed))
    best, far = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        flat = np.abs(code.sum(axis=0, dtype=int)) == n
        code[:, flat] = np.where(np.arange(n) % 2, 1, -1).astype(np.int8)[:, None]
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > far:
            best, far = code, apart
    return best


def ngram_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams of the letters of some texts, and where each text's begin and end.

    Letters are bytes of ASCII letters and of anything beyond ASCII; everything else is a blank, and runs of
    blanks give only n-grams that hold a letter.
    """
    for _, data, offsets in text_chunks(texts):
        letters = _LETTERS[data]
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        found, own = [], []
        gram = np.zeros(len(letters), np.int64)
        for n in range(1, max(NGRAMS) + 1):
            k = len(letters) - n + 1
            if k <= 0:
                break
            gram = gram[:k] * 256 + letters[n - 1 :]
            whole = owner[:k] == owner[n - 1 :]
            middle = letters[(n - 1) // 2 : (n - 1) // 2 + k] != 32
            use = whole & middle
            hashed = ((gram[use] + n * 0x1000193) * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF) >> (63 - FEATURE_BITS)
            found.append(hashed)
            own.append(owner[:k][use])
        if found:
            features, own = np.concatenate(found), np.concatenate(own)
            order = np.argsort(own, kind="stable")
            yield features[order], np.searchsorted(own[order], np.arange(len(offsets)))
        else:
            yield np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)


_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def _lowered(texts: pa.Array) -> pa.Array:
    return pa.compute.utf8_lower(texts)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, their codewords, and by hashed n-gram one weight per bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # n-grams x bits
    worth: np.ndarray  # languages x bits: mean margin on texts of the language, in its favour

    @classmethod
    def of(cls, languages: list[str], counts: np.ndarray) -> LanguageModel:
        """From n-gram counts by language (languages x n-grams). Languages weigh alike, whatever their size."""
        code = codewords(len(languages))
        shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        small = SMOOTHING / max(float(counts.sum()) / max(len(languages), 1), 1.0)
        one = (code == 1).astype(float)
        inside = (one.T @ shares) / np.maximum(one.sum(axis=0)[:, None], 1) + small
        outside = ((1 - one).T @ shares) / np.maximum((1 - one).sum(axis=0)[:, None], 1) + small
        weights = np.log(inside / outside).T
        margins = shares @ weights
        worth = np.maximum(margins * code, 1e-6)
        return cls(languages, code, weights.astype(np.float32), worth)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss of every language for each text's mean margins: exponential, weighted by the bits' worth."""
        scale = self.worth.mean(axis=0)
        shares = self.worth / self.worth.sum(axis=1, keepdims=True)
        agree = np.clip(margins / scale, -3, 3)
        out = np.zeros((len(margins), len(self.code)))
        # bit by bit: memory follows texts and languages, not their product with the bits
        for bit in range(self.code.shape[1]):
            out += np.exp(-agree[:, bit, None] * self.code[:, bit]) * shares[:, bit]
        return out


def learn_languages(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """Count n-grams by language over all rows with a language; NULL if there are none.

    Counts combine within each task, so a task gives one row per language. The driver gets languages x
    n-grams numbers, whatever the number of documents.
    """
    chosen = labelled.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            first = 0
            for features, bounds in ngram_features(_lowered(batch.column(1))):
                for i in range(len(bounds) - 1):
                    some = features[bounds[i] : bounds[i + 1]]
                    mine = total.setdefault(langs[first + i], np.zeros(FEATURES))
                    # every text counts the same, a long one must not outweigh the others
                    if len(some):
                        mine += np.bincount(some, minlength=FEATURES) / len(some)
                first += len(bounds) - 1
        if total:
            names = sorted(total)
            sums = pa.array([total[k] for k in names], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(names), sums], ["lang", "counts"])

    parts = chosen.mapInArrow(count, "lang string, counts array<double>")
    cells = parts.select("lang", F.posexplode("counts").alias("gram", "n")).where("n > 0")
    sums = cells.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = sums.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("gram", "n"))).alias("n")).collect()
    rows = sorted(rows, key=lambda r: r["lang"])
    if not rows:
        return None
    counts = np.zeros((len(rows), FEATURES))
    for i, row in enumerate(rows):
        counts[i, list(row["n"])] = list(row["n"].values())
    return LanguageModel.of([r["lang"] for r in rows], counts)


#: Letters are among these; superscripts, fractions and number letters are as well, and are told apart after.
_NEARLY_LETTER = re.compile("[^\\W\\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter (Unicode category L)."""
    return any(m[0].isalpha() for m in _NEARLY_LETTER.finditer(text))


def predict_languages(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``ambiguous`` to each row, in a struct ``lang_found``.

    ``und`` with score 0 where the text is NULL, empty or has no letter, and where no language was learned. Of equally
    near languages the first by name is taken. Repeated rows are judged alike, each for itself. The struct has another
    name (one more ``_``) where ``docs`` has such a column; it always comes last.
    """

    found = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(found)
    def predict(texts):
        import pandas as pd

        own: LanguageModel | None = sent.value
        n = len(texts)
        names = np.full(n, UNDETERMINED, object)
        scores, close = np.zeros(n), np.zeros(n, bool)
        if own is not None and n:
            filled = texts.fillna("")
            margins = np.zeros((n, own.code.shape[1]))
            first = 0
            for features, bounds in ngram_features(_lowered(pa.array(filled, pa.string()))):
                for i in range(len(bounds) - 1):
                    some = features[bounds[i] : bounds[i + 1]]
                    if len(some):
                        share = np.bincount(some, minlength=FEATURES).astype(np.float32) / len(some)
                        margins[first + i] = share @ own.weights
                first += len(bounds) - 1
            losses = own.losses(margins)
            odds = np.exp(-SHARPNESS * (losses - losses.min(axis=1, keepdims=True)))
            odds /= odds.sum(axis=1, keepdims=True)
            best = odds.argmax(axis=1)
            ordered = np.sort(odds, axis=1)
            told = np.array([has_letter(t) for t in filled], bool)
            names[told] = np.array(own.languages, object)[best[told]]
            scores[told] = odds.max(axis=1)[told]
            if odds.shape[1] > 1:
                close = told & (ordered[:, -1] - ordered[:, -2] < CLEAR)
        return pd.DataFrame({"lang_pred": names, "score": scores, "ambiguous": close})

    (name,) = fresh(docs, "lang_found")
    return docs.withColumn(name, predict(F.col(f"`{text}`")))


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: the crc32 of the id, as text, leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous``: the digest of the query."""
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = learn_languages(rows.where("not held_out"))
    return predict_languages(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_found.*")
