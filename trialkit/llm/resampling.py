"""Target-distribution importance resampling: draw the documents that look most like a target.

Word runs of the corpus and of the target fall into hashed buckets. One pass counts the buckets of both; a
second pass scores every document by an array of gains, one per bucket, and writes the scores. The draw is by
Gumbel noise keyed by the document, so it is the top share of noisy weights: its cutoff is found by bisection
over the numbers, each step an exact count over the stored scores, and ties at the cutoff are settled by the
same bisection over ``doc_id``. No rows are sorted for it. Only the drawn rows are range-partitioned, for ranks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.llm.common import fresh, numbered, stored, text_chunks
from trialkit.llm.hashing import ALNUM, FOLD, _edges

#: Longest run of words that is a feature, and number of hash buckets.
RUN = 1
BUCKETS = 10_000
#: Key of the noise, share of documents drawn in percent, and words a document needs to be drawn.
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: Thresholds counted in one job: each job does four steps of a bisection.
CUTS = 15
#: Features longer than this are hashed one by one.
LONG = 64

_LAST = (1 << 63) - 1


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of the bytes of many spans, position by position over all of them."""
    size = ends - starts
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    # the longest first: those that still have a byte are always at the front
    order = np.argsort(np.minimum(size, LONG + 1).astype(np.uint8), kind="stable")[::-1]
    long = int(np.count_nonzero(size > LONG))
    order, single = order[long:], order[:long]
    left = size[order]
    at, part = starts[order], state[order]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))
        part[:n] = _CRC[(part[:n] ^ data[at[:n] + k]) & 0xFF] ^ (part[:n] >> 8)
    state[order] = part ^ np.uint32(0xFFFFFFFF)
    for i in single:
        state[i] = zlib.crc32(data[starts[i] : ends[i]])
    return state


def features(data: np.ndarray, offsets: np.ndarray, run: int, buckets: int):
    """Words per text, and per run length the bucket of every feature and the text it is in."""
    starts, ends = _edges(data, offsets, ALNUM)
    bounds = np.searchsorted(starts, offsets)
    words = np.diff(bounds)
    size = ends - starts
    # the words again, folded and with one space behind each
    first = np.cumsum(size + 1) - (size + 1)
    plain = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    if len(size):
        source = np.arange(len(plain)) + np.repeat(starts - first, size + 1)
        inside = np.ones(len(plain), bool)
        inside[first + size] = False
        plain[inside] = FOLD[data[source[inside]]]
    last = np.repeat(bounds[1:], words)
    text = np.repeat(np.arange(len(words)), words)
    parts = []
    for k in range(1, run + 1):
        here = np.flatnonzero(np.arange(len(size)) + k <= last)
        crc = crc32_spans(plain, first[here], first[here + k - 1] + size[here + k - 1])
        parts.append(((crc % np.uint32(buckets)).astype(np.int64), text[here]))
    return words, parts


def bucket_counts(texts: DataFrame, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """How many features of all texts fall into each bucket: ``bucket``, ``n``; buckets without any are absent.

    Tasks add up their own texts, so at most one row per bucket and task is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0)):
                for bucket, _ in features(data, offsets, run, buckets)[1]:
                    sums += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["bucket", "n"])

    counts = texts.select(F.col(f"`{text}`")).mapInArrow(count, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of each bucket in thousandths of the log of its smoothed share in the target over the corpus."""
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for row in both.collect():  # at most one row per bucket
        s[row["bucket"]], t[row["bucket"]] = row["s"] or 0, row["t"] or 0
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array(
        [
            math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t)))
            for a, b in zip(s.tolist(), t.tolist(), strict=True)
        ],
        np.int64,
    )


def scored(docs: DataFrame, gain: np.ndarray, names: Sequence[str], text: str, run: int) -> DataFrame:
    """Add words, features and the sum of gains to each document, under ``names``; the text goes."""
    kept = [f for f in docs.schema if f.name != text]
    schema = T.StructType([*kept, *[T.StructField(n, T.LongType(), False) for n in names]])
    table = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = table.value
        for batch in batches:
            found = [np.zeros(batch.num_rows, np.int64) for _ in names]
            for first, data, offsets in text_chunks(batch.column(batch.schema.get_field_index(text))):
                words, parts = features(data, offsets, run, len(value))
                rows = slice(first, first + len(words))
                found[0][rows] = words
                for bucket, of in parts:
                    found[1][rows] += np.bincount(of, minlength=len(words))
                    sums = np.concatenate([[0], np.cumsum(value[bucket])])
                    at = np.searchsorted(of, np.arange(len(words) + 1))
                    found[2][rows] += sums[at[1:]] - sums[at[:-1]]
            same = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*same, *map(pa.array, found)], [*[f.name for f in kept], *names])

    return docs.mapInArrow(score, schema)


def _smallest(rows: DataFrame, key: Column, need: int) -> tuple[int, int, int]:
    """The smallest value ``v`` of an integer ``key`` with at least ``need`` rows up to it.

    Gives ``v``, the rows below it and the rows at it. Every job counts the rows exactly.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while low < high:
        cuts = sorted({low + (high - low) * i // (CUTS + 1) for i in range(1, CUTS + 1)})
        counts = rows.agg(*[F.count(F.when(key <= F.lit(c), 1)) for c in cuts]).first()
        reached = [c for c, n in zip(cuts, counts, strict=True) if n >= need]
        missed = [c for c, n in zip(cuts, counts, strict=True) if n < need]
        low, high = max([low, *[c + 1 for c in missed]]), min([high, *reached])
    below, at = rows.agg(F.count(F.when(key < F.lit(low), 1)), F.count(F.when(key == F.lit(low), 1))).first()
    return low, below, at


def first_rows(rows: DataFrame, keys: Sequence[Column], need: int) -> Column:
    """Condition that holds for the ``need`` first of ``rows`` in the order of integer ``keys``, none NULL.

    The keys together should tell rows apart; ``rows`` should be a stored table, as it is counted often.
    """
    total = rows.count()
    if need >= total:
        return F.lit(True)
    chosen, tied = F.lit(False), F.lit(True)
    for key in keys:
        if need <= 0:
            break
        value, below, at = _smallest(rows.where(tied), key, need)
        chosen = chosen | (tied & (key < F.lit(value)))
        tied = tied & (key == F.lit(value))
        need -= below
        if need >= at:
            return chosen | tied
    return chosen


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    run: int = RUN,
    buckets: int = BUCKETS,
    seed: int = SEED,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Every row of ``docs`` with ``n_features``, ``weight``, ``score`` and, if drawn, ``rank`` from 1.

    The text itself is left out; join it back by ``doc_id``, or filter on ``rank``. The draw takes ``percent``
    of the documents with at least ``least_words`` words (rounded down), the highest scores first, equal ones by
    ascending ``doc_id``, an integer. NULL and empty texts have no feature and weight 0. A NULL ``doc_id``
    comes after all others and has the noise of an empty name. Repeated rows are drawn each for itself, in an
    order of their own where score and ``doc_id`` are equal. An empty target makes every gain follow the corpus
    alone; an empty table gives no rows. Columns of ``docs`` under one of the four names give way to the new ones.
    """
    added = ("n_features", "weight", "score", "rank")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    gain = gains(bucket_counts(docs, text, run, buckets), bucket_counts(target, target_text, run, buckets), buckets)
    words, key, place = fresh(docs, "n_words", "key", "place_")
    rows = scored(docs, gain, [words, "n_features", "weight"], text, run)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = rows.withColumns(
        {
            "score": F.col("weight") + noise,
            key: F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(_LAST)),
            place: F.monotonically_increasing_id(),
        }
    )
    rows = stored(rows, "scores")
    able = rows.where(F.col(words) >= least_words)
    wanted = able.count() * percent // 100
    order = [-F.col("score"), F.col(key), F.col(place)]
    drawn = (F.col(words) >= least_words) & (first_rows(able, order, wanted) if wanted else F.lit(False))
    (negative,) = fresh(rows, "negative")
    ranked = numbered(rows.where(drawn).withColumn(negative, -F.col("score")), [negative, key, place], "rank", "drawn")
    ranked = ranked.withColumn("rank", F.col("rank") + 1).drop(negative)
    rest = rows.where(~drawn).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).drop(words, key, place)


def resampling_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The digest of the query."""
    out = resample(docs.select("doc_id", "text"), target)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


RESAMPLING_SQL = r"""
WITH bits AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(b AS BIGINT))) AS crc
), docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), target AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), spread AS (SELECT doc_id, unnest(w) AS word FROM docs
), vocabulary AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM spread UNION SELECT word FROM target)
), buckets AS (
  SELECT word, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c // 256, crc[CAST(xor(c, b) & 255 AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM vocabulary, bits
), s AS (SELECT bucket, count(*) AS s FROM spread JOIN buckets USING (word) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM target JOIN buckets USING (word) GROUP BY bucket
), sums AS (
  SELECT (SELECT coalesce(sum(s), 0) FROM s) + 10000 AS all_s, (SELECT coalesce(sum(t), 0) FROM t) + 10000 AS all_t
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * CAST(all_s AS DOUBLE)
    / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * CAST(all_t AS DOUBLE)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket), sums
), weights AS (
  SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
  FROM spread JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), noisy AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + CAST(floor(-1000.0 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5)
    / 4294967296.0))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (doc_id)
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM noisy WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM noisy LEFT JOIN drawn USING (doc_id)
"""
