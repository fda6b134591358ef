"""Winnowing over line hashes: find runs of lines that came before, and delete the later ones.

Lines with a word have a hash. A window is a shortest run of consecutive lines with at least ``MIN_WORDS``
words, taken forwards from each line and backwards from each line. Its smallest line hash is its
fingerprint: documents that share a run of that many words share a window inside it and so a fingerprint,
whatever surrounds the run. Positions are joined on the fingerprint; where it comes more than once, the
match is extended both ways to the windows around it, and every line of a window that has an equal one
earlier (by document, then position) goes. Each line of a repeated run lies in such a window, so runs are
deleted whole, also where they are longer than a window. Only built-in functions are used; counts of equal
windows combine before they are shuffled, and no pairs are made within a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialkit.llm.common import fresh, let, stored

MIN_WORDS = 25
#: Windows have fewer lines than this; ``min_words`` may not be larger.
WIDE_BITS = 20
WIDE = 1 << WIDE_BITS
WORD = "[^\\x20\\x09-\\x0D]+"


def line_windows(text: Column, min_words: int = MIN_WORDS) -> Column:
    """The windows of a text: ``first`` line, ``n`` lines, ``print`` (smallest hash) and ``key`` (all hashes).

    Lines without a word are left out of the count. NULL gives an empty array.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    counted = F.filter(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w"))), lambda x: x["w"] > 0)

    def reach(words: Column, at: Column) -> Column:
        """Lines from ``at`` (1-based) that hold ``min_words`` words, NULL if there are too few."""
        got = F.aggregate(
            F.slice(words, at, min_words),
            F.struct(F.lit(0).alias("words"), F.lit(0).alias("n")),
            lambda acc, w: F.when(acc["words"] >= min_words, acc).otherwise(
                F.struct((acc["words"] + w).alias("words"), (acc["n"] + 1).alias("n"))
            ),
            lambda acc: F.when(acc["words"] >= min_words, acc["n"]),
        )
        return got

    def windows(hashes: Column, words: Column) -> Column:
        size = F.size(words)
        numbers = F.sequence(F.lit(1), size)
        # a window is one number, first * WIDE + n, as distinct numbers are found by hashing, structs are not
        pack = lambda first, n: first.cast("bigint") * WIDE + n
        ahead = F.transform(numbers, lambda i: pack(i - 1, reach(words, i)))
        back = let(
            F.reverse(words),
            lambda r: F.transform(numbers, lambda i: let(reach(r, i), lambda n: pack(size - (i - 1) - n, n))),
        )
        both = F.array_distinct(F.filter(F.concat(ahead, back), lambda x: x.isNotNull()))

        def filled(x: Column) -> Column:
            first, n = F.shiftright(x, WIDE_BITS).cast("int"), x.bitwiseAND(F.lit(WIDE - 1)).cast("int")
            run = F.slice(hashes, first + 1, n)
            return F.struct(first.alias("first"), n.alias("n"), F.array_min(run).alias("print"), F.xxhash64(run).alias("key"))

        return F.transform(both, filled)

    def of(lines: Column) -> Column:
        found = let(lines["w"], lambda w: windows(lines["h"], w))
        return F.when(F.size(lines) > 0, found)

    kind = "array<struct<first:int,n:int,print:bigint,key:bigint>>"
    return F.coalesce(let(counted, of), F.array().cast(kind)).cast(kind)


def dedup_lines(docs: DataFrame, text: str = "text", order: str = "doc_id", min_words: int = MIN_WORDS, counts: bool = False) -> DataFrame:
    """The documents without later repeated runs of lines, with the columns of ``docs``.

    Earlier is: smaller ``order`` value (NULL last), then the row as read, then the line. A document whose
    lines all go has an empty text. NULL and empty texts stay as they are, as do lines without words. Of
    repeated rows the first keeps its lines. With ``counts`` the columns ``n_lines`` (with a word) and
    ``n_removed`` follow.
    """
    if not 0 < min_words < WIDE:
        raise ValueError(f"min_words must be from 1 to {WIDE - 1}")
    row, found, gone = fresh(docs, "row", "windows", "gone")
    names = [F.col(f"`{c}`") for c in docs.columns]
    base = docs.select(*names, F.monotonically_increasing_id().alias(row), line_windows(F.col(f"`{text}`"), min_words).alias(found))
    base = stored(base, "lines")

    # positions join on the fingerprint: one count per distinct smallest hash and line
    spots = F.array_distinct(F.transform(found, lambda x: x["print"]))
    repeats = F.size(F.array_distinct(F.transform(found, lambda x: x["key"]))) < F.size(found)
    prints = base.select(F.explode(spots).alias("print"), F.when(repeats, F.lit(2)).otherwise(F.lit(1)).alias("times"))
    common = prints.groupBy("print").agg(F.sum("times").alias("times")).where("times > 1").select("print")

    windows = base.select(F.col(f"`{order}`").alias("at"), F.col(row).alias("row"), F.explode(found).alias("x")).select("at", "row", "x.*")
    candidates = windows.join(common, "print", "left_semi")
    spot = F.struct(F.col("at").isNull().alias("last"), "at", "row", "first")
    earliest = candidates.groupBy("key", "n").agg(F.min(spot).alias("spot"), F.count(F.lit(1)).alias("times"))
    earliest = earliest.where("times > 1").select(F.col("key").alias("k"), F.col("n").alias("m"), "spot")
    later = candidates.join(earliest, (F.col("key") == F.col("k")) & (F.col("n") == F.col("m")))
    later = later.where((F.col("row") != F.col("spot.row")) | (F.col("first") != F.col("spot.first")))
    ranges = later.groupBy(F.col("row").alias(f"{row}_of")).agg(F.collect_set(F.struct("first", "n")).alias(gone))

    joined = base.drop(found).join(ranges, F.col(row) == F.col(f"{row}_of"), "left")
    body = F.col(f"`{text}`")
    lines = F.split(body, "\n")

    def without(x: Column) -> Column:
        """Lines by number: those with words, less the deleted ones, in order."""
        wordy = F.filter(F.transform(x, lambda y, i: F.when(y.rlike(WORD), i)), lambda i: i.isNotNull())
        covered = F.array_distinct(F.flatten(F.transform(gone, lambda r: F.sequence(r["first"], r["first"] + r["n"] - 1))))
        out = let(wordy, lambda w: F.transform(covered, lambda p: w[p]))
        rest = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), out)
        return F.array_join(F.transform(rest, lambda i: x[i]), "\n")

    cleaned = F.when(F.col(gone).isNull(), body).otherwise(let(lines, without))
    done = [cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        n_lines = F.size(F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda y: y.rlike(WORD))).cast("bigint")
        covered = F.size(F.array_distinct(F.flatten(F.transform(gone, lambda r: F.sequence(r["first"], r["first"] + r["n"] - 1)))))
        done += [n_lines.alias("n_lines"), F.coalesce(F.when(F.col(gone).isNotNull(), covered), F.lit(0)).cast("bigint").alias("n_removed")]
    return joined.select(*done)


LINE_DEDUP_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord
  FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, ord, line, w, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i,
    sum(w) OVER (PARTITION BY doc_id ORDER BY ord) AS upto
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM split) WHERE w > 0
), windows AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM lines a JOIN lines b
    ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 24 AND b.upto - a.upto + a.w >= 25 GROUP BY a.doc_id, a.i
  UNION
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM lines b JOIN lines a
    ON a.doc_id = b.doc_id AND a.i BETWEEN b.i - 24 AND b.i AND b.upto - a.upto + a.w >= 25 GROUP BY b.doc_id, b.i
), keyed AS (
  SELECT w.doc_id, s, e, string_agg(line, chr(10) ORDER BY i) AS key
  FROM windows w JOIN lines l ON w.doc_id = l.doc_id AND l.i BETWEEN s AND e GROUP BY w.doc_id, s, e
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, s) AS k FROM keyed) WHERE k > 1
), gone AS (
  SELECT DISTINCT l.doc_id, l.ord FROM later w JOIN lines l ON w.doc_id = l.doc_id AND l.i BETWEEN s AND e
), kept AS (
  SELECT s.doc_id, string_agg(line, chr(10) ORDER BY s.ord) AS text FROM split s
  LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.ord = g.ord WHERE g.ord IS NULL GROUP BY s.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce((SELECT count(*) FROM lines l WHERE l.doc_id = d.doc_id), 0) AS n_lines,
  coalesce((SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id), 0) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
