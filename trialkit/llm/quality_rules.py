"""Quality rules as weak supervision: rules vote, their accuracies are estimated, a posterior decides.

Each rule looks at simple counts of a text and votes *good* (1), *bad* (0) or abstains (NULL). A text's
quality is a hidden class. Expectation-maximisation over the counted vote patterns estimates how often
each rule is right in both classes, and a text is kept when its posterior probability of being good is at
least one half. Only built-in functions are used. The patterns number at most 3 to the power of the rules,
whatever the size of the corpus; one row of sums reaches the driver per iteration.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialkit.llm.common import fresh, let, stored, total

BLANK = "[\\x20\\x09-\\x0D]+"
WINDOW = 5
ITERATIONS = 30
#: What is believed of every rule beforehand: a bad vote on a good text is rare, and a bad text trips some
#: rules, not all. P(good vote | good), P(bad vote | bad) and the share of good texts stay in these bounds;
#: without them the classes would follow whichever rules agree most and the others would count as noise.
GOOD_BOUNDS = (0.98, 0.9999)
BAD_BOUNDS = (0.10, 0.60)
PRIOR_BOUNDS = (0.5, 0.95)
#: Weight of the starting values, as a share of the texts.
SMOOTHING = 0.002


def text_counts(text: Column) -> Column:
    """Counts of one text as a struct; NULL and empty texts have zeros throughout.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and, for the rules, ``n_lines`` (lines
    with a word), ``n_ended`` (of these, ending in ``. ! ? : " ' )`` or an ellipsis), ``n_upper`` and
    ``n_letters`` (upper-case letters; letters), ``n_marks`` (neither letter,
    digit nor blank), ``n_exclaim`` (``!`` marks).
    """
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, BLANK), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    return F.struct(
        let(
            words,
            lambda w: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                _repeated_words(w).alias("n_repeat_words"),
            ),
        ).alias("w"),
        let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("bigint").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
                F.size(F.filter(x, lambda y: y.rlike("[.!?:\"')…][\\x20\\x09-\\x0D]*$"))).alias("n_ended"),
            ),
        ).alias("l"),
        (F.length(text) - without("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        without("[^\\p{Lu}]+").alias("n_upper"),
        without("[^\\p{L}]+").alias("n_letters"),
        without("[\\p{L}\\p{M}\\p{N}\\s]+").alias("n_marks"),
        without("[^!]+").alias("n_exclaim"),
    )


def _repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that the text has twice or more, the first ones included."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(hashes: Column) -> Column:
        # Equal windows are neighbours in the sorted array. Of the sorted starts of repeated windows
        # each covers the words up to the next start, five at most.
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(
            ordered,
            lambda o: F.sort_array(
                F.transform(
                    F.filter(
                        o,
                        lambda x, k: F.coalesce(F.get(o, k + 1)["h"] == x["h"], F.lit(False))
                        | ((k > 0) & F.coalesce(F.get(o, k - 1)["h"] == x["h"], F.lit(False))),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        reach = lambda s: F.transform(s, lambda x, k: F.least(F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return let(starts, lambda s: total(reach(s)))

    some = let(
        windows,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)),
    )
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("bigint")).otherwise(some)


def _vote(good: Column, bad: Column, speaks: Column | None = None) -> Column:
    said = F.when(bad, F.lit(0)).when(good, F.lit(1))
    return said if speaks is None else F.when(speaks, said)


def rules(c: Mapping[str, Column]) -> dict[str, Column]:
    """The votes by rule, from the counts."""
    share = lambda a, b: c[a] / F.greatest(c[b], F.lit(1))
    wordy = c["n_words"] >= 10
    return {
        "length": _vote(c["n_words"] >= 40, c["n_words"] < 10),
        "symbols": _vote(share("n_symbols", "n_words") <= 0.02, share("n_symbols", "n_words") > 0.2, wordy),
        "dup_lines": _vote(share("n_dup_lines", "n_lines") <= 0.15, share("n_dup_lines", "n_lines") > 0.3, c["n_lines"] > 1),
        "repeats": _vote(share("n_repeat_words", "n_words") <= 0.15, share("n_repeat_words", "n_words") > 0.3, wordy),
        "marks": _vote(share("n_marks", "word_chars") <= 0.08, share("n_marks", "word_chars") > 0.14, wordy),
        "upper": _vote(share("n_upper", "n_letters") <= 0.1, share("n_upper", "n_letters") > 0.3, c["n_letters"] >= 20),
        "word_length": _vote(
            share("word_chars", "n_words").between(3, 8.5),
            (share("word_chars", "n_words") < 2.5) | (share("word_chars", "n_words") > 12),
            wordy,
        ),
        "line_ends": _vote(share("n_ended", "n_lines") >= 0.7, share("n_ended", "n_lines") < 0.3, c["n_lines"] > 0),
        "exclaim": _vote(share("n_exclaim", "n_words") <= 0.05, share("n_exclaim", "n_words") > 0.3, wordy),
    }


@dataclass(frozen=True)
class VoteModel:
    """Share of good texts, and by rule P(good vote | good text) and P(bad vote | bad text)."""

    prior: float
    right_good: dict[str, float]
    right_bad: dict[str, float]

    @classmethod
    def start(cls, names) -> VoteModel:
        return cls(0.85, dict.fromkeys(names, 0.997), dict.fromkeys(names, 0.3))

    def posterior(self, votes: Mapping[str, Column]) -> Column:
        """Probability that a text is good; an abstaining rule says nothing."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, vote in votes.items():
            g, b = self.right_good[name], self.right_bad[name]
            odds = odds + F.when(vote == 1, F.lit(math.log(g / (1 - b)))).when(vote == 0, F.lit(math.log((1 - g) / b))).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def _within(value: float, bounds: tuple[float, float]) -> float:
    return min(max(value, bounds[0]), bounds[1])


def fit_votes(patterns: DataFrame, names: list[str], count: str = "n", iterations: int = ITERATIONS) -> VoteModel:
    """Expectation-maximisation over counted vote patterns.

    A good vote may never speak for the bad class (the bounds see to that), so a text without a bad vote
    is never less likely good than the prior, which is at least one half. An empty table gives the start.
    """
    model = start = VoteModel.start(names)
    patterns = patterns.coalesce(1)
    n, q = F.col(count), F.col("__q")
    for _ in range(iterations):
        seen = patterns.withColumn("__q", model.posterior({k: F.col(k) for k in names}))
        sums = [F.sum(n).alias("all"), F.sum(n * q).alias("good")]
        for i, k in enumerate(names):
            v = F.col(k)
            sums += [
                F.sum(F.when(v == 1, n * q)).alias(f"gg{i}"),
                F.sum(F.when(v.isNotNull(), n * q)).alias(f"g{i}"),
                F.sum(F.when(v == 0, n * (1 - q))).alias(f"bb{i}"),
                F.sum(F.when(v.isNotNull(), n * (1 - q))).alias(f"b{i}"),
            ]
        got = {k: v or 0.0 for k, v in seen.agg(*sums).first().asDict().items()}
        if not got["all"]:
            return start
        few = SMOOTHING * got["all"]
        estimate = lambda hit, of, was, bounds: _within((hit + few * was) / (of + few), bounds)
        right_good, right_bad = {}, {}
        for i, k in enumerate(names):
            right_good[k] = estimate(got[f"gg{i}"], got[f"g{i}"], start.right_good[k], GOOD_BOUNDS)
            right_bad[k] = estimate(got[f"bb{i}"], got[f"b{i}"], start.right_bad[k], BAD_BOUNDS)
        new = VoteModel(_within(got["good"] / got["all"], PRIOR_BOUNDS), right_good, right_bad)
        moved = max(abs(new.prior - model.prior), *(abs(new.right_bad[k] - model.right_bad[k]) for k in names))
        model = new
        if moved < 1e-5:
            break
    return model


def judged(docs: DataFrame, text: str = "text", carry: bool = False) -> tuple[DataFrame, VoteModel]:
    """Counts, votes and verdict per document.

    The columns of ``docs`` (without ``text`` unless ``carry``) come first; the struct column after them
    holds ``n_words … n_repeat_words, base_failed, posterior, kept`` and the votes. NULL and empty texts have
    no words and fail; repeated rows are judged alike; an empty table gives no rows. The counts are written
    once, as the estimate and the verdict both need them.
    """
    (col,) = fresh(docs, "judged")
    keep = [c for c in docs.columns if carry or c != text]
    counted = stored(docs.select(*[F.col(f"`{c}`") for c in keep], text_counts(F.col(f"`{text}`")).alias(col)), "quality")
    c = {k: F.col(f"{col}.w.{k}") for k in ("n_words", "word_chars", "n_repeat_words")}
    c |= {k: F.col(f"{col}.l.{k}") for k in ("n_lines", "n_dup_lines", "n_ended")}
    c |= {k: F.col(f"{col}.{k}") for k in ("n_symbols", "n_upper", "n_letters", "n_marks", "n_exclaim")}
    votes = rules(c)
    patterns = counted.select(*[v.alias(k) for k, v in votes.items()]).groupBy(*votes).agg(F.count(F.lit(1)).alias("n"))
    model = fit_votes(stored(patterns.coalesce(1), "votes"), list(votes))
    failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
    posterior = model.posterior(votes)
    out = F.struct(
        *[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        posterior.alias("posterior"),
        (~failed & (posterior >= 0.5)).alias("kept"),
        F.struct(*[v.alias(k) for k, v in votes.items()]).alias("votes"),
    )
    return counted.withColumn(col, out), model


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents whose posterior quality is at least one half, with the columns of ``docs``."""
    rows, _ = judged(docs, text, carry=True)
    return rows.where(F.col(f"{rows.columns[-1]}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_report(docs: DataFrame) -> DataFrame:
    """Counts and verdict per document: the digest of the query."""
    rows, _ = judged(docs.select("doc_id", "text"))
    return rows.select("doc_id", "judged.*").drop("votes")
