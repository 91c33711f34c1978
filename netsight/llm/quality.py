"""Quality rules as weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Each rule says good (1), bad (-1) or nothing (0) about a text. From the votes alone, with no labels, the
chances of each vote of a rule given a good and a bad text are estimated; a text is kept if it is more
probably good than bad. DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsight.llm.common import BLANK_CHARS, fresh, words
from netsight.session import cut_lineage

SYMBOLS = "#*$%&|<>"
#: Characters that are no letters, and the commonest words of four languages.
MARKS = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"
COMMON = (
    "the of and to in is that with for on as at by it be are this from was "
    "der die und den das ist zu mit von sich auf ein eine im für "
    "de la le et les des que un une est en du dans pour qui "
    "el los las por con del se su y no al lo"
).split()
VOTES = (-1, 0, 1)
#: What is held of a rule beforehand: so many of ten good and of ten bad texts get each vote.
BEFORE_GOOD = {-1: 0.5, 0: 1.5, 1: 8.0}
BEFORE_BAD = {-1: 5.0, 0: 2.0, 1: 3.0}
ROUNDS = 50


def features(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """The columns `keep` and counts of the text: words, characters, symbols, repeated lines and windows.

    n_repeat_words: the windows of three words are hashed, the hash's low bits give way to the window's
    place, and sorting brings equal windows together; a word counts once, in however many it is.
    """
    t, w, m, p, s, d, l = fresh(docs.select(*keep), "_text", "_words", "_low", "_packed", "_sorted", "_places", "_lines")
    low = F.expr(f"shiftleft(1L, length(bin(size({w})))) - 1")
    high = lambda v: v.bitwiseAND(F.bitwise_not(F.col(m)))
    three = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.col(w)[i + 1], F.col(w)[i + 2])
    )
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(t))
    rows = rows.withColumn(w, words(F.col(t)))
    rows = rows.withColumn(m, low).withColumn(p, three)
    rows = rows.withColumn(p, F.transform(p, lambda h, i: high(h).bitwiseOR(i.cast("bigint"))))
    rows = rows.withColumn(s, F.sort_array(p))
    doubled = F.filter(
        s,
        lambda v, k: F.coalesce(high(v) == high(F.get(s, k + 1)), F.lit(False))
        | F.coalesce(high(v) == high(F.get(s, k - 1)), F.lit(False)),
    )
    rows = rows.withColumn(d, F.sort_array(F.transform(doubled, lambda v: v.bitwiseAND(F.col(m)))))
    covered = F.transform(d, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(d, k + 1) - at, F.lit(3))))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")
    without = lambda chars: F.length(F.translate(t, chars, ""))
    return rows.withColumn(l, lines).select(
        *keep,
        F.size(w).cast("bigint").alias("n_words"),
        without(BLANK_CHARS).cast("bigint").alias("word_chars"),
        (F.length(t) - without(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size(l) - F.size(F.array_distinct(l))).cast("bigint").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_repeat_words"),
        F.size(l).cast("bigint").alias("n_lines"),
        (F.length(t) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("bigint").alias("n_capitals"),
        (F.length(t) - without("!?")).cast("bigint").alias("n_shouts"),
        (F.length(t) - without(MARKS)).cast("bigint").alias("n_marks"),
        F.size(F.filter(w, lambda x: ~x.isin(COMMON))).cast("bigint").alias("n_uncommon"),
    )


@dataclass(frozen=True)
class Rule:
    """Bad above one share, good below another, silent between them and where nothing can be measured."""

    name: str
    part: str
    whole: str
    good_below: float
    bad_above: float

    def vote(self) -> Column:
        share = F.col(self.part) / F.nullif(F.col(self.whole), F.lit(0))
        return F.coalesce(F.when(share > self.bad_above, -1).when(share < self.good_below, 1), F.lit(0))


RULES = (
    Rule("symbols", "n_symbols", "word_chars", 0.02, 0.06),
    Rule("repeats", "n_repeat_words", "n_words", 0.10, 0.30),
    Rule("lines", "n_dup_lines", "n_lines", 0.10, 0.30),
    Rule("capitals", "n_capitals", "word_chars", 0.15, 0.40),
    Rule("shouts", "n_shouts", "n_words", 0.10, 0.40),
    Rule("marks", "n_marks", "word_chars", 0.05, 0.10),
    Rule("uncommon", "n_uncommon", "n_words", 0.90, 0.98),
    Rule("long_words", "word_chars", "n_words", 9.0, 14.0),
)


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = ROUNDS) -> tuple[float, list]:
    """Log-odds of a good text, and per rule the log-odds of each vote, from (votes, number of texts).

    Starts from the belief that a text without a bad vote is good, and less so with each bad one. What is
    held of a rule beforehand weighs as much as ten texts of either kind, so that a handful of texts, or
    none that is bad, does not turn the rules around.
    """
    belief = [0.9 if -1 not in votes else 0.9 / 2 ** (1 + votes.count(-1)) for votes, _ in patterns]
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        good = sum(b * n for b, (_, n) in zip(belief, patterns, strict=True))
        prior = math.log((good + sum(BEFORE_GOOD.values())) / (total - good + sum(BEFORE_BAD.values())))
        odds = []
        for r in range(rules):
            with_good, with_bad = dict(BEFORE_GOOD), dict(BEFORE_BAD)
            for b, (votes, n) in zip(belief, patterns, strict=True):
                with_good[votes[r]] += b * n
                with_bad[votes[r]] += (1 - b) * n
            all_good, all_bad = sum(with_good.values()), sum(with_bad.values())
            odds.append({v: math.log(with_good[v] / all_good) - math.log(with_bad[v] / all_bad) for v in VOTES})
        belief = [
            1 / (1 + math.exp(-max(-700.0, min(700.0, prior + sum(o[v] for o, v in zip(odds, votes, strict=True))))))
            for votes, _ in patterns
        ]
    return prior, odds


def judged(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES, least_words: int = 50
) -> DataFrame:
    """(key, counts of `features`, base_failed, quality, kept) of every row.

    base_failed: fewer than `least_words` words, or over half of them in repeated windows. quality is the
    posterior probability of a good text; kept if it is over one half and the base has not failed. A null
    text is empty; empty texts fail the base. Rows are judged one by one, so that repeated rows and null
    keys are no trouble; an empty table gives an empty one.

    The fit sees how many texts, among those that pass the base, cast each pattern of votes: at most
    3 to the power of the number of rules, whatever the number of rows.
    """
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = features(docs.select(F.col(key).alias(key), F.col(text).alias(text)), text, [key])
    votes = fresh(rows, *[f"_vote_{r.name}" for r in rules])
    rows = rows.withColumn("base_failed", base).withColumns({v: r.vote() for v, r in zip(votes, rules, strict=True)})
    rows = cut_lineage(rows)
    counted = rows.where(~F.col("base_failed")).groupBy(*votes).count().collect()
    patterns = [(tuple(r[v] for v in votes), r["count"]) for r in counted]
    prior, odds = expectation_maximisation(patterns, len(rules)) if patterns else (0.0, [{v: 0.0 for v in VOTES}] * len(rules))
    score = F.lit(prior)
    for v, o in zip(votes, odds, strict=True):
        score = score + F.when(F.col(v) < 0, o[-1]).when(F.col(v) > 0, o[1]).otherwise(o[0])
    quality = 1 / (1 + F.exp(-score))
    return rows.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") > 0.5)).drop(*votes)
