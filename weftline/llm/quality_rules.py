"""Quality rules by weak supervision.

Rules vote good (1), bad (-1) or abstain (0) on each document. Expectation-maximisation
on the counts of all vote patterns estimates how far each rule can be trusted and how
common good documents are (held between 0.05 and 0.99, so that a rule always has both
kinds to be judged by); the posterior probability of "good" is the verdict. Only the
pattern counts reach the driver: at most 3 to the number of rules, whatever the input.

Null texts count as empty. Empty texts have no words and fail the base rules. Very long
texts are counted whole. Repeated rows and null ids are scored as any row; an empty table
gives an empty result. Extra columns, whatever their names, pass through :func:`passed`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .textstats import COUNTS, boxed, unboxed, with_stats


def _share(top: str, bottom: str) -> Column:
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule's vote, on the columns of ``textstats``. Two rules at least look at any one fault, else their errors can't be told apart."""
    mean_length = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    letters = F.col("n_upper") + F.col("n_lower") + F.col("n_other")
    return {
        "letters": _vote(letters < 0.75 * F.col("word_chars"), letters > 0.85 * F.col("word_chars")),
        "symbols": _vote(_share("n_symbols", "n_words") > 0.3, _share("n_symbols", "n_words") < 0.1),
        "shouting": _vote(F.col("n_upper") > 0.5 * letters, F.col("n_upper") < 0.15 * letters),
        "exclaiming": _vote(_share("n_bang", "n_words") > 0.2, _share("n_bang", "n_words") < 0.05),
        "repeats": _vote(_share("n_repeat_words", "n_words") > 0.2, _share("n_repeat_words", "n_words") < 0.05),
        "same_lines": _vote(_share("n_dup_lines", "n_lines") > 0.3, _share("n_dup_lines", "n_lines") < 0.1),
        "one_word": _vote((F.col("n_words") >= 10) & (_share("top_word", "n_words") > 0.25), _share("top_word", "n_words") < 0.2),
        "word_length": _vote((mean_length < 2.5) | (mean_length > 12), mean_length.between(3, 10)),
        "lists": _vote((F.col("n_words") >= 10) & (_share("n_pipe", "n_words") > 0.2), _share("n_pipe", "n_words") < 0.02),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, *, rounds: int = 300, start: float = 0.85) -> tuple[np.ndarray, float]:
    """Expectation-maximisation over vote patterns.

    Returns each rule's log odds of "good" for the votes -1, 0 and 1 (rules x 3), and the
    log odds of a good document. It starts from "a bad vote makes bad likely"; a bad vote
    never speaks for good nor a good one for bad, so the two classes keep their meaning.
    Half the bad documents are expected to trip none of a given rule, hence three-valued
    votes by class rather than one accuracy for both.
    """
    if not len(counts):
        return np.zeros((patterns.shape[1], 3)), 0.0
    good = np.where((patterns == -1).any(1), 1 - start, start)
    for _ in range(rounds):
        odds = np.empty((patterns.shape[1], 3))
        for v in range(3):
            hit = patterns == v - 1
            by_class = [((hit * (counts * w)[:, None]).sum(0) + 0.5) / ((counts * w).sum() + 1.5) for w in (good, 1 - good)]
            odds[:, v] = np.log(by_class[0] / by_class[1])
        odds[:, 0], odds[:, 2] = np.minimum(odds[:, 0], 0), np.maximum(odds[:, 2], 0)
        share = float(np.clip((good * counts).sum() / counts.sum(), 0.05, 0.99))
        prior = float(np.log(share / (1 - share)))
        before, good = good, posterior(patterns, odds, prior)
        if np.abs(before - good).max() < 1e-10:
            break
    return odds, prior


def posterior(patterns: np.ndarray, odds: np.ndarray, prior: float) -> np.ndarray:
    logit = prior + np.take_along_axis(odds[None], patterns.astype(int)[:, :, None] + 1, 2)[:, :, 0].sum(1)
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def votes_of(stats: DataFrame) -> DataFrame:
    return stats.select("*", *(v.alias(f"vote_{k}") for k, v in rules().items()))


def learned(voted: DataFrame) -> Column:
    """Probability of "good" from the vote columns, fitted to the counts of all rows' vote patterns."""
    names = [f"vote_{k}" for k in rules()]
    seen = voted.groupBy(*names).count().collect()
    patterns = np.array([[r[n] for n in names] for r in seen], dtype=float).reshape(-1, len(names))
    odds, prior = fit(patterns, np.array([r["count"] for r in seen], dtype=float))
    logit = F.lit(prior)
    for n, (bad, none, good) in zip(names, odds.tolist(), strict=True):
        logit = logit + F.when(F.col(n) == -1, bad).when(F.col(n) == 1, good).otherwise(none)
    return 1 / (1 + F.exp(-logit))


def judged(voted: DataFrame, p_good: Column, threshold: float) -> DataFrame:
    """Adds ``base_failed``, ``p_good`` and ``kept``."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.withColumn("p_good", p_good).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: its id, the counts, ``base_failed``, ``kept`` and ``p_good``."""
    voted = votes_of(staged(with_stats(docs), "quality-stats"))
    return judged(voted, learned(voted), threshold).select("doc_id", *COUNTS, "base_failed", "kept", "p_good")


def passed(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the verdict keeps, same columns. Texts are read twice, to fit and to judge, and never shuffled."""
    p_good = learned(votes_of(with_stats(docs)))
    rows = boxed(docs)
    return unboxed(judged(votes_of(with_stats(rows, tuple(rows.columns))), p_good, threshold).where("kept"), docs.columns)
