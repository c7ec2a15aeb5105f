"""Learned decision lists over text statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captext.llm.textstats import ratios, text_counts
from captext.session import cut

#: Labelled rows that rules are learned on at most, taken by a hash of doc_id.
LEARN_ROWS = 20_000
#: Cuts tried for each statistic, conditions of a rule and rules of a list at most.
CUTS = 64
MOST_CONDITIONS = 3
MOST_RULES = 12
#: Share of low-quality rows that a rule must have among the pruning rows it covers.
LEAST_PRECISION = 0.9
LEAST_COVERED = 3


@dataclass(frozen=True)
class Condition:
    """stat >= cut (above) or stat <= cut."""

    stat: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x >= self.cut if self.above else x <= self.cut

    def column(self) -> Column:
        return F.col(self.stat) >= self.cut if self.above else F.col(self.stat) <= self.cut

    def __str__(self) -> str:
        return f"{self.stat} {'>=' if self.above else '<='} {self.cut:.6g}"


def covered(rule: list[Condition], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x[c.stat])
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Conditions of the greatest information gain, one after the other."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MOST_CONDITIONS:
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        if not n:
            break
        best, gain = None, 1e-9
        base = np.log2(p / (p + n))
        for stat, values in x.items():
            own, good = values[inside], bad[inside]
            cuts = np.unique(np.quantile(own, np.linspace(0, 1, CUTS + 2)[1:-1]))
            order = np.argsort(own, kind="stable")
            ordered, total = own[order], np.concatenate(([0], np.cumsum(good[order])))
            low, upto = np.searchsorted(ordered, cuts, "left"), np.searchsorted(ordered, cuts, "right")
            for above, some, rows in ((True, total[-1] - total[low], len(own) - low), (False, total[upto], upto)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(some > 0, some * (np.log2(some / rows) - base), -1.0)
                if len(gains) and gains.max() > gain:
                    best, gain = Condition(stat, above, float(cuts[gains.argmax()])), gains.max()
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x[best.stat])
    return rule


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Condition]]:
    """Sequential covering: rules in order, each a conjunction that marks low quality.

    A rule grows on two thirds of the rows still uncovered and loses its last
    conditions while that betters (p - n) / (p + n) on the other third. The list
    ends with the first rule that is not precise enough there.
    """
    rules: list[list[Condition]] = []
    left = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    while len(rules) < MOST_RULES:
        grow, prune = left & ~third, left & third
        if (bad & grow).sum() < LEAST_COVERED or (bad & prune).sum() < 1:
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        tried = []
        for n in range(len(rule), 0, -1):
            hit = covered(rule[:n], x) & prune
            p, q = (hit & bad).sum(), (hit & ~bad).sum()
            tried.append(((p - q) / max(1, p + q), p, -n, p / max(1, p + q)))
        if not tried:
            break
        _, p, n, precision = max(tried)
        rule = rule[:-n]
        everywhere = covered(rule, x) & left
        if p < 1 or precision < LEAST_PRECISION or everywhere.sum() < LEAST_COVERED:
            break
        rules.append(rule)
        left &= ~everywhere
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one conditional expression: the first rule that holds drops, else the row is kept."""
    out = None
    for rule in rules:
        both = rule[0].column()
        for c in rule[1:]:
            both = both & c.column()
        out = F.when(both, F.lit(False)) if out is None else out.when(both, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    docs needs doc_id and text (null: no word), labels doc_id and quality (0 or
    1; others are ignored). The list is learned on LEARN_ROWS labelled rows that
    pass the base rules; without labels of both kinds it is empty and keeps all.
    Repeated rows are answered each.
    """
    stats = ratios()
    rows = cut(text_counts(docs)).withColumns(stats).withColumn("base_failed", base_failed())
    known = labels.where("quality IN (0, 1)").select(F.col("doc_id").alias("_id"), "quality")
    sample = rows.where(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("_id"))
    sample = cut(sample.select("quality", *stats, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("_h"), "doc_id"))
    # A threshold on the hash leaves a few more rows than are taken, so that the order by it is that of a bounded table.
    share = 1.1 * LEARN_ROWS / max(1, sample.count())
    taken = sample.where(F.col("_h") < int(min(1.0, share) * (1 << 30))).orderBy("_h", "doc_id", "quality").limit(LEARN_ROWS).toPandas()
    rules = learn_rules({s: taken[s].to_numpy(float) for s in stats}, taken["quality"].to_numpy() == 0)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))
