"""Selecting nodes under a token budget. Requests are groups: greedy ones are folds, or rounds of prefix sums where a
request has many candidates; a knapsack is one task's work, which the budget bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import RESERVED_TOKENS, USEFUL_SHARE
from ..scratch import cut


#: Candidates of a request that are settled by one fold; of more, prefixes are taken in rounds until so many are left.
FOLD = 10_000


def _folded(nodes: DataFrame) -> DataFrame:
    """``greedy`` over one sorted array for each request; ``nodes`` has the budget that is left, and whether anything was used."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ord", F.col("tokens").cast("long").alias("tokens"))))
    state = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("over"), F.array().cast("array<struct<ord:bigint,tokens:bigint>>").alias("taken"))
    left = F.col("left")

    def step(acc, n):
        fits = ~acc["over"] & (acc["used"] + n["tokens"] <= left)
        last = ~acc["over"] & ~fits & (acc["used"] == 0) & ~F.col("some") & (n["tokens"] > left)
        take = F.when(fits, n["tokens"]).when(last, left)
        taken = F.when(take.isNotNull(), F.array_append(acc["taken"], F.struct(n["ord"].cast("long").alias("ord"), take.alias("tokens")))).otherwise(acc["taken"])
        return F.struct((acc["used"] + F.coalesce(take, F.lit(0).cast("long"))).alias("used"), (acc["over"] | last).alias("over"), taken.alias("taken"))

    own = nodes.groupBy("req").agg(ordered.alias("n"), F.first("left").cast("long").alias("left"), F.first("some").alias("some"))
    return own.select("req", F.explode(F.aggregate("n", state, step)["taken"]).alias("t")).select("req", "t.*")


def greedy(nodes: DataFrame, budget: int, fold: int = FOLD) -> DataFrame:
    """req, ord, tokens of what is taken by score: what fits is taken, what doesn't is skipped; a first node over the budget is cut to it and ends the choice.

    A request of more than ``fold`` candidates is worked off in rounds: the longest prefix that fits is taken, what can't fit any
    more is dropped, and so on. Its rows are sorted, and spill, but are never one array."""
    nodes = nodes.select("req", "ord", "score", F.col("tokens").cast("long").alias("tokens"))
    large = nodes.groupBy("req").agg(F.count("*").alias("n")).where(F.col("n") > fold).select("req")
    start = {"left": F.lit(budget).cast("long"), "some": F.lit(False)}
    if large.isEmpty():
        return _folded(nodes.withColumns(start))
    large = cut(large, "budget-large")
    out = _folded(nodes.join(large, "req", "left_anti").withColumns(start))
    rest = cut(nodes.join(large, "req", "left_semi").withColumns(start), "budget-rest")
    # a node over the budget before which nothing is used
    place = F.struct((-F.col("score")).alias("s"), "ord")
    over = rest.where("tokens > 0").groupBy("req").agg(F.min(place).alias("at"), F.min_by("tokens", place).alias("t")).where(F.col("t") > budget)
    cut_at = cut(over.select("req", "at"), "budget-over")
    zero = rest.join(cut_at, "req").where((place < F.col("at")) & (F.col("tokens") == 0)).select("req", F.col("ord").cast("long").alias("ord"), "tokens")
    out = out.union(zero).union(cut_at.select("req", F.col("at.ord").cast("long").alias("ord"), F.lit(budget).cast("long").alias("tokens")))
    rest = rest.join(cut_at, "req", "left_anti").where(F.col("tokens") <= F.col("left"))
    before = Window.partitionBy("req").orderBy(F.desc("score"), "ord").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        rest = cut(rest.select("req", "ord", "score", "tokens", "left", "some").withColumn("upto", F.sum("tokens").over(before)), "budget-rest")
        taken = rest.where(F.col("upto") <= F.col("left"))
        out = out.union(taken.select("req", F.col("ord").cast("long").alias("ord"), "tokens"))
        used = taken.groupBy("req").agg(F.sum("tokens").alias("used"))
        after = rest.where(F.col("upto") > F.col("left")).join(used, "req", "left").withColumn("left", F.col("left") - F.coalesce("used", F.lit(0))).withColumn("some", F.lit(True))
        rest = cut(after.where(F.col("tokens") <= F.col("left")).select("req", "ord", "score", "tokens", "left", "some"), "budget-left")
        many = rest.groupBy("req").agg(F.count("*").alias("n")).where(F.col("n") > fold).select("req")
        few = cut(rest.join(many, "req", "left_anti"), "budget-few")
        out = out.union(_folded(few))
        rest = rest.join(many, "req", "left_semi")
        if rest.isEmpty():
            return out


def proportional(nodes: DataFrame, budget: int) -> DataFrame:
    """req, ord, tokens: each node gets its score's share; it is taken whole, cut to a share over 100, or left out. Requests without any score are chosen greedily."""
    total = nodes.groupBy("req").agg(F.sum("score").alias("total"))
    x = nodes.join(total, "req")
    share = F.floor(F.lit(budget) * (F.col("score") / F.col("total"))).cast("long")
    tokens = F.when(F.col("tokens") <= share, F.col("tokens").cast("long")).when(share > USEFUL_SHARE, share)
    some = x.where("total <> 0").select("req", F.col("ord").cast("long").alias("ord"), tokens.alias("tokens")).where("tokens IS NOT NULL")
    return some.union(greedy(x.where("total = 0").drop("total"), budget))


def knapsack_choice(scores: np.ndarray, tokens: np.ndarray, budget: int) -> list[int]:
    """Places of a subset of greatest score; budgets over 10000 are scaled down in whole steps."""
    if budget > 10_000:
        scale = budget // 10_000
        budget, tokens = budget // scale, tokens // scale
    best = np.zeros(budget + 1)
    took = np.zeros((len(scores), budget + 1), dtype=bool)
    for i, (s, t) in enumerate(zip(scores, tokens, strict=True)):
        if t <= budget:
            other = best.copy()
            other[t:] = best[: budget + 1 - t] + s
            took[i] = other > best
            best = np.maximum(best, other)
    out, left = [], budget
    for i in range(len(scores) - 1, -1, -1):
        if took[i, left]:
            out.append(i)
            left -= tokens[i]
    return out


def knapsack(nodes: DataFrame, budget: int) -> DataFrame:
    """req, ord, tokens of the best subset of each request."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", ignore_index=True)
        chosen = knapsack_choice(pdf["score"].to_numpy(float), pdf["tokens"].to_numpy(int), budget)
        return pdf.loc[chosen, ["req", "ord", "tokens"]].astype("int64")

    return nodes.select("req", "ord", "score", "tokens").groupBy("req").applyInPandas(run, "req long, ord long, tokens long")


def adaptive_choice(nodes: DataFrame, budget: int) -> DataFrame:
    """req, strategy."""
    a = nodes.groupBy("req").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.coalesce(F.var_pop("score"), F.lit(0.0)).alias("v"))
    kind = F.when(F.col("t") <= budget, "greedy").when((F.col("n") > 100) | F.lit(budget > 50_000), "greedy").when(F.col("v") < 0.1, "proportional").otherwise("knapsack")
    return a.select("req", kind.alias("strategy"))


def adaptive(nodes: DataFrame, budget: int) -> DataFrame:
    choice = adaptive_choice(nodes, budget)
    x = nodes.join(choice, "req")
    own = lambda s: x.where(F.col("strategy") == s).drop("strategy")
    return greedy(own("greedy"), budget).union(proportional(own("proportional"), budget)).union(knapsack(own("knapsack"), budget))


def allocate(nodes: DataFrame, max_tokens: int, strategy: str = "adaptive", reserve: int = RESERVED_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The choice (req, ord, tokens) and each request's figures."""
    budget = max_tokens - reserve
    how = {"greedy": greedy, "proportional": proportional, "knapsack": knapsack, "adaptive": adaptive}
    if strategy not in how:
        raise ValueError(f"strategy is one of {sorted(how)}")
    chosen = how[strategy](nodes, budget)
    given = nodes.groupBy("req").agg(F.count("*").alias("n"), F.first("req").alias("r")).drop("r")
    taken = chosen.join(nodes.select("req", "ord", F.col("tokens").alias("whole")), ["req", "ord"]).groupBy("req").agg(F.count("*").alias("nodes_included"), F.sum("tokens").alias("total_tokens"), F.count_if(F.col("tokens") < F.col("whole")).alias("nodes_truncated"))
    stats = given.join(taken, "req", "left").na.fill(0).withColumn("nodes_excluded", F.col("n") - F.col("nodes_included"))
    return chosen, stats.withColumn("budget_used_pct", F.round(F.try_divide(F.col("total_tokens") * 100, F.lit(budget)), 1)).drop("n")


#: A chosen node of fewer tokens counts as truncated in reports.
SMALL = 50


def allocation_report(nodes: DataFrame, chosen: DataFrame, max_tokens: int) -> DataFrame:
    """req and each request's figures: total_tokens, budget_used_pct, nodes_included, nodes_truncated, nodes_excluded, mean_tokens,
    median_tokens, token_savings, truncation_rate (digits: one); requests of which nothing was chosen have zeros."""
    given = nodes.groupBy("req").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    own = chosen.groupBy("req").agg(F.sum("tokens").alias("total_tokens"), F.count("*").alias("nodes_included"), F.count_if(F.col("tokens") < SMALL).alias("nodes_truncated"), F.avg("tokens").alias("mean"), F.median("tokens").alias("median"))
    x = given.join(own, "req", "left").na.fill(0)
    one = lambda c: F.coalesce(F.round(c, 1), F.lit(0.0))
    percent = one(F.try_divide(F.col("total_tokens") * 100, F.lit(max_tokens)))
    return x.select("req", "total_tokens", percent.alias("budget_used_pct"), "nodes_included", "nodes_truncated", (F.col("n") - F.col("nodes_included")).alias("nodes_excluded"), one(F.col("mean")).alias("mean_tokens"), one(F.col("median")).alias("median_tokens"), (F.col("t") - F.col("total_tokens")).alias("token_savings"), one(F.try_divide(F.col("nodes_truncated") * 100, F.col("nodes_included"))).alias("truncation_rate"))
