"""What a decoder's memory is worth: losses with it, with another row's, and without, and what of the gain is its presence or its content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONDITIONS = ("conditioned", "shuffled", "off")
NONE, WEAK, MODERATE = 0.02, 0.05, 0.15


def content_verdict(content: Column) -> Column:
    size = F.abs(content)
    return F.when(size < NONE, "none").when(size < WEAK, "weak").when(size < MODERATE, "moderate").otherwise("strong")


def gains(means: DataFrame) -> DataFrame:
    """One row (presence, content, total, presence_share, verdict) of one with the mean losses of each condition."""
    off, shuffled, known = F.col("off"), F.col("shuffled"), F.col("conditioned")
    share = F.when(off != known, (off - shuffled) / (off - known))
    return means.select((off - shuffled).alias("presence"), (shuffled - known).alias("content"), (off - known).alias("total"), share.alias("presence_share"), content_verdict(shuffled - known).alias("verdict"))


def decomposition(losses: DataFrame) -> DataFrame:
    """(presence, content, total, presence_share, verdict, ce_*, macro_*) of token losses (condition, seq, loss): weighted by tokens, and as means of sequences.

    Losses of a sequence are summed where they lie; conditions other than the three do not count; null losses do not either.
    """
    per = losses.where(F.col("condition").isin(*CONDITIONS) & F.col("loss").isNotNull()).groupBy("condition", "seq").agg(F.sum("loss").alias("ce"), F.count("*").alias("n"))
    of = lambda c, x: F.sum(F.when(F.col("condition") == c, x))
    means = per.agg(*(F.try_divide(of(c, F.col("ce")), of(c, F.col("n"))).alias(c) for c in CONDITIONS), *(F.avg(F.when(F.col("condition") == c, F.col("ce") / F.col("n"))).alias(f"macro_{c}") for c in CONDITIONS))
    kept = means.select(*(F.col(c).alias(f"ce_{c}") for c in CONDITIONS), *(f"macro_{c}" for c in CONDITIONS))
    return gains(means).crossJoin(kept)  # one row each
