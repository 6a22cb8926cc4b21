"""Equi-joins that stay balanced when single keys hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the counted rows, so at most
#: 1 / HOT_SHARE keys are hot and the broadcast below has a fixed bound.
HOT_SHARE = 1.0 / 512
#: Below this many rows a key is never worth a separate plan.
HOT_ROWS = 50_000


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> list:
    """Values of ``key`` whose count ``n`` exceeds the hot share of ``total``; at most 512."""
    limit = max(HOT_ROWS, int(total * HOT_SHARE))
    return [r[0] for r in counts.where(F.col(n) > limit).select(key).collect()]


def split_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """Join a skewed ``left`` with a ``right`` that has one row per key.

    Rows of hot keys meet a broadcast of at most 512 right rows and never move;
    all others go through an ordinary shuffle join. The union is the full result.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    cold = left.where(~is_hot | F.col(key).isNull()).join(right.where(~is_hot), key, how)
    warm = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return cold.unionByName(warm)
