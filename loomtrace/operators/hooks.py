"""Pluggable models as vectorized functions over columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

PERCEPTION = "primitive STRING, confidence DOUBLE, history_conditioned BOOLEAN, history_match DOUBLE, model_version STRING"


def perceive(rows: DataFrame, model: Callable[[pd.Series, pd.Series], pd.DataFrame], previous: str = "previous_text",
             current: str = "text", name: str = "behavior") -> DataFrame:
    """Add the model's behaviour record; rows without a previous text get none and never reach the model.

    ``model`` takes two text series and returns a frame with the columns of ``PERCEPTION``.
    """
    call = F.pandas_udf(model, PERCEPTION)
    usable = F.coalesce(F.col(previous), F.lit("")) != ""
    asked = rows.filter(usable).withColumn(name, call(F.col(previous), F.col(current)))
    rest = rows.filter(~usable).withColumn(name, F.lit(None).cast(f"STRUCT<{PERCEPTION.replace(' ', ': ').replace(',: ', ', ')}>"))
    return asked.unionByName(rest)


#: Rows and characters of a piece that a scorer gets at once.
PIECE_ROWS, PIECE_CHARS = 1_000, 1_000_000


def _piece_ends(sizes: pd.Series) -> list[int]:
    ends, start, chars = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and (chars + n > PIECE_CHARS or i - start == PIECE_ROWS):
            ends.append(i)
            start, chars = i, 0
        chars += n
    return [*ends, len(sizes)] if len(sizes) else ends


def score_pairs(pairs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], candidate: str = "candidate_text",
                incoming: str = "incoming_text") -> DataFrame:
    """Add ``score`` from a model over text pairs; a built-in column expression is the faster choice where one fits.

    The model gets pieces of at most ``PIECE_ROWS`` rows and, unless one row has more, ``PIECE_CHARS`` characters, so that what it makes of
    the texts is bounded whatever the batches are.
    """
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        ends = _piece_ends(left.str.len().fillna(0) + right.str.len().fillna(0))
        parts = [scorer(left.iloc[a:b].reset_index(drop=True), right.iloc[a:b].reset_index(drop=True)) for a, b in zip([0, *ends], ends)]
        return pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype="float64")

    return pairs.withColumn("score", F.pandas_udf(score, "double")(F.col(candidate), F.col(incoming)))
