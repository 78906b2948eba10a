"""Detection with all signals: statistics once, forest, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame

from timberline.functions import scores as S
from timberline.operators.forest import forest_scores
from timberline.operators.scoring import features_of, score_full, with_statistics, with_time_delta
from timberline.session import cut


def detect(events: DataFrame, threshold: float = S.THRESHOLD) -> DataFrame:
    """Events scored by severity, keywords, rarity, bursts and the isolation forest.

    Events with their statistics are written once and read by the features and
    by the fusion. Runs jobs while the plan is made.
    """
    statistics = cut(with_time_delta(with_statistics(events)), "statistics")
    outliers = cut(forest_scores(features_of(statistics)), "forest-scores")
    return score_full(statistics, outliers, threshold).drop("time_delta")
