"""Steps in another coordinate space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.functions.geometry import action_to_space, box_to_space


def in_space(steps: DataFrame, space: str = "normalized_1000") -> DataFrame:
    """``steps`` with action, history and target box in ``space``; elements stay, and so does a step without a screen.  Row-local."""
    screen, to = F.col("screen_size"), F.lit(space)

    def moved(name: str, there: Column) -> Column:
        return F.when(screen.isNull(), F.col(name)).otherwise(there)

    return steps.withColumns({
        "action": moved("action", action_to_space(F.col("action"), screen, to)),
        "history": moved("history", F.transform("history", lambda a: action_to_space(a, screen, to))),
        "target_bbox": moved("target_bbox", box_to_space(F.col("target_bbox"), screen, to)),
    })
