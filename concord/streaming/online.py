"""Two operators on streams: scoring new items, and first events per subject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.centroid import nearest_centroids


def score_stream(items: DataFrame, centroids: DataFrame) -> DataFrame:
    """Nearest centroid of items as they arrive; stateless, the centroids are broadcast once.

    ``centroids`` is a static table small enough to be a model.
    """
    return nearest_centroids(items, centroids)


def first_events(events: DataFrame, subject: str, event_time: str, order: Sequence[str] = ()) -> DataFrame:
    """(subject, event_time, order...): the earliest event of each subject by event time, whatever order they arrive in.

    The state is one row per subject, the minimum so far. There is no watermark, so no late event is
    lost; write it in update or complete mode. ``order`` columns break ties and are shown.
    """
    first = F.min(F.struct(event_time, *order)).alias("first")
    return events.groupBy(subject).agg(first).select(subject, "first.*")
