"""Weekly demand series on Spark: cleaning, features, clustering, models and forecasts.

Every operator is a ``DataFrame -> DataFrame`` function that fits ``DataFrame.transform``.
"""

from weekloom.spec import SeriesSpec

__all__ = ["SeriesSpec"]
