import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weekloom.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("BENCH_CPUS", "8"), shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


MONDAY = dt.date(1998, 1, 5)


def week(i: int) -> dt.date:
    return MONDAY + dt.timedelta(weeks=i)


@pytest.fixture(scope="session")
def weekly(spark):
    """make(series -> list of (week, volume[, promo])) as a weekly table with labels."""
    schema = (
        "establecimiento string, material string, week date, weekly_volume double, has_promo int, "
        "is_covid_period int, cluster_label int"
    )

    def make(series: dict, label=lambda key: 0):
        rows = []
        for key, points in series.items():
            for i, volume, *promo in points:
                rows.append((*key, week(i), volume, promo[0] if promo else 0, 0, label(key)))
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def random_weekly(weekly):
    """Several series of different lengths in three clusters."""
    import random

    rng = random.Random(5)
    series = {}
    for s in range(6):
        for m in range(4):
            n = rng.randint(60, 140)
            start = rng.randint(0, 20)
            series[(f"s{s}", f"m{m}")] = [
                (start + i, float(rng.choice([0, 0, 1, 5, 9, 12])), rng.randint(0, 1)) for i in range(n)
            ]
    return weekly(series, lambda key: int(key[0][1]) % 3).cache()
