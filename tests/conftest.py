import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trackmeter.session import local_session  # noqa: E402

FIX = "`event-id` bigint, `timestamp` timestamp_ntz, `location-lat` double, `location-long` double, `individual-local-identifier` string, delivered_at timestamp_ntz"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", **{"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.driver.memory": "3g"})
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


def at(seconds: float) -> dt.datetime:
    return dt.datetime(2004, 3, 1) + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="session")
def make_fixes(spark):
    """Rows (event_id, seconds, lat, lon, animal[, delivered seconds]) as a table of fixes."""

    def make(rows, extra=None):
        full = [(e, None if s is None else at(s), la, lo, a, at(rest[0] if rest else 10**6)) for e, s, la, lo, a, *rest in rows]
        df = spark.createDataFrame(full, FIX)
        for name in extra or []:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
        return df

    return make
