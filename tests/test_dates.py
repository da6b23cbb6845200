"""The day of a run."""

import datetime as dt

from pyspark.sql import functions as F

from pulse.functions.dates import resolved_day


def test_the_day_is_a_value(spark):
    assert resolved_day(spark, "2024-01-30") == resolved_day(spark, dt.date(2024, 1, 30)) == dt.date(2024, 1, 30)
    before, found, after = (
        spark.range(1).select(F.current_date()).first()[0], resolved_day(spark, None),
        spark.range(1).select(F.current_date()).first()[0],
    )
    assert before <= found <= after
