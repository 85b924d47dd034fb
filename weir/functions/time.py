"""Free-text timestamps to epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"\A\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?\z"
COMPACT = r"\A\d{8}\z"
LOOSE = r"\A\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}\z"
YEARLESS = r"\A[A-Za-z]{3}\s+\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}\z"


def epoch_ms(text: Column, year: Column) -> Column:
    """ISO 8601 (without a zone: UTC), `Mon d HH:MM:SS` in the given year, or an unpadded
    date and time; NULL for anything else. Shapes are tested first because the cast also
    takes bare years and bare times."""
    t = F.trim(text)
    iso = F.regexp_replace(F.regexp_replace(t, ",", "."), r"(?<=\d{2})([+-]\d{2})(\d{2})$", "$1:$2")
    spaced = F.regexp_replace(t, r"\s+", " ")
    month = F.initcap(F.substring(spaced, 1, 3))
    syslog = F.concat(year.cast("string"), F.lit(" "), month, F.substring(spaced, 4, 40))
    stamp = (
        F.when(t.rlike(ISO), iso.try_cast("timestamp"))
        .when(t.rlike(COMPACT), F.try_to_timestamp(t, F.lit("yyyyMMdd")))
        .when(t.rlike(YEARLESS), F.try_to_timestamp(syslog, F.lit("yyyy MMM d H:m:s")))
        .when(t.rlike(LOOSE), spaced.try_cast("timestamp"))
    )
    return F.unix_millis(stamp)
