"""Ages and dates. The present is always a column or a literal, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.text import strip


def age(at: Column, now: Column) -> Column:
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))

    def every(unit: int, letter: str) -> Column:
        return F.concat(F.floor(seconds / unit).cast("long").cast("string"), F.lit(f"{letter} ago"))

    return (
        F.when(at.isNull(), "never").when(seconds < 5, "just now").when(seconds < 60, every(1, "s"))
        .when(seconds < 3600, every(60, "m")).when(seconds < 86400, every(3600, "h")).otherwise(every(86400, "d"))
    )


def posted_age(posted: Column, first_seen: Column, now: Column) -> Column:
    """A relative time as it stands, a date as its age, else the age of the first sighting."""
    text = strip(F.coalesce(posted, F.lit("")))
    bare = F.regexp_replace(text, "^[A-Za-z]{3,9},? +", "")  # a weekday is not parsed
    parsed = F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "MMM d, yyyy")])
    return F.when(text.rlike(r"(?i)^\d+[smhdw]\b|\bago\b"), text).otherwise(age(F.coalesce(parsed, first_seen.cast("timestamp")), now))


def posted_date(raw: Column) -> Column:
    """yyyy-mm-dd or null."""
    text = strip(raw)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
