"""The row-wise operators over streams of lines: an extension, for the batch operators keep no state there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.profiles import Profile, apply_profile
from ..operators import templates


def stream_headwords(lines: DataFrame, text: str = "raw", profile: Profile | None = None) -> DataFrame:
    """Headwords of a stream of lines with their forms, by the same expressions as in batch."""
    words = templates.wordlist(lines, text).where("status = 'OK'")
    return apply_profile(words, "headword", profile) if profile else words


def bucket_totals(words: DataFrame, time: str, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Headwords counted by time window; rows later than ``late`` no longer count."""
    return words.withWatermark(time, late).groupBy(F.window(time, every)).agg(F.count(F.lit(1)).alias("n"))
