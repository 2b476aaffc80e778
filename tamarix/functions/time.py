"""Instants as clients of the wire protocol count them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: microseconds from 1970 to 2000, where the protocol's count begins.
EPOCH_2000 = 946_684_800_000_000


def micros_since_2000(ts: Column) -> Column:
    """A timestamp, with or without zone (read as UTC), as microseconds since 2000."""
    return F.unix_micros(ts.cast("timestamp")) - F.lit(EPOCH_2000)


def from_micros_since_2000(micros: Column) -> Column:
    """The timestamp without zone of so many microseconds since 2000, in a session whose zone is UTC."""
    return F.timestamp_micros(micros + F.lit(EPOCH_2000)).cast("timestamp_ntz")
