"""Dates of feeds and pages as seconds since 1970."""

from __future__ import annotations

from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def rfc_unix(text: str | None) -> int | None:
    """Of a mail date (Tue, 01 Jul 2003 10:52:37 +0200; names of zones too); without a zone it is UTC. None if it isn't one."""
    try:
        t = parsedate_to_datetime((text or "").strip())
    except (ValueError, TypeError, IndexError):
        return None
    return int((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp())


def iso_unix(text: str | None) -> int | None:
    """Of an ISO date or time (2003-07-01, 2003-07-01T10:52:37Z); without a zone it is UTC. None if it isn't one."""
    try:
        t = datetime.fromisoformat((text or "").strip())
    except ValueError:
        return None
    return int((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp())


def any_unix(text: str | None) -> int | None:
    """Of either form."""
    found = iso_unix(text)
    return rfc_unix(text) if found is None else found


@F.pandas_udf(LongType())
def unix_times(texts: pd.Series) -> pd.Series:
    return pd.Series([any_unix(t) for t in texts], dtype="Int64")
