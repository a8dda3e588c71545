"""Column functions that the engine uses, by themselves."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_millis(moment: Column) -> Column:
    """Milliseconds since 1970 of a timestamp; naive ones in the session's zone."""
    return F.unix_millis(moment.cast("timestamp"))


def bucket_of(moment: Column, start: int, span: int, number: int) -> Column:
    """Bucket of a moment in ``number`` parts of [start, start + span), in
    milliseconds; multiplied before it is divided, so uneven parts are exact."""
    return F.call_function("div", (epoch_millis(moment) - F.lit(start)) * F.lit(number), F.lit(span))


def json_text(value: Column) -> Column:
    """A map, array or struct as the JSON text that pattern operators search."""
    return F.to_json(value)


def like_escape(text: str) -> str:
    """A text with \\, % and _ taken literally by LIKE ... ESCAPE '\\'."""
    return re.sub(r"([\\%_])", r"\\\1", text)
