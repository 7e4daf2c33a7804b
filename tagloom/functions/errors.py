"""Classification of error messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.text import to_col


def error_code(message: Column | str) -> Column:
    """First 4xx/5xx number standing alone in the message, else ``error``."""
    code = F.regexp_extract(to_col(message), r"\b(4[0-9]{2}|5[0-9]{2})\b", 1)
    return F.coalesce(F.nullif(code, F.lit("")), F.lit("error"))


def is_transient(message: Column | str) -> Column:
    message = to_col(message)
    return F.coalesce(message.contains("503") | message.contains("429"), F.lit(False))


def key_of_address(address: Column | str) -> Column:
    """Rate-limit key of a client address; a missing address becomes ``0``."""
    return F.regexp_replace(F.coalesce(to_col(address), F.lit("0")), "[^a-fA-F0-9.:]", "")


def clean_job_id(job_id: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(to_col(job_id), F.lit("")), "[^a-zA-Z0-9_-]", "")
