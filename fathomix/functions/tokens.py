"""Tokens of a text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A letter (ASCII or Latin-1), more letters, then letters or figures of ASCII.
TOKEN = "[a-zÀ-ÿ]+[a-z0-9]*"
ENTITY = "&[A-Za-z]+;"


def tokens(text: Column, max_length: int = 254) -> Column:
    """Lower-cased tokens in order; character entities give none, nor do figures alone. Tokens of ``max_length`` characters or more are left out."""
    found = F.regexp_extract_all(F.lower(F.regexp_replace(text, ENTITY, " ")), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: F.length(t) < max_length)
