"""The texts of the crawler's tables that the page operators work on, and the forms of their lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize, maybe_broadcast, spread

#: A class of white space for Java's regular expressions, no-break spaces among it.
JAVA_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
PYTHON_SPACE = re.compile("[\\s\\ufeff]+")
_DIGITS = re.compile("[0-9]+")


def texts_of(resource: DataFrame, resource_text: DataFrame, kind: str | None = None) -> DataFrame:
    """As :func:`ok_texts`, but repeated deliveries come again and nothing is written: for readers that drop them late."""
    ids = resource.where(F.col("host").isNotNull() & (F.lit(True) if kind is None else F.col("kind") == kind))
    ids = ids.select(F.col("id").alias("resource_id"), "host", "kind", F.to_date(F.coalesce("last_changed_at", "first_seen_at")).alias("day")).dropDuplicates(["resource_id"])
    texts = resource_text.where((F.col("status") == "ok") & F.col("text").isNotNull()).select("resource_id", "text")
    return spread(texts).join(maybe_broadcast(ids), "resource_id")


def ok_texts(resource: DataFrame, resource_text: DataFrame, kind: str | None = None) -> DataFrame:
    """Rows (resource_id, host, kind, text, day), one per resource with an ok text, written to the shared folder.

    ``day`` is the date of the last change, else of the first sight. ``kind`` keeps one kind. A null id, host or text
    leaves the row out; repeated deliveries count once. Texts are shuffled once, by resource.
    """
    ids = resource.where(F.col("host").isNotNull() & (F.lit(True) if kind is None else F.col("kind") == kind))
    ids = ids.select(F.col("id").alias("resource_id"), "host", "kind", F.to_date(F.coalesce("last_changed_at", "first_seen_at")).alias("day"))
    texts = resource_text.where((F.col("status") == "ok") & F.col("text").isNotNull()).select("resource_id", "text")
    return materialize(texts.join(ids, "resource_id").dropDuplicates(["resource_id"]))


#: The same without the line break, which ends a line.
_WITHIN_LINE = JAVA_SPACE.replace(r"\s", r"\t\x0b\f\r ")


def line_hashes(text: Column) -> Column:
    """array<bigint>: the hash of each line in the form lines are equal in, null for a blank line.

    The form is lower case, white space runs as one space, trimmed, digit runs as one 0. Whole texts are folded before
    they are split, which costs two regular expressions a text instead of two a line.
    """
    folded = F.regexp_replace(F.regexp_replace(F.lower(text), _WITHIN_LINE + "+", " "), "[0-9]+", "0")
    return F.transform(F.transform(F.split(folded, "\n", -1), lambda x: F.btrim(x)), lambda x: F.when(x != "", F.xxhash64(x)))


def python_form(line: str) -> str:
    """The form of :func:`line_hashes` for one line, in Python."""
    return _DIGITS.sub("0", PYTHON_SPACE.sub(" ", line.lower()).strip())
