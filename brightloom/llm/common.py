"""Small helpers that every operator of this package shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.storage import Conflict, Manifest, dealt, fresh_path, removed, stored

__all__ = ["dealt", "fresh_path", "stored", "Conflict", "Manifest", "ascii_lower", "ascii_strip", "only", "packed", "removed", "unpacked"]

#: The characters of the class [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """(row, *columns): every row of docs as one struct, so that its names can't clash with an operator's own."""
    return docs.select(F.struct("*").alias("row"), *columns)


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs from ``row``, in their order; those named in ``changed`` are replaced, or come behind."""
    found = []
    for name in docs.columns:
        new = next((k for k in changed if k.lower() == name.lower()), None)
        found.append(changed.pop(new).alias(name) if new else F.col("row").getField(name).alias(name))
    return rows.select(*found, *[c.alias(name) for name, c in changed.items()])


def only(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of rows, whatever characters their names hold."""
    return rows.select(*["`" + name.replace("`", "``") + "`" for name in columns])


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` where the text has no other capital letter, since it is much faster."""
    other = text.rlike(r"[\p{javaUpperCase}\p{javaTitleCase}&&[^A-Z]]")
    return F.when(other, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def ascii_strip(text: Column) -> Column:
    """Without the characters of ASCII_SPACE at both ends."""
    return F.trim(text, F.lit(ASCII_SPACE))
