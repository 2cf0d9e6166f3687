"""Joins of texts with the terms that they contain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many terms are broadcast and compared with each text; more meet the texts by a key.
BROADCAST_TERMS = 2000
#: Characters at a term's beginning that are the key.
GRAM = 4


def texts_with(rows: DataFrame, terms: DataFrame, text: str, term: str, most: int = BROADCAST_TERMS) -> DataFrame:
    """rows joined with the terms that their text contains, letter for letter; empty terms and null texts meet nothing.

    A few terms (counted first) are broadcast. More of them are joined by equality: a term stands under its first GRAM characters (all of them where it has fewer), a text under all its runs of so many characters, and what meets there is compared whole."""
    terms = terms.where(F.col(term) != "")
    if terms.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(terms), F.contains(F.col(text), F.col(term)))
    size = F.least(F.length(term), F.lit(GRAM))
    sizes = [r[0] for r in terms.select(size).distinct().collect()]  # at most GRAM rows
    runs = [F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in sizes]  # noqa: B023
    keyed = rows.withColumn("_gram", F.explode(F.array_distinct(F.concat(*runs))))
    return keyed.join(terms.withColumn("_gram", F.substring(F.col(term), F.lit(1), size)), "_gram").where(F.contains(F.col(text), F.col(term))).drop("_gram")
