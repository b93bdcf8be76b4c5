"""Fuzzy name scores used by community search."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

from quillgraph.functions.arrays import bind
from quillgraph.functions.text import WS

# Characters ignored when names are compared.
IGNORED = r"""[\s\x0B\x1C-\x1F\x85\p{Z}.,，。！？!?、:：;；'"“”‘’()\[\]{}<>《》【】_+*/\\|@#$%^&=~`·-]+"""
# Outside these characters compatibility normalisation may change the text.
STABLE = r"[^\x00-\x7F\xC0-\xFF]"


def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda value: None if value is None else unicodedata.normalize("NFKC", value))


def search_form(name: Column, wide: bool = True) -> Column:
    """NFKC, lower case, punctuation and spaces removed.

    Only names with characters that NFKC may change go to Python; ``wide=False``
    leaves them out for names known to be plain.
    """
    text = F.coalesce(name, F.lit(""))
    if wide:
        odd = text.rlike(STABLE)
        text = F.coalesce(F.pandas_udf(_nfkc, "string")(F.when(odd, text)), text)
    return F.regexp_replace(F.lower(text), IGNORED, "")


def _subsequence_end(name: Column, query: Column) -> Column:
    """Index of the last character when ``query`` is read in order inside ``name``, else -1."""
    start = F.struct(F.lit(0).alias("q"), F.lit(-1).alias("last"), F.lit(0).alias("i"))

    def step(acc: Column, ch: Column) -> Column:
        hit = (acc.q < F.length(query)) & (ch == F.substring(query, acc.q + 1, 1))
        return F.struct(
            F.when(hit, acc.q + 1).otherwise(acc.q).alias("q"),
            F.when(hit, acc.i).otherwise(acc["last"]).alias("last"),
            (acc.i + 1).alias("i"))

    return F.aggregate(
        F.split(name, ""), start, step,
        lambda s: F.when(s.q == F.length(query), s["last"]).otherwise(F.lit(-1)))


def fuzzy_score(name: Column, query: Column) -> Column:
    """Score of a name for a query, both in search form; -1 without a match."""
    place = F.instr(name, query) - 1
    return (
        F.when(query == "", F.lit(0))
        .when(name == query, F.lit(1000))
        .when(name.startswith(query), F.lit(900) - F.length(name))
        .when(place >= 0, F.lit(800) - place)
        .otherwise(bind(_subsequence_end(name, query), lambda e: F.when(e >= 0, F.lit(600) - e).otherwise(F.lit(-1))))
    )
