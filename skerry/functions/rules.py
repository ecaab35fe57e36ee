"""Ordered rules as columns: the first that applies wins.

Rules are parameters, a sequence of (label, keywords) in the order of precedence. A
rule set of literals becomes one CASE in generated code; a large rule set
is a table and is applied by ``matched_by_table``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, Sequence[str]]]


def any_of(c: Column, keywords: Sequence[str]) -> Column:
    """c contains one of the keywords: one pattern, so that c is made once."""
    return F.coalesce(c.rlike("|".join(map(re.escape, keywords))), F.lit(False)) if keywords else F.lit(False)


def first_match(c: Column, rules: Rules, default: str | None = None) -> Column:
    """The label of the first rule of which c contains a keyword."""
    out = F
    for label, keywords in rules:
        out = out.when(any_of(c, keywords), label)
    return F.lit(default) if out is F else out.otherwise(F.lit(default))


def all_matches(c: Column, rules: Rules) -> Column:
    """The labels of all rules that apply, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(any_of(c, k), label) for label, k in rules))))


#: Keywords of a rule table that one scan looks for.
BLOCK = 200


def matched_by_table(df: DataFrame, text: str, rules: DataFrame, key: str) -> DataFrame:
    """df with the label of the first of many rules: rules has seq, keyword, label.

    The rules are a stated set against all rows. They go out in blocks of a fixed
    number, each a projection of one scan that finds the least seq of the keywords that a
    row contains; least seqs are aggregated by key and meet their labels by an equi-join.
    """
    found = None
    for block in _blocks(rules):
        least = F.least(*(F.when(F.contains(F.col(text), F.lit(w)), F.lit(n)) for n, w in block), F.lit(None).cast("bigint"))
        part = df.select(key, least.alias("seq")).filter("seq is not null")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return df.withColumn("label", F.lit(None).cast("string"))
    best = found.groupBy(key).agg(F.min("seq").alias("seq")).join(rules.select(F.col("seq").cast("bigint").alias("seq"), "label"), "seq").select(key, "label")
    return df.join(best, key, "left")


def _blocks(rules: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    for r in rules.select(F.col("seq").cast("bigint"), "keyword").filter("keyword <> ''").toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block
