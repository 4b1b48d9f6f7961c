"""Checks of extracted texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx


def repeats(text: Column, least: int = 40) -> Column:
    """A line of more than ``least`` characters stands there twice."""
    long = F.filter(F.transform(tx.lines(text), lambda x: tx.stripped(x)), lambda x: F.length(x) > least)
    return F.size(long) != F.size(F.array_distinct(long))


def metrics(df: DataFrame, by: str, text: str, boilerplate: dict[str, str], title: str | None = None, lead: str | None = None, page_day: str | None = None, day: str | None = None) -> DataFrame:
    """Per group: rows, shares of short texts, median length, shares of texts with repeated lines and of those that aren't
    in Latin script, the share in which each pattern of ``boilerplate`` is found (any case, ^ and $ at lines); where the
    columns are given also of rows without title, without lead, and with another day on the page."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return df.groupBy(by).agg(
        F.count("*").alias("n"), rate((n < 200).cast("int")).alias("under_200"), rate((n < 500).cast("int")).alias("under_500"), F.median(n).alias("median_chars"), rate(repeats(t).cast("int")).alias("repeated_lines"), rate((tx.script(tx.cyrillic_share(t)) != "latn").cast("int")).alias("cyrillic"),
        *[rate((F.coalesce(F.col(c), F.lit("")) == "").cast("int")).alias(f"no_{k}") for k, c in (("title", title), ("lead", lead)) if c],
        *([rate((F.coalesce(F.col(page_day) != F.col(day), F.lit(False))).cast("int")).alias("other_day")] if page_day and day else []),
        *[rate(t.rlike("(?im)" + p).cast("int")).alias(f"has_{k}") for k, p in boilerplate.items()],
    )


def visible_share(paragraphs: Column, rendered: Column) -> Column:
    """Share of the paragraphs that stand in the rendered text, both normalised; null without paragraphs."""
    page = tx.normalised(tx.to_latin(rendered))
    own = F.filter(F.transform(paragraphs, lambda p: tx.normalised(tx.to_latin(p))), lambda p: p != "")
    return F.try_divide(F.size(F.filter(own, lambda p: F.contains(page, p))).cast("double"), F.size(own).cast("double"))


def characters_per_token(df: DataFrame, text: str, tokens: str) -> DataFrame:
    return df.agg(F.try_divide(F.sum(F.length(text)).cast("double"), F.sum(tokens).cast("double")).alias("chars_per_token"))
