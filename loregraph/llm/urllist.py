"""URL filters: a temporal join of captures with a dated list.

List entries (pattern, action, day) become validity intervals of each pattern: from an `add` to the next `remove`. A pattern
is a host, which covers its subdomains, or a host with a path, which covers what lies below it. Every capture is evaluated
against the entries active on the day of its fetch; the longest one is reported.

On one day an `add` and a `remove` of a pattern leave it removed. A null pattern, action or day is no entry. A capture with a
null or odd URL, or a null day, is not blocked. A day far away, of an entry or a capture, is a day like any other. Repeated entries count once, repeated captures give repeated rows. Hosts are
compared in lower case without port, user and a closing dot. Empty captures give no rows; with an empty list nothing is blocked. A URL
of any length is taken whole. Columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.llm.common import saved


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, since, until): days since <= d < until on which the pattern is on the list; until is null if open."""
    days = entries.where("pattern is not null and day is not null and action in ('add', 'remove')").groupBy(F.lower("pattern").alias("pattern"), "day").agg(F.max("action").alias("action"))
    by = Window.partitionBy("pattern").orderBy("day")
    turns = days.withColumn("was", F.lag("action").over(by)).where("not (action <=> was)")
    spans = turns.withColumn("until", F.lead("day").over(by))
    return spans.where("action = 'add'").select("pattern", F.col("day").alias("since"), "until")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+?)\.?(?::\d*)?(?:[/?#]|$)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def patterns_of(url: Column) -> Column:
    """All patterns that cover a URL: its host, the host's parents of two labels or more, the host with each path above it."""
    host, labels = url_host(url), F.split(url_host(url), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, 1000), "."))
    steps = F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    paths = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(host, F.lit("/"), F.lower(F.array_join(F.slice(steps, 1, i), "/"))))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(parents, paths))).otherwise(F.array().cast("array<string>"))


def evaluated(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Per row of captures(id, url, day): id, day, blocked, entry."""
    captures, spans = captures.select("id", "url", "day"), intervals(entries)
    asked = saved(captures.select("id", "url", "day", F.explode_outer(patterns_of(F.col("url"))).alias("pattern")).select("id", "url", "day", "pattern"))
    keys = asked.where("pattern is not null and day is not null").select("pattern", "day").distinct()
    # A pattern has a row a day at most, from captures and from the list: the last entry up to a day is the one that counts.
    rows = keys.withColumn("span", F.lit(None).cast("struct<since:date,until:date>")).union(spans.select("pattern", F.col("since").alias("day"), F.struct("since", "until").alias("span")))
    so_far = Window.partitionBy("pattern").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.withColumn("at", F.last("span", ignorenulls=True).over(so_far)).where("span is null and at is not null and (at.until is null or day < at.until)")
    hits = saved(met.select("pattern", "day"))
    best = asked.join(hits, ["pattern", "day"]).groupBy("url", "day").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern")).alias("best"))
    best = saved(best.select(F.col("url").alias("_url"), F.col("day").alias("_day"), "best.pattern"))
    met = captures.join(best, (captures["url"] == best["_url"]) & (captures["day"] == best["_day"]), "left")
    return met.select("id", "day", F.col("pattern").isNotNull().alias("blocked"), F.col("pattern").alias("entry"))
