r"""URL filters that follow a dated block list.

A list is a log of dated changes: an entry (a host with everything below it, or a path under a
host) is added or removed on a day. Changes of one entry become validity intervals, and a capture
is judged by the entries that were active when it was fetched (an as-of join): key equality plus
``valid_from <= fetched < valid_to``.

A capture is looked up under each suffix of its host and each leading part of its path, so the join
is an equality join for any list size. Captures are first reduced to distinct (host, path, day), so
a host that holds a third of all captures is judged once per path and day; verdicts then meet the
captures in a join that Spark can split. Changes of one entry are first reduced to one per day.

Defined cases: a null, empty or relative URL has no host, matches no entry and is kept; a change
without a date or key is ignored; of several changes of an entry on a day, a removal wins; equal
captures each get their verdict. Other columns are carried in a struct, so names cannot clash.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scheme, optional user, host; what follows the host begins with a port, path, query or fragment.
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without a trailing dot; empty where there is none."""
    return F.coalesce(F.rtrim(F.lower(F.regexp_extract(url, URL, 1)), F.lit(".")), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def host_keys(host: Column) -> Column:
    """The host and every parent domain of at least two labels: a.b.c gives a.b.c and b.c."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    at = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    return F.transform(at, lambda i: F.array_join(F.slice(labels, i, n), "."))


def path_keys(host: Column, path: Column) -> Column:
    """host plus each leading part of the path: /a/b gives host/a and host/a/b."""
    parts = F.array_remove(F.split(path, "/"), "")
    at = F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)))
    keys = F.transform(at, lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(F.size(parts) > 0, keys).otherwise(F.array().cast("array<string>"))


def intervals(changes: DataFrame) -> DataFrame:
    """(key, category, valid_from, valid_to) from changes (key, category, day, action).

    An interval runs from an addition to the next change of any kind, end exclusive; the last one
    is open. ``action`` is "add" or "remove".
    """
    daily = changes.where("key IS NOT NULL AND day IS NOT NULL").groupBy("key", "category", "day").agg(
        F.max(F.col("action") == "remove").alias("removed")
    )
    later = F.lead("day").over(Window.partitionBy("key", "category").orderBy("day"))
    return (
        daily.withColumn("valid_to", later)
        .where(~F.col("removed"))
        .select("key", "category", F.col("day").alias("valid_from"), "valid_to")
    )


def judge(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """``captures`` (url, day, ...) as the struct ``row``, with the matched ``categories``.

    ``categories`` is sorted and holds each category once; empty means that the capture passes.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("row")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = captures.select(row, host.alias("host"), path.alias("path"), F.col("day").alias("day"))
    asked = rows.select("host", "path", "day").where("host <> '' AND day IS NOT NULL").distinct()
    keys = F.explode(F.concat(host_keys(F.col("host")), path_keys(F.col("host"), F.col("path"))))
    probes = asked.withColumn("key", keys)
    active = intervals(changes)
    verdicts = (
        probes.join(active, "key")
        .where("valid_from <= day AND (valid_to IS NULL OR day < valid_to)")
        .groupBy("host", "path", "day")
        .agg(F.array_sort(F.collect_set("category")).alias("categories"))
    )
    return rows.join(verdicts, ["host", "path", "day"], "left").select(
        "row", "host", F.coalesce("categories", F.array().cast("array<string>")).alias("categories")
    )
