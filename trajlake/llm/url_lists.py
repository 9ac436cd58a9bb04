"""URL filtering against dated lists: entries become validity intervals, captures join them as of their day.

An entry says that from a day on a domain (and everything below it) is blocked, allowed or no longer
listed; it holds until the domain's next entry. A capture is judged by the entry of the longest
matching domain that is active on the day it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlake.llm.text import table

#: Days per bucket. A domain and bucket hold only the entries that are active in it.
BUCKET_DAYS = 32
ACTIONS = ("block", "allow", "drop")

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host(url: Column) -> Column:
    """The host in lower case without a closing dot; null where a URL has none."""
    found = F.lower(F.rtrim(F.regexp_extract(url, _HOST, 1), F.lit(".")))
    return F.when(found != "", found)


def domains(name: Column) -> Column:
    """The host and every domain above it, longest first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """``entries`` (domain, day, action) as intervals: domain, action, valid_from, valid_to (exclusive, or null).

    Of several entries for a domain and day the first in the order of ``ACTIONS`` holds. Entries
    without domain, day or known action are ignored. ``drop`` ends what held before.
    """
    rank = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    known = entries.where("domain is not null and day is not null").where(F.col("action").isin(*ACTIONS))
    one = known.groupBy(F.lower("domain").alias("domain"), "day").agg(F.min(rank).alias("rank"))
    order = Window.partitionBy("domain").orderBy("day")
    spans = one.withColumn("valid_to", F.lead("day").over(order)).withColumnRenamed("day", "valid_from")
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("rank").cast("int"))
    return spans.where(F.col("rank") < len(ACTIONS)).select("domain", action.alias("action"), "valid_from", "valid_to")


def as_of(captures: DataFrame, spans: DataFrame, url: str, day: str) -> DataFrame:
    """``captures`` with ``verdict`` (block, allow, none), ``entry`` and its ``valid_from``, ``valid_to``.

    Captures are first reduced to distinct hosts and days, so a host's captures meet its entries once.
    Intervals are cut into buckets of days up to the last capture's, and joined on domain and bucket.
    A capture without host or day matches nothing. Columns that clash are replaced.
    """
    kept = [c for c in captures.columns if c not in ("verdict", "entry", "valid_from", "valid_to")]
    packed = F.struct(*[captures[c] for c in kept]).alias("row")
    rows = captures.select(packed, host(captures[url]).alias("_host"), captures[day].alias("_day"))
    last = rows.agg(F.max("_day")).first()[0]
    end = F.least(F.coalesce(F.col("valid_to") - 1, F.lit(last)), F.lit(last)).cast("long")
    cut = spans.where(F.col("valid_from") <= F.lit(last)).withColumn(
        "bucket",
        F.explode(F.sequence(F.floor(F.col("valid_from") / BUCKET_DAYS), F.greatest(F.floor(end / BUCKET_DAYS), F.floor(F.col("valid_from") / BUCKET_DAYS)))),
    )
    asked = rows.select("_host", "_day").where("_host is not null and _day is not null").distinct()
    each = asked.select("_host", "_day", F.floor(F.col("_day") / BUCKET_DAYS).alias("bucket"), F.explode(domains(F.col("_host"))).alias("domain"))
    # Entries cut into buckets are more rows than the planner sees: no broadcast.
    active = each.join(cut.hint("merge"), ["domain", "bucket"]).where(
        (F.col("_day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to")))
    )
    best = active.groupBy("_host", "_day").agg(
        F.max(F.struct(F.length("domain").alias("n"), F.col("domain").alias("entry"), "action", "valid_from", "valid_to")).alias("b")
    )
    out = rows.join(best, ["_host", "_day"], "left")
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept],
        F.coalesce("b.action", F.lit("none")).alias("verdict"), "b.entry", "b.valid_from", "b.valid_to",
    )


# ---- the query's list and fetch days, made from the pages -------------------------------------

#: Captures are spread over so many days.
DAYS = 365


def _number(name: Column) -> Column:
    return F.conv(F.substring(F.md5(name), 1, 6), 16, 10).cast("long")


def page_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.pmod("page_id", F.lit(DAYS)).cast("long").alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the domains of the pages with two labels at least, set by each name's MD5 hash.

    A quarter is blocked from some day on, dropped later and blocked again; an eighth of the names
    with three labels or more is allowed from some day on.
    """
    names = pages.select(F.explode(domains(host(F.col("url")))).alias("domain")).distinct().where("contains(domain, '.')")
    n = _number(F.col("domain"))
    first = n % 200
    blocked = F.array(
        F.struct(first.alias("day"), F.lit("block").alias("action")),
        F.struct((first + 20 + n % 90).alias("day"), F.lit("drop").alias("action")),
        F.struct((first + 80 + n % 90).alias("day"), F.lit("block").alias("action")),
    )
    allowed = F.array(F.struct((n % 150).alias("day"), F.lit("allow").alias("action")))
    labels = F.size(F.split("domain", r"\."))
    chosen = F.when(n % 4 == 0, blocked).when((n % 8 == 1) & (labels > 2), allowed)
    return names.select("domain", F.explode(chosen).alias("e")).select("domain", "e.day", "e.action")


def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict as of the day it was fetched.

    Returns page_id, url, fetched, verdict, entry, valid_from, valid_to (days counted from 0). Pages
    without a usable URL or without page_id get the verdict none; repeated rows are kept.
    """
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return as_of(page_captures(pages), intervals(page_entries(pages)), "url", "fetched")


OP9_SQL = f"""
WITH p AS (
  SELECT page_id, url, ((page_id % {DAYS}) + {DAYS}) % {DAYS} AS fetched,
    nullif(lower(rtrim(regexp_extract(url, '{_HOST}', 1), '.')), '') AS host FROM pages),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS parts FROM p WHERE host IS NOT NULL),
suffixes AS (SELECT host, array_to_string(parts[i:], '.') AS domain FROM hosts, unnest(range(1, len(parts) + 1)) AS u(i)),
names AS (SELECT DISTINCT domain, ('0x' || substr(md5(domain), 1, 6))::BIGINT AS n FROM suffixes WHERE contains(domain, '.')),
entries AS (
  SELECT domain, n % 200 AS day, 'block' AS action FROM names WHERE n % 4 = 0
  UNION ALL SELECT domain, n % 200 + 20 + n % 90, 'drop' FROM names WHERE n % 4 = 0
  UNION ALL SELECT domain, n % 200 + 80 + n % 90, 'block' FROM names WHERE n % 4 = 0
  UNION ALL SELECT domain, n % 150, 'allow' FROM names WHERE n % 8 = 1 AND len(string_split(domain, '.')) > 2),
spans AS (SELECT domain, action, day AS valid_from, lead(day) OVER (PARTITION BY domain ORDER BY day) AS valid_to FROM entries),
found AS (
  SELECT p.host, p.fetched, arg_max(struct_pack(e := s.domain, a := s.action, f := s.valid_from, t := s.valid_to), length(s.domain)) AS b
  FROM (SELECT DISTINCT host, fetched FROM p) p JOIN suffixes x USING (host) JOIN spans s USING (domain)
  WHERE s.action <> 'drop' AND p.fetched >= s.valid_from AND (s.valid_to IS NULL OR p.fetched < s.valid_to)
  GROUP BY ALL)
SELECT p.page_id, p.url, p.fetched, coalesce(b.a, 'none') AS verdict, b.e AS entry, b.f AS valid_from, b.t AS valid_to
FROM p LEFT JOIN found f ON p.host = f.host AND p.fetched = f.fetched
"""
