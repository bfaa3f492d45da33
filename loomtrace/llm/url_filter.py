"""URL filters by a temporal list join, in SQL functions only.

A block list is a log of dated entries: a host, domain or address is added or removed. The log
becomes validity intervals, and each capture is judged by the entries that were active when it
was fetched. Captures look up their host, each parent domain, and their address without query;
the join is on the key and the month, so a capture only meets the intervals of its own month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtrace.llm.common import table

# Scheme, user part, host, port and path of an address.
HOST = r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^(?i:[a-z][a-z0-9+.-]*:)?//[^/?#]*([^?#]*)"

FAR = "9999-12-31"


def host_of(url: Column) -> Column:
    """The host in lower case, without a closing dot; '' where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def lookup_keys(url: Column) -> Column:
    """The host, its parent domains of two labels or more, and host and path."""
    labels = F.split(host_of(url), r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    domains = F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    address = F.concat(host_of(url), F.regexp_replace(F.regexp_extract(url, PATH, 1), "/$", ""))
    return F.array_distinct(F.concat(domains, F.array(address)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list_name, key, valid_from, valid_to): when an entry was active, end excluded.

    ``entries``: (list_name, key, listed_on date, action 'add' or 'remove'). Of entries for a
    key on one day a removal counts. Days are first made one row each, so a key with any
    number of entries has as many rows as days at most. Rows with a null are no entries.
    """
    days = entries.where("list_name IS NOT NULL AND key IS NOT NULL AND listed_on IS NOT NULL "
                         "AND action IN ('add', 'remove')")
    days = days.groupBy("list_name", F.lower("key").alias("key"), F.col("listed_on").cast("date").alias("valid_from")).agg(
        F.max("action").alias("action"))
    ahead = Window.partitionBy("list_name", "key").orderBy("valid_from")
    spans = days.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(ahead), F.lit(FAR).cast("date")))
    return spans.where("action = 'add'").drop("action")


def _months(first: Column, last: Column) -> Column:
    def number(day: Column) -> Column:
        return F.year(day) * 12 + F.month(day) - 1

    return F.sequence(number(first), number(last))


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, host, fetched_on, blocked, n_entries, lists, keys) per row of ``captures``.

    ``captures``: (page_id, url, fetched_on date). ``lists`` and ``keys`` are the lists and
    keys that apply, sorted, distinct, comma-joined ('' for none); ``n_entries`` counts the
    (list, key) pairs. A null or relative url has no host and matches nothing, and neither does
    a capture without a date. Rows that are equal in all three columns give one row each;
    other columns are ignored; without captures there is no row, without entries nothing is
    blocked.
    """
    rows = captures.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.col("fetched_on").cast("date").alias("fetched_on"))
    # Captures of one address on one day are judged once, however many there are.
    asked = rows.select("url", "fetched_on").where("fetched_on IS NOT NULL").distinct()
    asked = asked.select(
        "url", "fetched_on", (F.year("fetched_on") * 12 + F.month("fetched_on") - 1).alias("month"),
        F.explode(lookup_keys(F.col("url"))).alias("key")).where("key <> ''")
    reach = rows.agg(F.min("fetched_on").alias("first"), F.max("fetched_on").alias("last"))  # one row
    spans = validity_intervals(entries).join(F.broadcast(reach), F.expr("valid_from <= last AND valid_to > first")).select(
        "list_name", "key", "valid_from", "valid_to",
        F.explode(_months(F.greatest("valid_from", "first"), F.least("valid_to", "last"))).alias("month"))
    hits = asked.join(spans, ["key", "month"]).where("valid_from <= fetched_on AND fetched_on < valid_to")

    def joined(column: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(column)), ",")

    # A url has few keys, and a key one interval per list and day: the sets are small.
    verdicts = hits.groupBy("url", "fetched_on").agg(
        F.count(F.lit(1)).alias("n_entries"), joined("list_name").alias("lists"), joined("key").alias("keys"))
    return rows.join(verdicts, ["url", "fetched_on"], "left").select(
        "page_id", host_of(F.col("url")).alias("host"), "fetched_on",
        F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
        F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("keys", F.lit("")).alias("keys"))


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages table as captures; the day of fetching follows from the id, over four years."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(1461)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched_on"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A list log over the hosts of the pages table.

    The MD5 of a host decides: a third of all hosts enter list 'hosts' on a day of their own, most
    of these leave it later and some come back; a tenth of the parent domains enter list
    'domains'; and every host with 'spam' in it is on list 'spam' from the start.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()

    def draw(column: str, at: int) -> Column:
        return F.conv(F.substring(F.md5(column), at, 6), 16, 10).cast("int")

    def day(number: Column) -> Column:
        return F.date_add(F.lit("2020-01-01").cast("date"), number)

    start = draw("host", 1) % 1000
    listed = hosts.where(draw("host", 7) % 3 == 0)
    log = [
        listed.select(F.lit("hosts").alias("list_name"), F.col("host").alias("key"), day(start).alias("listed_on"), F.lit("add").alias("action")),
        listed.where(draw("host", 13) % 4 != 0).select(F.lit("hosts"), "host", day(start + 200), F.lit("remove")),
        listed.where(draw("host", 13) % 4 == 1).select(F.lit("hosts"), "host", day(start + 300), F.lit("add")),
        hosts.where(F.col("host").contains("spam")).select(F.lit("spam"), "host", day(F.lit(0)), F.lit("add")),
    ]
    domains = hosts.select(F.regexp_replace("host", r"^[^.]+\.", "").alias("domain")).where(
        F.col("domain").contains(".")).distinct()
    log.append(domains.where(draw("domain", 1) % 10 == 0).select(
        F.lit("domains"), "domain", day(draw("domain", 7) % 1461), F.lit("add")))
    out = log[0]
    for part in log[1:]:
        out = out.union(part)
    return out


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter(captures_of(pages), entries_of(pages))


ORACLE_SQL = r"""
WITH captures AS (
  SELECT page_id, coalesce(url, '') AS url, DATE '2020-01-01' + CAST((page_id * 37) % 1461 AS INTEGER) AS fetched_on,
         regexp_replace(lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS host,
         regexp_replace(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/$', '') AS path
  FROM pages
), hosts AS (
  SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 6) AS INTEGER) AS a,
         CAST('0x' || substr(md5(host), 7, 6) AS INTEGER) AS b, CAST('0x' || substr(md5(host), 13, 6) AS INTEGER) AS c
  FROM captures WHERE host <> ''
), domains AS (
  SELECT DISTINCT regexp_replace(host, '^[^.]+\.', '') AS domain FROM hosts
), log AS (
  SELECT 'hosts' AS list_name, host AS key, DATE '2020-01-01' + a % 1000 AS listed_on, 'add' AS action FROM hosts WHERE b % 3 = 0
  UNION ALL SELECT 'hosts', host, DATE '2020-01-01' + (a % 1000 + 200), 'remove' FROM hosts WHERE b % 3 = 0 AND c % 4 <> 0
  UNION ALL SELECT 'hosts', host, DATE '2020-01-01' + (a % 1000 + 300), 'add' FROM hosts WHERE b % 3 = 0 AND c % 4 = 1
  UNION ALL SELECT 'spam', host, DATE '2020-01-01', 'add' FROM hosts WHERE contains(host, 'spam')
  UNION ALL SELECT 'domains', domain, DATE '2020-01-01' + CAST('0x' || substr(md5(domain), 7, 6) AS INTEGER) % 1461, 'add'
            FROM domains WHERE contains(domain, '.') AND CAST('0x' || substr(md5(domain), 1, 6) AS INTEGER) % 10 = 0
), spans AS (
  SELECT list_name, key, listed_on, action,
         coalesce(lead(listed_on) OVER (PARTITION BY list_name, key ORDER BY listed_on), DATE '9999-12-31') AS valid_to
  FROM log
), keys AS (
  SELECT page_id, fetched_on, unnest(list_distinct(list_concat([host || path],
         list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1),
                        lambda i: array_to_string(string_split(host, '.')[i:], '.'))))) AS key
  FROM captures
), hits AS (
  SELECT k.page_id, s.list_name, s.key FROM keys k JOIN spans s USING (key)
  WHERE s.action = 'add' AND s.listed_on <= k.fetched_on AND k.fetched_on < s.valid_to AND k.key <> ''
), verdicts AS (
  SELECT page_id, count(*) AS n_entries, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists,
         string_agg(DISTINCT key, ',' ORDER BY key) AS keys
  FROM hits GROUP BY page_id
)
SELECT page_id, host, fetched_on, n_entries IS NOT NULL AS blocked, coalesce(n_entries, 0) AS n_entries,
       coalesce(lists, '') AS lists, coalesce(keys, '') AS keys
FROM captures LEFT JOIN verdicts USING (page_id)
"""
