"""URL filters by a temporal list join.

Lists change: an entry says that from a time on a rule is added to or removed from a list. Each rule's entries, in order of time, become
validity intervals [valid_from, valid_to); at the time of a fetch the latest entry before or at it counts, and a capture is evaluated
against the rules active then. Rules name a host (it and all its subdomains) or a host with a path prefix, cut at slashes.

The join is an equi-join: a capture offers its host's suffixes and its path's prefixes as keys, a few each; the interval is tested within the
key. Rules are broadcast only if they have been counted to be few; otherwise each key's captures are salted and rules repeated for each
salt, so a host with a third of all captures is no hot task. Verdicts come together by capture.

Defined results: null url, or none with a host: no rule applies; null fetch time: no rule applies; an entry without a rule, list, time or known action is
ignored; entries of one rule at the same time: a removal comes last; hosts compare in lower case without user, port and final dots;
repeated captures are evaluated each; empty tables: no captures give none, no entries block none. Extra columns of captures stay; those named like
a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparvox.llm._joins import BROADCAST_ROWS, SALTS
from sparvox.runtime import cut, stage

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """The URL's host, lower-cased; null if there is none."""
    authority = F.regexp_replace(F.regexp_extract(url, AUTHORITY, 1), r"^.*@", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r":\d*$", ""), r"\.+$", ""))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind (host or prefix), rule, valid_from, valid_to (null: open) from list, kind, rule, action (add or remove), effective."""
    whole = entries.where(
        F.col("list").isNotNull() & F.col("rule").isNotNull() & F.col("effective").isNotNull() & F.col("kind").isin("host", "prefix") & F.col("action").isin("add", "remove")
    )
    of_rule = Window.partitionBy("list", "kind", "rule").orderBy("effective", "action")
    spans = whole.select("list", "kind", "rule", "action", F.col("effective").alias("valid_from"), F.lead("effective").over(of_rule).alias("valid_to"))
    return spans.where("action = 'add' AND (valid_to IS NULL OR valid_from < valid_to)").drop("action").distinct()


def keys(url: str) -> Column:
    """array<struct<kind, rule>>: the rules that would cover the URL."""
    host, labels = host_of(F.col(url)), F.split(host_of(F.col(url)), r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("rule")))
    steps = F.array_remove(F.split(path_of(F.col(url)), "/"), "")
    prefix = lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.lit("prefix").alias("kind"), prefix(i).alias("rule")))
    both = F.when(F.size(steps) > 0, F.concat(hosts, prefixes)).otherwise(hosts)
    return F.when(host.isNotNull(), both)


def evaluate(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with blocked (boolean), n_rules (long: active rules that cover it) and lists (array<string>, sorted, distinct)."""
    names = [c for c in captures.columns if c not in ("blocked", "n_rules", "lists")]
    rows = stage(captures.select(*names).withColumn("__row", F.monotonically_increasing_id()), "captures")
    rules = cut(intervals(entries))
    offered = rows.select("__row", F.col(fetched).alias("__at"), F.explode(F.array_distinct(keys(url))).alias("k")).select("__row", "__at", "k.kind", "k.rule")
    on = ["kind", "rule"]
    if rules.count() <= BROADCAST_ROWS:
        rules = F.broadcast(rules)
    else:
        salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
        offered, rules, on = offered.withColumn("salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS))), rules.withColumn("salt", F.explode(salts)), [*on, "salt"]
    met = offered.join(rules, on).where((F.col("valid_from") <= F.col("__at")) & (F.col("valid_to").isNull() | (F.col("__at") < F.col("valid_to"))))
    verdicts = met.groupBy("__row").agg(F.count("*").alias("n_rules"), F.array_sort(F.collect_set("list")).alias("lists"))
    out = rows.join(verdicts, "__row", "left")
    none = F.array().cast("array<string>")
    return out.select(*names, F.col("n_rules").isNotNull().alias("blocked"), F.coalesce("n_rules", F.lit(0).cast("long")).alias("n_rules"), F.coalesce("lists", none).alias("lists"))


def sample_captures(pages: DataFrame) -> DataFrame:
    """page_id, url and a fetch time of 2024 that follows from the id."""
    day = F.lit("2024-01-01 00:00:00").cast("timestamp")
    seconds = F.pmod(F.col("page_id") * 7919, F.lit(366 * 86400))
    return pages.select("page_id", "url", F.timestamp_seconds(F.unix_timestamp(day) + seconds).alias("fetched"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """Dated entries over the pages' hosts: which, on which list and when follows from the digest of the host's name.

    Three of 16 hosts are on a list from some day on, leave it 16 to 271 days later and come back 30 days after that; of one of 16 the
    first path step's rule is added.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract(path_of(F.col("url")), r"^/+([^/]+)", 1).alias("step")).where("host IS NOT NULL")
    mark = F.md5(F.col("host").cast("binary"))
    number = lambda a: F.conv(F.substring(mark, a, 2), 16, 10).cast("int")
    first = F.date_add(F.lit("2023-10-01").cast("date"), number(3))
    gone = F.date_add(first, number(5) + 16)
    back = F.date_add(gone, F.lit(30))
    kind = F.when(F.substring(mark, 1, 1).isin("0", "1", "2"), "host").when((F.substring(mark, 1, 1) == "3") & (F.col("step") != ""), "prefix")
    rule = F.when(kind == "host", F.col("host")).otherwise(F.concat("host", F.lit("/"), "step"))
    name = F.when(F.substring(mark, 7, 1) < "8", "spam").otherwise("adult")
    event = lambda action, day: F.struct(F.lit(action).alias("action"), day.cast("timestamp").alias("effective"))
    listed = hosts.select(kind.alias("kind"), rule.alias("rule"), name.alias("list"), F.explode(F.array(event("add", first), event("remove", gone), event("add", back))).alias("e"))
    return listed.where("kind IS NOT NULL").select("list", "kind", "rule", "e.action", "e.effective").distinct()


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, fetched_s (seconds since 1970), blocked, n_rules, lists (joined by commas) of every page."""
    done = evaluate(sample_captures(pages), sample_entries(pages))
    return done.select("page_id", "url", F.unix_timestamp("fetched").alias("fetched_s"), "blocked", "n_rules", F.array_join("lists", ",").alias("lists"))


SQL = r"""
WITH captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_seconds((page_id * 7919) % (366 * 86400)) AS fetched,
         nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':\d*$', ''), '\.+$', '')), '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS steps
  FROM pages),
marks AS (SELECT DISTINCT host, coalesce(steps[1], '') AS step, md5(host) AS mark FROM captures WHERE host IS NOT NULL),
dated AS (
  SELECT host, step, mark, CASE WHEN substr(mark, 1, 1) IN ('0', '1', '2') THEN 'host' WHEN substr(mark, 1, 1) = '3' AND step <> '' THEN 'prefix' END AS kind,
         CASE WHEN substr(mark, 7, 1) < '8' THEN 'spam' ELSE 'adult' END AS list,
         DATE '2023-10-01' + ('0x' || substr(mark, 3, 2))::INT AS first, ('0x' || substr(mark, 5, 2))::INT + 16 AS stay
  FROM marks),
rules AS (SELECT DISTINCT list, kind, CASE WHEN kind = 'host' THEN host ELSE host || '/' || step END AS rule, first, stay FROM dated WHERE kind IS NOT NULL),
spans AS (
  SELECT list, kind, rule, first::TIMESTAMP AS valid_from, (first + stay)::TIMESTAMP AS valid_to FROM rules
  UNION ALL SELECT list, kind, rule, (first + stay + 30)::TIMESTAMP, NULL FROM rules),
offered AS (
  SELECT page_id, url, fetched, 'host' AS kind, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS rule FROM captures WHERE host IS NOT NULL
  UNION ALL
  SELECT page_id, url, fetched, 'prefix', unnest(list_transform(range(1, len(steps) + 1), lambda i: host || '/' || array_to_string(steps[1:i], '/'))) FROM captures WHERE host IS NOT NULL AND len(steps) > 0),
met AS (
  SELECT o.page_id, count(*) AS n_rules, string_agg(DISTINCT s.list, ',' ORDER BY s.list) AS lists
  FROM (SELECT DISTINCT * FROM offered) o JOIN spans s ON o.kind = s.kind AND o.rule = s.rule AND s.valid_from <= o.fetched AND (s.valid_to IS NULL OR o.fetched < s.valid_to)
  GROUP BY o.page_id)
SELECT c.page_id, c.url, epoch(c.fetched)::BIGINT AS fetched_s, m.page_id IS NOT NULL AS blocked, coalesce(m.n_rules, 0)::BIGINT AS n_rules, coalesce(m.lists, '') AS lists
FROM captures c LEFT JOIN met m ON c.page_id = m.page_id
"""
