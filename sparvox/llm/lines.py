"""Line dedup by site-relative frequency.

For every host the share of its pages that hold a line is the line's ratio; a line on more than ratio of them, and on at
least a number of pages, is boilerplate there and leaves all pages of that host, every occurrence. Other hosts keep it. Without that least
number a host of one page would lose all of its lines, and any host of fewer than 1 / ratio pages every line.

A page counts once for a line, however often it has it. Pages per (host, line) are summed before they are shuffled, so a
host with a third of all pages is no hot spot. A host has at most (lines per page) / RATIO boilerplate lines, which go with it
as one array of 64-bit hashes; that table is broadcast only if it has been counted to be small, else hosts are salted.

Defined results: null text stays null (no lines) but counts as a page; an empty text has one line, which is blank; lines without a
character other than \\x20 and \\x09-\\x0D are never dropped; null host: the pages without a host form one site; repeated rows are
pages of their own; an empty table gives an empty table. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparvox.llm._joins import attach, group_key
from sparvox.runtime import cut

#: Menus, notices and licence lines stand on some per cent of a site's pages; what an author wrote hardly comes twice.
RATIO = 0.02
#: Pages that must hold a line before its ratio counts.
PAGES = 5
INK = r"[^\x20\x09-\x0D]"


def boilerplate(df: DataFrame, host: str, text: str, *, ratio: float = RATIO, pages: int = PAGES) -> DataFrame:
    """__host (the host's group key), __marks: hashes of its boilerplate lines; hosts without any are left out."""
    keyed = df.select(group_key(host).alias("__host"), F.col(text).alias("text"))
    lines = keyed.select("__host", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.col("line").rlike(INK))
    seen = lines.groupBy("__host", F.xxhash64("line").alias("mark")).agg(F.count("*").alias("with")).where(F.col("with") >= pages)
    totals = keyed.groupBy("__host").agg(F.count("*").alias("total"))
    over = seen.join(totals, "__host").where(F.col("with") > ratio * F.col("total"))
    return over.groupBy("__host").agg(F.collect_list("mark").alias("__marks"))


def drop_boilerplate(df: DataFrame, *, host: str, text: str = "text", ratio: float = RATIO, pages: int = PAGES, counts: bool = False) -> DataFrame:
    """df with text rid of its host's boilerplate lines; counts adds n_lines and n_dropped (long), in place of columns of these names."""
    marks = cut(boilerplate(df, host, text, ratio=ratio, pages=pages))
    names = df.columns
    joined = attach(df.withColumn("__host", group_key(host)), marks, "__host", F.col(text))
    lines = F.split(text, "\n")

    def stays(line: Column) -> Column:
        return ~F.array_contains("__marks", F.xxhash64(line))

    kept = joined.withColumn("__lines", lines).withColumn("__kept", F.when(F.col("__marks").isNotNull(), F.filter("__lines", stays)))
    done = kept.withColumn(text, F.when(F.col("__marks").isNull(), F.col(text)).otherwise(F.array_join("__kept", "\n")))
    if not counts:
        return done.select(*names)
    n = F.coalesce(F.size("__lines"), F.lit(0))
    n = F.when(F.col("__lines").isNull(), 0).otherwise(n).cast("long")
    dropped = F.when(F.col("__kept").isNull(), 0).otherwise(F.size("__lines") - F.size("__kept")).cast("long")
    return done.select(*(c for c in names if c not in ("n_lines", "n_dropped")), n.alias("n_lines"), dropped.alias("n_dropped"))


def report(df: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_chars and text_md5 of the texts that are left; source is the host."""
    done = drop_boilerplate(df.select("doc_id", "source", "text"), host="source", counts=True)
    return done.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


SQL = f"""
WITH totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
lines AS (SELECT DISTINCT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
marks AS (
  SELECT l.source, l.line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE regexp_matches(l.line, '{INK}')
  GROUP BY l.source, l.line, t.total HAVING count(*) >= {PAGES} AND count(*) > {RATIO} * t.total),
split AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at
  FROM documents WHERE text IS NOT NULL),
kept AS (
  SELECT s.doc_id, count(*) AS n_lines, count(m.line) AS n_dropped,
         coalesce(string_agg(s.line, chr(10) ORDER BY s.at) FILTER (WHERE m.line IS NULL), '') AS text
  FROM split s LEFT JOIN marks m ON s.source IS NOT DISTINCT FROM m.source AND s.line = m.line
  GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped,
       length(k.text)::BIGINT AS n_chars, md5(k.text) AS text_md5
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
