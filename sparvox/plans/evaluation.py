"""Evaluation queries over the driver's tables, each with the SQL that gives the same rows where SQL can.

The tables stand in for evaluation data: documents and conversation turns are transcripts, events are speech (clip = day, speaker = user,
start = second of the day, end = start + value), lineitem rows are scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparvox.functions import normalize, text
from sparvox.functions.languages import PUBLIC_METRIC, SOURCE_METRIC, canonical_language, public_metric, source_metric
from sparvox.operators import intervals, scoring
from sparvox.runtime import cut, workers_see_package

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_see_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Lexical scores


def successive(docs: DataFrame) -> DataFrame:
    """Each document (reference) with the next one of its language (hypothesis).

    The pairs come from a window over ids only; the texts are joined to them.
    """
    w = Window.partitionBy("lang").orderBy("doc_id")
    ids = docs.select("doc_id", "lang", F.lead("doc_id").over(w).alias("next_id")).where("next_id IS NOT NULL")
    r, h = docs.select("doc_id", F.col("text").alias("reference")), docs.select(F.col("doc_id").alias("next_id"), F.col("text").alias("hypothesis"))
    return ids.join(r, "doc_id").join(h, "next_id").withColumnRenamed("lang", "language")


def followers(df: DataFrame, key: str) -> DataFrame:
    """key, next_id: each id with the one after it. The window that has no partition moves ids only; what belongs to them is joined."""
    ids = df.select(key)
    return ids.select(key, F.lead(key).over(Window.orderBy(key)).alias("next_id")).where("next_id IS NOT NULL")


@query()
def wer_micro_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-averaged word error rate by language, over whole texts."""
    words = lambda c: text.punctuation_to_spaces(F.lower(c))
    pairs = successive(cut(table(spark, sf_dir, "documents").select("doc_id", "lang", words(F.col("text")).alias("text"))))  # each text is on two sides
    tokenized = pairs.repartition(F.xxhash64("reference", "hypothesis"))  # pairs of long texts cost by the square of their length
    spread = tokenized.select("language", *(text.tokens(F.col(c), "wer").alias(c[0]) for c in ("reference", "hypothesis")))
    sums = scoring.distances(spread, F.col("r"), F.col("h")).groupBy("language").agg(F.count("*").alias("items"), F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    return sums.withColumn("value", text.rate(F.col("numerator"), F.col("denominator"))).orderBy("language")


@query()
def edit_counts_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutions, deletions, insertions and hits of every answer against the turn before it, after normalisation."""
    turns = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("reference", F.lag("text").over(w)).where("reference IS NOT NULL AND text IS NOT NULL")
    records = pairs.select("conv_id", "turn", "reference", F.col("text").alias("hypothesis"), F.lit("fr").alias("language"))
    return scoring.score_records(records).select("conv_id", "turn", *scoring.COUNTS, "numerator", "denominator", "value")


@query("""
WITH kinds AS (SELECT event_type, chr((96 + row_number() OVER (ORDER BY event_type))::INT) AS letter FROM (SELECT DISTINCT event_type FROM events)),
seqs AS (SELECT user_id, string_agg(letter, '' ORDER BY ts, event_id) AS s FROM events JOIN kinds USING (event_type) GROUP BY user_id),
pairs AS (SELECT user_id, s AS r, lead(s) OVER (ORDER BY user_id) AS h FROM seqs)
SELECT user_id, levenshtein(r, h)::BIGINT AS numerator, length(r)::BIGINT AS denominator, levenshtein(r, h) / length(r)::DOUBLE AS value FROM pairs WHERE h IS NOT NULL
""")
def event_sequence_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token error rate of each user's event sequence against the next user's."""
    events = table(spark, sf_dir, "events")
    seqs = events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda e: e["event_type"]).alias("r"))
    pairs = seqs.join(followers(seqs, "user_id"), "user_id").join(seqs.select(F.col("user_id").alias("next_id"), F.col("r").alias("h")), "next_id")
    scored = scoring.distances(pairs, F.col("r"), F.col("h"))
    return scored.select("user_id", "numerator", "denominator", text.rate(F.col("numerator"), F.col("denominator")).alias("value"))


@query("""
WITH t AS (SELECT item_id, regexp_replace(regexp_replace(lower(text), '[^\\x00-\\x7F]', '?', 'g'), '\\s', '', 'g') AS r FROM benchmark),
p AS (SELECT item_id, r, lead(r) OVER (ORDER BY item_id) AS h FROM t)
SELECT item_id, levenshtein(r, h)::BIGINT AS numerator, length(r)::BIGINT AS denominator FROM p WHERE h IS NOT NULL
""")
def cer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character edits between successive benchmark texts, in ASCII."""
    items = table(spark, sf_dir, "benchmark")
    r = F.regexp_replace(F.regexp_replace(F.lower("text"), r"[^\x00-\x7F]", "?"), r"\s", "")
    texts = items.select("item_id", r.alias("r"))
    pairs = texts.join(followers(items, "item_id"), "item_id").join(texts.select(F.col("item_id").alias("next_id"), F.col("r").alias("h")), "next_id")
    return pairs.select("item_id", F.levenshtein("r", "h").cast("long").alias("numerator"), F.length("r").cast("long").alias("denominator"))


COUNTED = "SELECT l_returnflag, l_linestatus, l_shipdate, l_linenumber AS s, l_quantity::BIGINT AS d, (l_tax * 100)::BIGINT AS i, l_extendedprice::BIGINT AS h FROM lineitem"


def counted(lines: DataFrame) -> DataFrame:
    whole = lambda c: F.rint(c).cast("long")
    return lines.select(
        "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("long").alias("substitutions"), whole(F.col("l_quantity")).alias("deletions"),
        whole(F.col("l_tax") * 100).alias("insertions"), F.floor("l_extendedprice").cast("long").alias("hits"),
    )


@query("""
WITH c AS (SELECT l_returnflag, l_linestatus, l_linenumber::BIGINT AS s, round_even(l_quantity, 0)::BIGINT AS d, round_even(l_tax * 100, 0)::BIGINT AS i, floor(l_extendedprice)::BIGINT AS h FROM lineitem),
g AS (SELECT l_returnflag, l_linestatus, count(*) AS items, sum(s)::BIGINT AS substitutions, sum(d)::BIGINT AS deletions, sum(i)::BIGINT AS insertions, sum(h)::BIGINT AS hits FROM c GROUP BY ALL)
SELECT *, substitutions + deletions + insertions AS numerator, hits + substitutions + deletions AS denominator,
       (substitutions + deletions + insertions) / (hits + substitutions + deletions)::DOUBLE AS value FROM g
""")
def record_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-average by two dimensions."""
    done = scoring.aggregate_records(counted(table(spark, sf_dir, "lineitem")), ("l_returnflag", "l_linestatus"), ())
    return done.select("dimensions.*", "items", *scoring.COUNTS, "numerator", "denominator", "value")


@query("""
SELECT l.toxic, d.source, count(*) AS items, sum(d.n_chars)::BIGINT AS chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY ALL
""")
def labelled_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by a nullable number and a string dimension."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    both = labels.join(docs.select("doc_id", "source", "n_chars"), "doc_id")
    keys = [scoring.dimension(both, c).alias(f"by_{c}") for c in ("toxic", "source")]
    sums = both.groupBy(*keys).agg(F.first("toxic").alias("toxic"), F.first("source").alias("source"), F.count("*").alias("items"), F.sum("n_chars").alias("chars"))
    return sums.drop("by_toxic", "by_source")


POOL = """
WITH own AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem),
roster AS (SELECT DISTINCT l_linenumber FROM lineitem),
matched AS (SELECT l_orderkey FROM own GROUP BY 1 HAVING count(DISTINCT l_linenumber) = (SELECT count(*) FROM roster)),
sel AS (SELECT * FROM own {where})
SELECT r.l_linenumber::VARCHAR AS model, (SELECT count(DISTINCT l_orderkey) FROM sel s WHERE s.l_linenumber = r.l_linenumber) AS n_clips,
       (SELECT count(DISTINCT l_orderkey) FROM own s WHERE s.l_linenumber = r.l_linenumber) AS available_clips,
       (SELECT coalesce(sum(l_quantity::DECIMAL(28,6)), 0)::DOUBLE FROM sel s WHERE s.l_linenumber = r.l_linenumber) AS numerator,
       (SELECT coalesce(sum(l_extendedprice::DECIMAL(28,6)), 0)::DOUBLE FROM sel s WHERE s.l_linenumber = r.l_linenumber) AS denominator,
       (SELECT sum(l_quantity::DECIMAL(28,6))::DOUBLE / sum(l_extendedprice::DECIMAL(28,6))::DOUBLE FROM sel s WHERE s.l_linenumber = r.l_linenumber) AS value,
       (SELECT sha256('[' || coalesce(string_agg(DISTINCT '"' || l_orderkey || '"', ',' ORDER BY '"' || l_orderkey || '"'), '') || ']') FROM sel s WHERE s.l_linenumber = r.l_linenumber) AS clips_sha256
FROM roster r
"""


def pooled(spark: SparkSession, sf_dir: str, cohort: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    scores = lines.select(F.col("l_orderkey").cast("string").alias("sample_id"), F.col("l_linenumber").cast("string").alias("model"), F.col("l_quantity").alias("numerator"), F.col("l_extendedprice").alias("denominator"))
    return scoring.pool(scores, scores.select("model").distinct(), cohort)


@query(POOL.format(where="WHERE l_orderkey IN (SELECT l_orderkey FROM matched)"))
def pool_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models over the clips that all have."""
    return pooled(spark, sf_dir, "matched")


@query(POOL.format(where=""))
def pool_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models over the clips that each has."""
    return pooled(spark, sf_dir, "available")


@query("""
WITH c AS (SELECT l_orderkey, l_returnflag AS metric, l_linenumber, sum(l_quantity)::DECIMAL(28,6) AS n, sum(l_linenumber) AS d FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL)
SELECT l_orderkey AS sample_id, 'all' AS model, metric, sum(n)::DOUBLE AS numerator, sum(d)::BIGINT AS denominator, sum(n)::DOUBLE / sum(d)::DOUBLE AS value
FROM c GROUP BY l_orderkey, metric HAVING count(DISTINCT l_linenumber) = 2
""")
def dual_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels' counts of the metrics that both have."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    rows = lines.groupBy(F.col("l_orderkey").alias("sample_id"), F.lit("all").alias("model"), F.col("l_linenumber").alias("channel"), F.col("l_returnflag").alias("metric"))
    rows = rows.agg(F.sum("l_quantity").cast("decimal(28,6)").alias("numerator"), F.sum("l_linenumber").alias("denominator"))
    both = scoring.combine_channels(rows)
    return both.withColumns({"numerator": F.col("numerator").cast("double"), "denominator": F.col("denominator").cast("long"), "value": F.col("numerator").cast("double") / F.col("denominator")})


# Intervals. Times are in whole milliseconds over 1000, so that both engines have the same numbers.

SPEECH = """
speech AS (SELECT (ts::DATE)::VARCHAR AS clip, CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS side, user_id::VARCHAR AS speaker,
  (epoch_us(ts) // 1000) % 86400000 AS s, (epoch_us(ts) // 1000) % 86400000 + round(abs(value) * 1000)::BIGINT AS e FROM events)"""


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, side, speaker, start, end."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ms = F.unix_millis("ts") - F.unix_millis(F.date_trunc("day", "ts"))
    events = events.withColumn("s", ms).withColumn("e", ms + F.round(F.abs("value") * 1000).cast("long"))
    side = F.when(F.col("event_type").isin("click", "view"), 0).otherwise(1)
    return events.select(F.to_date("ts").cast("string").alias("clip"), side.alias("side"), F.col("user_id").cast("string").alias("speaker"), (F.col("s") / 1000).alias("start"), (F.col("e") / 1000).alias("end"))


def merged(gap_ms: int, source: str = "speech") -> str:
    """SQL of the union of each speaker's intervals over gaps of up to gap_ms."""
    return f"""
m AS (SELECT *, max(e) OVER (PARTITION BY clip, side, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {source} WHERE e > s),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > {gap_ms} THEN 1 ELSE 0 END) OVER (PARTITION BY clip, side, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m),
u AS (SELECT clip, side, speaker, min(s) AS s, max(e) AS e FROM g GROUP BY clip, side, speaker, isl)"""


def milliseconds(spans: DataFrame) -> DataFrame:
    ms = lambda c: F.round(F.col(c) * 1000).cast("long").alias(c)
    return spans.select("clip", "side", "speaker", ms("start"), ms("end"))


UNION = 'SELECT clip, side, speaker, s::BIGINT AS start, e::BIGINT AS "end" FROM u'


@query(f"WITH {SPEECH}, {merged(0)} {UNION}")
def canonical_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touching and overlapping speech of each speaker."""
    return milliseconds(intervals.canonical_union(speech(spark, sf_dir)))


@query(f"WITH {SPEECH}, {merged(60000)} {UNION}")
def gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech merged over gaps of up to a minute."""
    return milliseconds(intervals.gap_merge(speech(spark, sf_dir).where("end > start"), gap=60.0))


@query(f"WITH {SPEECH}, {merged(200)} {UNION}")
def word_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech from words, gaps of 0.2 s filled."""
    return milliseconds(intervals.word_activity(speech(spark, sf_dir)))


# Two speakers on each side, so that SQL can try both assignments.


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech(spark, sf_dir).withColumn("speaker", (F.col("speaker").cast("long") % 2).cast("string"))


HALVES = f"""WITH {SPEECH}, halves AS (SELECT clip, side, (speaker::BIGINT % 2)::VARCHAR AS speaker, s, e FROM speech), {merged(0, "halves")}"""
PAIRS = """
o AS (SELECT r.clip, r.speaker AS reference, h.speaker AS hypothesis, sum(least(r.e, h.e) - greatest(r.s, h.s))::BIGINT AS t FROM u r JOIN u h ON r.clip = h.clip AND r.side = 0 AND h.side = 1 AND r.s < h.e AND h.s < r.e GROUP BY ALL),
d AS (SELECT clip, side, speaker, sum(e - s) AS t FROM u GROUP BY ALL)"""


@query(f"""{HALVES}, {PAIRS},
b AS (SELECT DISTINCT clip, unnest([s, e]) AS t FROM u),
a AS (SELECT clip, t AS t0, lead(t) OVER (PARTITION BY clip ORDER BY t) AS t1 FROM b),
n AS (SELECT a.clip, t1 - t0 AS w, count(*) FILTER (WHERE side = 0) AS r, count(*) FILTER (WHERE side = 1) AS h FROM a JOIN u ON u.clip = a.clip AND u.s <= t0 AND t0 < u.e WHERE t1 IS NOT NULL GROUP BY a.clip, t0, t1),
z AS (SELECT clip, sum(w * greatest(0, r - h)) AS missed, sum(w * greatest(0, h - r)) AS false_alarm, sum(w * least(r, h)) AS common, sum(w * r) AS denominator FROM n GROUP BY clip),
best AS (SELECT clip, greatest(coalesce(sum(t) FILTER (WHERE reference = hypothesis), 0), coalesce(sum(t) FILTER (WHERE reference <> hypothesis), 0)) AS best FROM o GROUP BY clip)
SELECT z.clip, missed::BIGINT AS missed, false_alarm::BIGINT AS false_alarm, (common - coalesce(best, 0))::BIGINT AS confusion, denominator::BIGINT AS denominator FROM z LEFT JOIN best ON z.clip = best.clip
""")
def der_two_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diarization errors of every clip, users taken for two speakers."""
    return in_ms(intervals.der(halves(spark, sf_dir)).select("clip", "missed", "false_alarm", "confusion", "denominator"), "missed", "false_alarm", "confusion", "denominator")


@query(f"""{HALVES}, {PAIRS},
c AS (SELECT o.clip, reference, hypothesis, o.t::DOUBLE / (r.t + h.t - o.t) AS gain FROM o
  JOIN d r ON r.clip = o.clip AND r.side = 0 AND r.speaker = reference JOIN d h ON h.clip = o.clip AND h.side = 1 AND h.speaker = hypothesis),
best AS (SELECT clip, greatest(coalesce(sum(gain) FILTER (WHERE reference = hypothesis), 0), coalesce(sum(gain) FILTER (WHERE reference <> hypothesis), 0)) AS best FROM c GROUP BY clip),
k AS (SELECT clip, count(DISTINCT speaker) FILTER (WHERE side = 0) AS n FROM u GROUP BY clip)
SELECT k.clip, round(n - coalesce(best, 0), 6) AS error_sum, n AS reference_speakers FROM k LEFT JOIN best ON best.clip = k.clip
""")
def jer_two_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard errors of every clip, users taken for two speakers."""
    return intervals.jer(halves(spark, sf_dir)).select("clip", F.round("error_sum", 6).alias("error_sum"), "reference_speakers")


@query(f"""WITH {SPEECH} SELECT clip, side, speaker, greatest(0, s)::BIGINT AS start, least(43200000, e)::BIGINT AS "end" FROM speech WHERE least(43200000, e) > greatest(0, s)""")
def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech of each day's first half."""
    return milliseconds(intervals.clipped(speech(spark, sf_dir), 43_200.0))


@query("""SELECT event_id, coalesce(event_type <> 'click' AND isfinite(value) AND value >= 0 AND value * 2 - 40 >= value, false) AS ok FROM events""")
def valid_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what events stand for is a segment: clicks have no speaker, some times are negative or reversed."""
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", " ").otherwise(F.col("event_type")).alias("speaker"), F.col("value").alias("start"), (F.col("value") * 2 - 40).alias("end"))
    return events.select("event_id", intervals.valid().alias("ok"))


def components(collar: int) -> str:
    masks = f"k AS (SELECT clip, x - {collar} AS a, x + {collar} AS b FROM (SELECT clip, unnest([s, e]) AS x FROM u WHERE side = 0))," if collar else ""
    more = "UNION SELECT clip, unnest([a, b]) FROM k" if collar else ""
    open_ = "AND NOT EXISTS (SELECT 1 FROM k WHERE k.clip = a.clip AND k.a <= a.t0 AND a.t0 < k.b)" if collar else ""
    return f"""
WITH {SPEECH}, {merged(0)}, {masks}
b AS (SELECT clip, unnest([s, e]) AS t FROM u {more}),
a AS (SELECT clip, t AS t0, lead(t) OVER (PARTITION BY clip ORDER BY t) AS t1 FROM (SELECT DISTINCT clip, t FROM b)),
n AS (SELECT a.clip, a.t0, a.t1, count(*) FILTER (WHERE u.side = 0) AS r, count(*) FILTER (WHERE u.side = 1) AS h
  FROM a JOIN u ON u.clip = a.clip AND u.s <= a.t0 AND a.t0 < u.e WHERE a.t1 IS NOT NULL {open_} GROUP BY ALL),
z AS (SELECT clip, sum((t1 - t0) * greatest(0, r - h)) AS missed, sum((t1 - t0) * greatest(0, h - r)) AS false_alarm, sum((t1 - t0) * least(r, h)) AS common, sum((t1 - t0) * r) AS reference FROM n GROUP BY clip)
SELECT c.clip, coalesce(missed, 0)::BIGINT AS missed, coalesce(false_alarm, 0)::BIGINT AS false_alarm, coalesce(common, 0)::BIGINT AS common, coalesce(reference, 0)::BIGINT AS reference
FROM (SELECT DISTINCT clip FROM speech) c LEFT JOIN z ON c.clip = z.clip"""


def in_ms(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) * 1000).cast("long") for c in columns})


@query(components(0))
def sweep_der_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missed, false alarm, common and reference speaker time of every clip."""
    return in_ms(intervals.der_parts(speech(spark, sf_dir)), "missed", "false_alarm", "common", "reference")


@query(components(250))
def sweep_der_components_collar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with 0.25 s around reference boundaries left out."""
    return in_ms(intervals.der_parts(speech(spark, sf_dir), 0.25), "missed", "false_alarm", "common", "reference")


MATRIX = "o AS (SELECT r.clip, r.speaker AS reference, h.speaker AS hypothesis, sum(least(r.e, h.e) - greatest(r.s, h.s))::BIGINT AS seconds FROM u r JOIN u h ON r.clip = h.clip AND r.side = 0 AND h.side = 1 AND r.s < h.e AND h.s < r.e GROUP BY ALL)"


@query(f"WITH {SPEECH}, {merged(0)}, {MATRIX} SELECT * FROM o")
def speaker_overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time together of every reference and hypothesis speaker."""
    return in_ms(intervals.overlaps(intervals.canonical_union(speech(spark, sf_dir))), "seconds")


@query(f"""WITH {SPEECH}, {merged(0)}, {MATRIX}, d AS (SELECT clip, side, speaker, sum(e - s) AS t FROM u GROUP BY ALL)
SELECT o.clip, o.reference, o.hypothesis, round(1 - o.seconds::DOUBLE / (r.t + h.t - o.seconds), 9) AS cost FROM o
JOIN d r ON r.clip = o.clip AND r.side = 0 AND r.speaker = o.reference JOIN d h ON h.clip = o.clip AND h.side = 1 AND h.speaker = o.hypothesis""")
def jer_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard errors of the pairs of speakers that meet."""
    found = intervals.jaccard(intervals.canonical_union(speech(spark, sf_dir)))
    return found.withColumn("cost", F.round("cost", 9))


@query()
def der_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diarization error rate of every clip under the best assignment of speakers."""
    return intervals.der(speech(spark, sf_dir), 0.25).select("clip", *(F.round(c, 6).alias(c) for c in ("missed", "false_alarm", "confusion", "numerator", "denominator", "value")))


@query()
def jer_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard error rate of every clip."""
    return intervals.jer(speech(spark, sf_dir)).withColumns({"error_sum": F.round("error_sum", 9), "value": F.round("value", 9)})


@query(f"""WITH {SPEECH}, n AS (SELECT clip, count(DISTINCT speaker) FILTER (WHERE side = 0 AND e > s) AS r, count(DISTINCT speaker) FILTER (WHERE side = 1 AND e > s) AS h FROM speech GROUP BY clip)
SELECT clip, r AS reference_speakers, h AS hypothesis_speakers, r = h AS correct, abs(r - h) AS absolute_error FROM n""")
def speaker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact speaker counts and their error."""
    return intervals.speaker_count(speech(spark, sf_dir))


@query()
def cp_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permuted error rates of successive conversations, roles as speakers."""
    said = scoring.speaker_text(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")
    maps = said.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "text"))).alias("reference"))
    nxt = maps.select((F.col("conv_id") - 1).alias("conv_id"), F.col("reference").alias("hypothesis"))
    scored = scoring.score_speakers(maps.join(nxt, "conv_id").withColumn("language", F.lit("fr")))
    return scored.select("conv_id", "metric", "numerator", "denominator", "value")


# Texts by speaker, turns


@query("""SELECT conv_id, role AS speaker, string_agg(trim(text, ' '), ' ' ORDER BY turn) AS text FROM conversations WHERE trim(text, ' ') <> '' GROUP BY ALL""")
def speaker_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each role says, in order."""
    return scoring.speaker_text(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role").withColumnRenamed("role", "speaker")


@query("""SELECT conv_id, string_agg(trim(text, ' '), ' ' ORDER BY turn) AS text FROM conversations WHERE trim(text, ' ') <> '' GROUP BY conv_id""")
def mixed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is said, in order."""
    return scoring.mixed_text(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"])


@query("""WITH a AS (SELECT user_id, event_type, epoch_us(ts) AS us, event_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS c FROM events),
b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS turn FROM a)
SELECT user_id, turn, event_type, min(us)::BIGINT AS first, max(us)::BIGINT AS last, count(*) AS rows FROM b GROUP BY user_id, turn, event_type""")
def speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type by user."""
    events = table(spark, sf_dir, "events").withColumn("at", F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id"))
    runs = intervals.turns(events, ["user_id"], "at", "event_type")
    return runs.select("user_id", "turn", "event_type", F.col("first.us").alias("first"), F.col("last.us").alias("last"), "rows")


# Selection, sharding, resuming


@query("""SELECT doc_id, lang, (('0x' || substr(sha256(doc_id::VARCHAR || chr(0) || lang), 1, 16))::UBIGINT % 7)::INT AS shard FROM documents""")
def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every (document, language) task."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", text.shard_of(F.col("doc_id").cast("string"), F.col("lang"), 7).alias("shard"))


@query("""WITH t AS (SELECT p_partkey::VARCHAR AS sample_id, unnest(CASE WHEN p_partkey % 3 = 0 THEN ['ch1'] ELSE ['ch1', 'ch2', 'mono'] END) AS channel FROM part)
SELECT sample_id, channel FROM t WHERE (('0x' || substr(sha256(sample_id || chr(0) || channel), 1, 16))::UBIGINT % 4) = 1""")
def shard_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of one shard; mono where both channels are."""
    part = table(spark, sf_dir, "part")
    channels = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("ch1"))).otherwise(F.array(F.lit("ch1"), F.lit("ch2")))
    return scoring.tasks(part.select(F.col("p_partkey").cast("string").alias("sample_id"), channels.alias("channels")), ["ch1", "ch2", "mono"], shard=1, shards=4)


@query("""SELECT d.doc_id, d.lang FROM documents d WHERE d.lang IN ('fr', 'de') AND d.doc_id IN (SELECT doc_id FROM labels)""")
def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents of two languages."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("language"))
    languages = ["fr", "DE"]
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"))
    ids = labelled.join(scoring.select_clips(docs, languages=languages), "sample_id", "left_semi")
    chosen = scoring.select_clips(docs, languages=languages, ids=ids)
    return chosen.select(F.col("sample_id").alias("doc_id"), F.col("language").alias("lang"))


@query("""SELECT DISTINCT o_custkey AS c FROM orders WHERE o_custkey NOT IN (SELECT l_suppkey FROM lineitem)""")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids asked for that aren't there."""
    asked, there = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c")), table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("c"))
    return scoring.missing_ids(asked, there, "c")


@query("""SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur more than once."""
    return scoring.duplicates(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("""SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')""")
def resume_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks without a result yet."""
    todo = table(spark, sf_dir, "orders").select("o_orderkey")
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return scoring.remaining(todo, done, ["o_orderkey"])


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, l.doc_id IS NULL AS missing, d.doc_id IS NULL AS extra FROM documents d FULL JOIN (SELECT doc_id * 2 AS doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR d.doc_id IS NULL""")
def expected_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is missing from, and what is extra in, a set of ids."""
    expected, returned = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("doc_id"))
    side = lambda a, b, missing: scoring.missing_ids(a, b, "doc_id").select("doc_id", F.lit(missing).alias("missing"), F.lit(not missing).alias("extra"))
    return side(expected, returned, True).union(side(returned, expected, False))


# Languages, clean-up, digests


def _cases(values: dict[str, str]) -> str:
    return "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


@query(f"SELECT lang, {_cases(PUBLIC_METRIC)} AS public_metric, {_cases(SOURCE_METRIC)} AS source_metric, count(*) AS n FROM documents GROUP BY lang")
def lang_metric_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every language."""
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.select("lang", public_metric(F.col("lang")).alias("public_metric"), source_metric(F.col("lang")).alias("source_metric"), "n")


@query("""SELECT doc_id, nullif(split_part(replace(lower(trim(' ' || upper(lang) || '_' || source || ' ')), '_', '-'), '-', 1), '') AS code FROM documents""")
def canonical_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary subtags."""
    tag = F.concat(F.lit(" "), F.upper("lang"), F.lit("_"), F.col("source"), F.lit(" "))
    return table(spark, sf_dir, "documents").select("doc_id", canonical_language(tag).alias("code"))


COLLAPSE = "trim(regexp_replace({}, '\\s+', ' ', 'g'), ' ')"
TAGS = "regexp_replace(regexp_replace({}, '\\[[^\\[\\]]{{0,80}}\\]', ' ', 'g'), '</?[^<>]{{0,120}}>', ' ', 'g')"


@query("SELECT page_id, md5(" + COLLAPSE.format(TAGS.format("html")) + ") AS digest, length(" + COLLAPSE.format(TAGS.format("html")) + ") AS n FROM pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without tags."""
    pages = table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("t"))
    return pages.select("page_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("long").alias("n"))


def _unparenthesized(t: str) -> str:
    """SQL of as many passes as the tables' texts need; the query itself has no limit."""
    for _ in range(4):
        t = f"regexp_replace({t}, '\\([^()]*\\)', ' ', 'g')"
    return f"translate({t}, '()', '  ')"


_BRACES = "regexp_replace(regexp_replace({}, '\\{{[^{{}}]*\\p{{L}}[^{{}}]*\\}}', ' ', 'g'), '\\{{([^{{}}]{{0,200}})\\}}', ' \\1 ', 'g')"


@query("SELECT doc_id, md5(" + COLLAPSE.format(TAGS.format(_BRACES.format(_unparenthesized("text")))) + ") AS digest FROM documents")
def strip_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without braces, tags and parentheses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.strip_annotations(text.strip_parentheses(F.col("text"))).alias("t"))
    return docs.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"))


def _redacted() -> str:
    out = "text"
    for pattern, put in text.REDACTIONS:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{put.replace('$1', chr(92) + '1')}', 'g')"
    return out


@query(f"SELECT doc_id, md5({_redacted()}) AS digest, {_redacted()} <> text AS changed FROM documents")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without what looks like credentials."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", text.redact(F.col("text")).alias("t"))
    return docs.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), (F.col("t") != F.col("text")).alias("changed"))


@query()
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents normalized by their language, with the normalizer's name."""
    docs = normalize.with_metadata(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "text", "lang")
    return docs.select("doc_id", "normalized.language", "normalized.normalizer", F.md5(F.col("normalized.text").cast("binary")).alias("digest"))


@query("""SELECT lang, sha256('[' || string_agg('"' || doc_id || '"', ',' ORDER BY '"' || doc_id || '"') || ']') AS digest FROM documents GROUP BY lang""")
def clip_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each language's sorted ids."""
    ids = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").cast("string").alias("doc_id"))
    return scoring.ids_digests(ids, "lang", "doc_id")


@query("""SELECT role, count(*) AS tasks, count(DISTINCT conv_id) AS clips, sum(length(text))::BIGINT AS chars, min(turn) AS first_turn FROM conversations GROUP BY role""")
def preflight_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals before a run."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("tasks"), F.count_distinct("conv_id").alias("clips"), F.sum(F.length("text")).alias("chars"), F.min("turn").alias("first_turn"))


@query("""SELECT lang, doc_id FROM documents ORDER BY lang, doc_id LIMIT 25""")
def first_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 in order of (language, id): the limit is the operator."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("language"), F.col("doc_id").alias("sample_id"))
    return scoring.select_clips(docs, limit=25).select(F.col("language").alias("lang"), F.col("sample_id").alias("doc_id"))


@query("""SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT item_id + 1000000000 FROM benchmark""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection of id sets, united with another table's."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return docs.intersect(labels).unionByName(table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("doc_id")))
