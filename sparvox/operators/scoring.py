"""Lexical scoring of records and its aggregates.

A scoring record has reference, hypothesis and language, and whatever else. Row work is a projection (normalisation in one Arrow UDF for
each distinct text, edits in another); the only shuffles are the group-bys.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparvox.functions import kernels, normalize, text
from sparvox.functions.languages import canonical_language, metric_for, public_metric
from sparvox.runtime import workers_see_package

COUNTS = ("substitutions", "deletions", "insertions", "hits")
LINEAGE = ("metric", "language", "source_metric", "unit", "profile", "normalizer", "policy", "tie_break", "scorer")
IDENTITY = ("model", "model_version", "channel_config")
TIE_BREAK = "hit-or-substitution, deletion, insertion; from the end"
UNITS = {"wer": "word", "cer": "character", "ser": "syllable"}


def required(records: DataFrame) -> None:
    """Raises unless reference, hypothesis and language are there as strings."""
    kinds = dict(records.dtypes)
    for name in ("reference", "hypothesis", "language"):
        if name not in kinds:
            raise ValueError(f"scoring records need a column {name!r}")
        if kinds[name] != "string":
            raise TypeError(f"column {name!r} must be a string, not {kinds[name]}")


def totals() -> tuple[Column, Column]:
    """numerator and denominator of the count columns."""
    return reduce(Column.__add__, (F.col(c) for c in COUNTS[:3])), F.col("hits") + F.col("substitutions") + F.col("deletions")


def rated(df: DataFrame) -> DataFrame:
    """df with numerator, denominator and value."""
    n, d = totals()
    df = df.withColumn("numerator", n).withColumn("denominator", d)
    return df.withColumn("value", text.rate(F.col("numerator"), F.col("denominator")))


def score_records(records: DataFrame, *, metric: str = "auto", profile: str = "benchmark") -> DataFrame:
    """records with their lineage, normalized texts, edit counts, numerator, denominator and value. A null text or language raises."""
    required(records)
    workers_see_package(records.sparkSession)
    there = F.when(F.col("reference").isNotNull() & F.col("hypothesis").isNotNull() & F.col("language").isNotNull(), True)
    ok = records.where(there.otherwise(F.raise_error(F.lit("a scoring record lacks reference, hypothesis or language")).cast("boolean")))
    code = canonical_language(F.col("language"))
    source = metric_for(F.col("language"), metric)
    public = F.when(source == "ser", F.lit("wer")).otherwise(source) if metric != "auto" else F.coalesce(public_metric(F.col("language")), F.lit("wer"))
    units = F.create_map(*(F.lit(x) for p in UNITS.items() for x in p))
    table = kernels.WHISPER if kernels.canonical_profile(profile) == "whisper_baseline" else kernels.BENCHMARK
    keys = F.create_map(*(F.lit(x) for p in table.items() for x in p))
    done = ok.withColumns(
        {
            "reference_normalized": normalize.normalized(F.col("reference"), F.col("language"), profile),
            "hypothesis_normalized": normalize.normalized(F.col("hypothesis"), F.col("language"), profile),
            "metric": public, "source_metric": source, "unit": F.element_at(units, source), "profile": F.lit(profile),
            "normalizer": F.coalesce(F.try_element_at(keys, F.coalesce(code, F.lit(""))), F.lit("whisper_basic")),
            "policy": F.lit(kernels.POLICY), "tie_break": F.lit(TIE_BREAK), "scorer": F.lit("sparvox-levenshtein-1"),
        }
    )
    edits = normalize.edit_counts(text.tokens(F.col("reference_normalized"), F.col("source_metric")), text.tokens(F.col("hypothesis_normalized"), F.col("source_metric")))
    done = done.withColumn("language", F.coalesce(code, F.col("language"))).withColumn("counts", edits)
    return rated(done.select("*", *(F.col(f"counts.{c}").alias(c) for c in COUNTS)).drop("counts"))


def score_pair(spark, reference: str, hypothesis: str, *, language: str | None, metric: str = "auto", profile: str = "benchmark") -> dict:
    """One pair's scores as a dict, on the driver."""
    from sparvox.functions.languages import resolve_metric

    code, public, source = resolve_metric(language, metric)
    r, h = (kernels.normalize(x, language, profile) for x in (reference, hypothesis))
    counts = dict(zip(COUNTS, kernels.edit_counts(kernels.tokens(r, source), kernels.tokens(h, source))))
    n, d = sum(counts[c] for c in COUNTS[:3]), counts["hits"] + counts["substitutions"] + counts["deletions"]
    value = n / d if d else float(n > 0)
    return {"metric": public, "source_metric": source, "unit": UNITS[source], "language": code, "profile": profile, "normalizer": kernels.key_for(language, profile), **counts, "numerator": n, "denominator": d, "value": value}


def distances(records: DataFrame, reference: Column, hypothesis: Column) -> DataFrame:
    """records with numerator (token edits) and denominator (reference tokens), for rates that need no split by kind.

    Bit-parallel in Arrow batches: a pair of n and m tokens takes n * m / 64 steps, where the JVM's levenshtein over letters for tokens
    (text.token_distance, for short sequences) takes n * m and the letters' look-up as many again.
    """
    return records.withColumn("numerator", normalize.token_distance(reference, hypothesis)).withColumn("denominator", F.size(reference).cast("long"))


def _sort_key(columns: list[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]


def aggregate_scores(scores: DataFrame, by: tuple[str, ...] = LINEAGE) -> DataFrame:
    """Micro-average by lineage: items, summed counts, numerator, denominator, value; in order of the keys as strings."""
    keys = [c for c in by if c in scores.columns]
    sums = scores.groupBy(*keys).agg(F.count("*").alias("items"), *(F.sum(c).alias(c) for c in COUNTS))
    return rated(sums).orderBy(*_sort_key(keys))


def dimension(df: DataFrame, name: str) -> Column:
    """A dimension's grouping key: its kind and value, so that true, 1 and '1' are three keys and 1 equals 1.0. Nested values, NaN and infinity raise."""
    kind = dict(df.dtypes)[name]
    value = F.col(name)
    if kind.startswith(("array", "map", "struct")):
        raise TypeError(f"dimension {name!r} must be scalar, not {kind}")
    if kind in ("double", "float"):
        bad = F.isnan(value) | (F.abs(value) == float("inf"))
        value = F.when(bad, F.raise_error(F.lit(f"dimension {name} must be finite")).cast("double")).otherwise(value)
    tag = "string" if kind == "string" else "bool" if kind == "boolean" else "null" if kind == "void" else "number"
    shown = value.cast("double").cast("string") if tag == "number" else value.cast("string")
    return F.struct(F.when(F.col(name).isNull(), F.lit("null")).otherwise(F.lit(tag)).alias("kind"), shown.alias("value"))


def aggregate_records(scores: DataFrame, dims: tuple[str, ...] = (), lineage: tuple[str, ...] = LINEAGE) -> DataFrame:
    """Micro-average by identity columns (those that exist), requested dims and lineage. dims are nested under dimensions."""
    missing = [d for d in dims if d not in scores.columns]
    if missing:
        raise ValueError(f"no such dimension: {missing}")
    wanted = [*(c for c in IDENTITY if c in scores.columns and c not in dims), *dims]
    keyed = scores.withColumns({f"__d{i}": dimension(scores, c) for i, c in enumerate(wanted)})
    keys = [*(f"__d{i}" for i in range(len(wanted))), *(c for c in lineage if c in scores.columns)]
    firsts = [F.first(c).alias(f"__v{i}") for i, c in enumerate(wanted)]
    sums = keyed.groupBy(*keys).agg(F.count("*").alias("items"), *firsts, *(F.sum(c).alias(c) for c in COUNTS))
    out = rated(sums).orderBy(*_sort_key(keys))
    if wanted:
        out = out.withColumn("dimensions", F.struct(*(F.col(f"__v{i}").alias(c) for i, c in enumerate(wanted))))
    return out.drop(*(f"__{k}{i}" for k in "dv" for i in range(len(wanted))))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def ids_digests(rows: DataFrame, key: str, identity: str) -> DataFrame:
    """key, digest: text.ids_digest of each group's ids, for groups of any size.

    Ids are sorted by range, and each batch of sorted ids goes on as one compressed piece of the JSON array, so what meets in a group's
    task is the text that its hash reads, a piece at a time.
    """
    spoken = rows.where(F.col(identity).isNotNull()).select(key, F.col(identity).alias("id"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = T.StructField(key, rows.schema[key].dataType)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparvox.operators.intervals import stretches

        n, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for _, a, b in stretches(batch, [key]) if batch.num_rows else ():
                data = zlib.compress(",".join(batch.column("json").slice(a, b - a).to_pylist()).encode(), 1)
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(a, 1), pa.array([task]), pa.array([n]), pa.array([data])], [key, "task", "n", "data"])
                n += 1

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = now = None

        def ended() -> pa.RecordBatch:
            held[0].update(b"]")
            return pa.RecordBatch.from_arrays([held[1], pa.array([held[0].hexdigest()])], [key, "digest"])

        for batch in batches:
            for i, data in enumerate(batch.column("data")):
                if held is None or batch.column(key)[i].as_py() != now:
                    if held:
                        yield ended()
                    held, now = (hashlib.sha256(b"["), batch.column(key).slice(i, 1)), batch.column(key)[i].as_py()
                else:
                    held[0].update(b",")
                held[0].update(zlib.decompress(data.as_py()))
        if held:
            yield ended()

    json = F.to_json(F.array("id"))
    ranges = spoken.repartitionByRange(tasks, key, "id").sortWithinPartitions(key, "id").select(key, F.substr(json, F.lit(2), F.length(json) - 2).alias("json"))
    parts = ranges.mapInArrow(pieces, T.StructType([own, T.StructField("task", T.LongType()), T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType())]))
    return parts.repartition(tasks, key).sortWithinPartitions(key, "task", "n").mapInArrow(hashed, T.StructType([own, T.StructField("digest", T.StringType())]))


def pool(scores: DataFrame, models: DataFrame, cohort: str = "matched") -> DataFrame:
    """model, n_clips, available_clips, numerator, denominator, value, clips_sha256 for every model of the roster.

    scores: (sample_id, model, numerator, denominator) of one run, language, condition and metric. matched keeps the clips that all models
    of the roster have; a model without any empties that cohort. Sums are of decimals, so the order of rows doesn't matter.
    """
    if cohort not in ("matched", "available"):
        raise ValueError("cohort is matched or available")
    roster = models.select("model").distinct()
    own = scores.join(roster, "model", "left_semi")
    ids = there = own.select("model", "sample_id").distinct()
    size = F.broadcast(roster.agg(F.count("*").alias("roster")))  # one row
    if cohort == "matched":
        full = there.where("sample_id IS NOT NULL").groupBy("sample_id").agg(F.count("*").alias("models")).crossJoin(size).where("models = roster").select("sample_id")
        own, ids = own.join(full, "sample_id", "left_semi"), there.join(full, "sample_id", "left_semi")
    clips = lambda x, name: x.groupBy("model").agg(F.count("sample_id").alias(name))
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,6)")).cast("double")
    sums = own.groupBy("model").agg(exact("numerator").alias("numerator"), exact("denominator").alias("denominator"))
    digests = ids_digests(ids.withColumn("sample_id", F.col("sample_id").cast("string")), "model", "sample_id").withColumnRenamed("digest", "clips_sha256")
    out = roster
    for part in (clips(there, "available_clips"), clips(ids, "n_clips"), sums, digests):
        out = out.join(part, "model", "left")
    out = out.fillna(0, ["available_clips", "n_clips"]).fillna(0.0, ["numerator", "denominator"])
    none = F.sha2(F.lit("[]"), 256)
    return out.select("model", "n_clips", "available_clips", "numerator", "denominator", F.when(F.col("denominator") != 0, F.col("numerator") / F.col("denominator")).alias("value"), F.coalesce("clips_sha256", none).alias("clips_sha256"))


def combine_channels(rows: DataFrame, channels: int = 2) -> DataFrame:
    """sample_id, model, metric, numerator, denominator, value (null without length) of pairs that have the metric on all channels.

    rows: (sample_id, model, channel, metric, numerator, denominator), each once.
    """
    both = rows.groupBy("sample_id", "model", "metric").agg(F.count_distinct("channel").alias("n"), F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    both = both.where(F.col("n") == channels).drop("n")
    return both.withColumn("value", F.when(F.col("denominator") != 0, F.col("numerator") / F.col("denominator")))


def speaker_text(segments: DataFrame, keys: list[str], order: list[str], speaker: str = "speaker", said: str = "text") -> DataFrame:
    """keys, speaker, text: each speaker's segments in order, joined by spaces; blank ones are left out."""
    spoken = segments.where(F.trim(said) != "")
    parts = F.array_sort(F.collect_list(F.struct(*order, F.trim(said).alias("said"))))
    return spoken.groupBy(*keys, speaker).agg(F.array_join(F.transform(parts, lambda p: p["said"]), " ").alias("text"))


def mixed_text(segments: DataFrame, keys: list[str], order: list[str], said: str = "text") -> DataFrame:
    """keys, text: all speakers' segments in order."""
    spoken = segments.where(F.trim(said) != "")
    parts = F.array_sort(F.collect_list(F.struct(*order, F.trim(said).alias("said"))))
    return spoken.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["said"]), " ").alias("text"))


def permuted(reference: dict[str, list], hypothesis: dict[str, list]) -> tuple[tuple[int, int, int, int], list[tuple[str | None, str | None]]]:
    """Counts and pairs of the assignment of speakers with the fewest edits; the shorter side is filled up with silence."""
    rows, columns = sorted(reference), sorted(hypothesis)
    size = max(len(rows), len(columns))
    if not size:
        return (0, 0, 0, 0), []
    names = lambda x: [*x, *[None] * (size - len(x))]
    said = lambda side, name: side.get(name, [])
    # The choice needs edits only; their kinds are counted for the pairs that are chosen.
    pairs = kernels.assign([[kernels.distance(said(reference, r), said(hypothesis, h)) for h in names(columns)] for r in names(rows)])
    chosen = [(names(rows)[i], names(columns)[j]) for i, j in pairs]
    counts = tuple(map(sum, zip(*(kernels.edit_counts(said(reference, r), said(hypothesis, h)) for r, h in chosen))))
    return counts, chosen


def score_speakers(clips: DataFrame, *, metric: str = "auto", profile: str = "benchmark") -> DataFrame:
    """clips (reference and hypothesis: map<string,string>, language) with permuted edit counts, assignment and rates: cpwer, cpcer, cpser."""
    workers_see_package(clips.sparkSession)
    kernels.canonical_profile(profile)

    def run(references: pa.Array, hypotheses: pa.Array, tags: pa.Array) -> pa.Array:
        from sparvox.functions import kernels
        from sparvox.functions.languages import resolve_metric
        from sparvox.operators.scoring import permuted

        def one(r: list | None, h: list | None, tag: str | None) -> dict:
            _, public, source = resolve_metric(tag, metric)
            sides = []
            for said in (r, h):
                if any(not name or words is None for name, words in said or ()):
                    raise ValueError("speakers need labels and texts")
                sides.append({name: kernels.tokens(kernels.normalize(words, tag, profile), source) for name, words in said or ()})
            counts, pairs = permuted(*sides)
            return {"metric": f"cp{source}", **dict(zip(COUNTS, counts)), "assignment": [{"reference": a, "hypothesis": b} for a, b in pairs]}

        kind = pa.struct([("metric", pa.string()), *((c, pa.int64()) for c in COUNTS), ("assignment", pa.list_(pa.struct([("reference", pa.string()), ("hypothesis", pa.string())])))])
        return normalize.mapped(one, kind, references, hypotheses, tags)

    kind = f"struct<metric:string,{','.join(f'{c}:long' for c in COUNTS)},assignment:array<struct<reference:string,hypothesis:string>>>"
    scored = clips.withColumn("__cp", F.arrow_udf(run, kind)("reference", "hypothesis", "language"))
    return rated(scored.select(*clips.columns, "__cp.*"))


def select_clips(clips: DataFrame, *, languages: list[str] | None = None, ids: DataFrame | None = None, limit: int | None = None, order: tuple[str, ...] = ("language", "sample_id")) -> DataFrame:
    """Clips of the languages and ids, the first limit of them in order. An id that isn't there after the language filter raises."""
    out = clips
    if languages:
        wanted = [x.replace("_", "-").lower() for x in languages]
        out = out.where(F.lower(F.replace("language", F.lit("_"), F.lit("-"))).isin(*wanted))
    if ids is not None:
        missing = missing_ids(ids, out).limit(5).collect()
        if missing:
            raise ValueError(f"ids not found: {', '.join(str(r[0]) for r in missing)}")
        out = out.join(ids.select("sample_id").distinct(), "sample_id", "left_semi")
    return out if limit is None else out.orderBy(*order).limit(limit)


def missing_ids(wanted: DataFrame, clips: DataFrame, key: str = "sample_id") -> DataFrame:
    return wanted.select(key).distinct().join(clips, key, "left_anti")


def tasks(clips: DataFrame, channels: list[str], *, shard: int = 0, shards: int = 1) -> DataFrame:
    """(sample_id, channel) of one shard: mono is there where ch1 and ch2 are."""
    if not 0 <= shard < shards:
        raise ValueError("shard must be from 0 to shards - 1")
    own = F.col("channels")
    dual = F.array_contains(own, "ch1") & F.array_contains(own, "ch2")
    offered = F.when(dual, F.array_union(own, F.array(F.lit("mono")))).otherwise(own)
    asked = F.array(*map(F.lit, channels))
    each = clips.select("sample_id", F.explode(F.array_intersect(asked, offered)).alias("channel"))
    return each if shards == 1 else each.where(text.shard_of(F.col("sample_id"), F.col("channel"), shards) == shard)


def remaining(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a result yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def latest_run(scores: DataFrame, order: Column) -> DataFrame:
    """One row for each (sample_id, model): the latest."""
    w = Window.partitionBy("sample_id", "model").orderBy(order.desc())
    return scores.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
