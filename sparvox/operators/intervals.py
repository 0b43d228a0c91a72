"""Interval algebra over (clip, side, speaker, start, end): unions, merges, clipping, the exact sweep and its scores.

Timelines are long tables. The time that speakers share is summed in streams of Arrow batches, where all intervals of a reference speaker are,
so pairs are never shuffled; an assignment takes its clip's intervals (not its pairs) into one task. side is 0 for the reference and 1 for the hypothesis. Start and end are in seconds, half open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-12
GAP = 0.2


def valid(speaker: str = "speaker", start: str = "start", end: str = "end") -> Column:
    """Whether a segment has a speaker and finite, ordered times from 0 on; never null."""
    finite = [~F.isnan(c) & (F.abs(F.col(c)) != float("inf")) for c in (start, end)]
    whole = F.col(speaker).isNotNull() & (F.trim(speaker) != "") & finite[0] & finite[1]
    return F.coalesce(whole & (F.col(start) >= 0) & (F.col(end) >= F.col(start)), F.lit(False))


def checked(segments: DataFrame) -> DataFrame:
    """segments; reading an invalid one raises."""
    return segments.where(F.when(valid(), True).otherwise(F.raise_error(F.lit("invalid diarization segment")).cast("boolean")))


def islands(segments: DataFrame, keys: list[str], apart: Column) -> DataFrame:
    """Merges each key's segments up to where apart holds: it compares start with reached, the furthest end so far."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reached = segments.withColumn("reached", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    first = F.when(F.col("reached").isNull() | apart, 1).otherwise(0)
    numbered = reached.withColumn("island", F.sum(first).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


KEYS = ["clip", "side", "speaker"]


def canonical_union(segments: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Union of touching and overlapping speech; empty segments go."""
    return islands(segments.where("end > start"), keys, F.col("start") > F.col("reached"))


def gap_merge(segments: DataFrame, keys: list[str] = KEYS, gap: float = GAP) -> DataFrame:
    """Union over gaps of up to gap; an empty or reversed segment raises."""
    proper = F.when(F.col("end") > F.col("start"), True).otherwise(F.raise_error(F.lit("segment of no length")).cast("boolean"))
    return islands(segments.where(proper), keys, F.col("start") > F.col("reached") + gap + EPSILON)


def word_activity(words: DataFrame, keys: list[str] = KEYS, gap: float = GAP, *, skip_reversed: bool = False) -> DataFrame:
    """Activity from word times: gaps compared as differences; empty words are skipped, reversed ones raise unless skipped."""
    if skip_reversed:
        words = words.where("end > start")
    else:
        words = words.where(F.when(F.col("end") < F.col("start"), F.raise_error(F.lit("reversed word")).cast("boolean")).otherwise(F.col("end") > F.col("start")))
    return islands(words, keys, F.col("start") - F.col("reached") > gap + EPSILON)


def clipped(segments: DataFrame, duration: Column | float) -> DataFrame:
    """Segments within [0, duration); what falls outside goes."""
    limit = duration if isinstance(duration, Column) else F.lit(float(duration))
    inside = segments.withColumn("start", F.greatest(F.lit(0.0), "start")).withColumn("end", F.least(limit, "end"))
    return inside.where("end > start")


def turns(words: DataFrame, keys: list[str], order: str, speaker: str = "speaker") -> DataFrame:
    """Runs of consecutive rows with one speaker: turn (from 1), speaker, first and last order, rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(F.lag(speaker).over(w).eqNullSafe(F.col(speaker)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = words.withColumn("turn", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "turn", speaker).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows"))


def sweep(timelines: DataFrame, collar: float = 0.0) -> DataFrame:
    """clip, t0, t1, r, h: atomic intervals of unions, with the speakers active on each side; masked and silent ones are left out.

    Running sums of +1 and -1 at the boundaries, one shuffle by clip and no range join. A collar masks both sides of every
    reference boundary.
    """
    if isinstance(collar, bool) or not math.isfinite(collar) or collar < 0:
        raise ValueError("the collar must be finite and not negative")
    ends = F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d"))))
    edges = timelines.select("clip", "side", ends.alias("e")).select("clip", "e.t", F.when(F.col("side") == 0, F.col("e.d")).otherwise(0).alias("r"), F.when(F.col("side") == 1, F.col("e.d")).otherwise(0).alias("h"), F.lit(0).alias("k"))
    if collar:
        both = F.array("start", "end")
        at = timelines.where("side = 0").select("clip", F.explode(both).alias("x"))
        masks = at.select("clip", F.explode(F.array(F.struct((F.col("x") - collar).alias("t"), F.lit(1).alias("k")), F.struct((F.col("x") + collar).alias("t"), F.lit(-1).alias("k")))).alias("m"))
        edges = edges.union(masks.select("clip", "m.t", F.lit(0), F.lit(0), "m.k"))
    steps = edges.groupBy("clip", "t").agg(*(F.sum(c).alias(c) for c in "rhk"))
    w = Window.partitionBy("clip").orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    atoms = steps.select("clip", F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"), *(F.sum(c).over(upto).alias(c) for c in "rhk"))
    return atoms.where("t1 > t0 AND k = 0 AND (r > 0 OR h > 0)").drop("k")


def der_parts(timelines: DataFrame, collar: float = 0.0) -> DataFrame:
    """clip, missed, false_alarm, common, reference (seconds) of every clip in timelines; unions are taken here."""
    atoms = sweep(canonical_union(timelines), collar).withColumn("d", F.col("t1") - F.col("t0"))
    zero = F.lit(0)
    sums = atoms.groupBy("clip").agg(
        F.sum(F.col("d") * F.greatest(zero, F.col("r") - F.col("h"))).alias("missed"),
        F.sum(F.col("d") * F.greatest(zero, F.col("h") - F.col("r"))).alias("false_alarm"),
        F.sum(F.col("d") * F.least("r", "h")).alias("common"),
        F.sum(F.col("d") * F.col("r")).alias("reference"),
    )
    return timelines.select("clip").distinct().join(sums, "clip", "left").fillna(0.0, ["missed", "false_alarm", "common", "reference"])


#: Rows of a clip for each part of its reference speakers, the most parts, and pairs of intervals that are compared at once.
PART_ROWS, PARTS, PAIRS = 1 << 14, 16, 1 << 20


def stretches(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Keys, first row and end of each run of rows with the same keys."""
    changes = np.zeros(batch.num_rows - 1, bool)
    for k in keys:
        codes = batch.column(k).dictionary_encode("encode").indices.to_numpy()
        changes |= codes[1:] != codes[:-1]
    cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield tuple(batch.column(k)[a].as_py() for k in keys), a, b


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Keys and rows of each group, of batches in order of the keys; one group at a time is in memory."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        for key, a, b in stretches(batch, keys):
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


class Side:
    """One side of a clip: speakers in order of their first start, and their intervals by speaker (code, start, end)."""

    def __init__(self, rows: pa.Table, side: int):
        rows = rows.filter(pc.equal(rows["side"], side)).combine_chunks()
        named = rows["speaker"].combine_chunks().dictionary_encode("encode") if rows.num_rows else None
        named = named.combine_chunks() if isinstance(named, pa.ChunkedArray) else named
        self.speakers = named.dictionary if named is not None else pa.array([], pa.string())
        code = named.indices.to_numpy(zero_copy_only=False).astype(np.int64) if named is not None else np.empty(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.start, self.end = code[order], rows["start"].to_numpy()[order], rows["end"].to_numpy()[order]

    def seconds(self) -> np.ndarray:
        """Length of each speaker's speech."""
        return np.bincount(self.code, self.end - self.start, len(self.speakers))


def together(r: Side, h: Side) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes and seconds of every reference and hypothesis speaker that meet, each pair once.

    Of two intervals that overlap one begins within the other, so binary searches find them. Some reference speakers at a time are taken,
    with about PAIRS pairs of intervals, which are counted beforehand.
    """
    if not len(r.code) or not len(h.code):
        return
    by_start = np.argsort(h.start, kind="stable")
    starts, ends = h.start[by_start], np.sort(h.end)
    counted = np.cumsum(np.searchsorted(starts, r.end, "left") - np.searchsorted(ends, r.start, "right"))
    last = np.flatnonzero(np.append(r.code[1:] != r.code[:-1], True))  # of each speaker
    many, n = len(h.speakers), np.arange
    a = done = 0
    while a < len(r.code):
        k = min(max(int(np.searchsorted(counted[last], done + PAIRS, "right")) - 1, int(np.searchsorted(last, a, "left"))), len(last) - 1)
        b = int(last[k]) + 1
        done = int(counted[b - 1])
        rs, re = r.start[a:b], r.end[a:b]
        lo, order = np.searchsorted(starts, rs, "left"), np.argsort(rs, kind="stable")
        own = rs[order]
        times = np.searchsorted(starts, re, "left") - lo
        i, j = np.repeat(n(b - a), times), by_start[n(times.sum()) + np.repeat(lo - np.cumsum(times) + times, times)]
        lo = np.searchsorted(own, h.start, "right")
        times = np.maximum(np.searchsorted(own, h.end, "left") - lo, 0)
        i = np.concatenate([i, order[n(times.sum()) + np.repeat(lo - np.cumsum(times) + times, times)]])
        j = np.concatenate([j, np.repeat(n(len(h.code)), times)])
        if len(i):
            d = np.minimum(re[i], h.end[j]) - np.maximum(rs[i], h.start[j])
            key = r.code[a:b][i] * many + h.code[j]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            yield key[first] // many, key[first] % many, np.add.reduceat(d[order], first)
        a = b


def _matrix(unions: DataFrame) -> DataFrame:
    """clip, reference, hypothesis, seconds, rt, ht: time together and each one's time, of every pair of speakers that meet.

    A long clip's reference speakers are dealt to up to PARTS parts, each of which sees the whole hypothesis. What is shuffled grows with the
    intervals, and pairs go straight from the batches to what reads them.
    """
    both = unions.where("clip IS NOT NULL AND side IN (0, 1)")
    parts = both.groupBy("clip").agg(F.least(F.lit(PARTS), F.ceil(F.count("*") / PART_ROWS)).cast("int").alias("parts"))
    own = F.array(F.pmod(F.xxhash64("speaker"), F.col("parts")).cast("int"))
    dealt = both.join(parts, "clip").withColumn("part", F.explode(F.when(F.col("side") == 0, own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparvox.operators import intervals

        for (clip, _), rows in intervals.groups(batches, ["clip", "part"]):
            r, h = intervals.Side(rows, 0), intervals.Side(rows, 1)
            rt, ht = r.seconds(), h.seconds()
            for i, j, seconds in intervals.together(r, h):
                for k in range(0, len(i), 1 << 16):
                    x, y, d = i[k : k + (1 << 16)], j[k : k + (1 << 16)], seconds[k : k + (1 << 16)]
                    columns = [pa.repeat(pa.scalar(clip, pa.string()), len(x)), r.speakers.take(pa.array(x)), h.speakers.take(pa.array(y)), pa.array(d), pa.array(rt[x]), pa.array(ht[y])]
                    yield pa.RecordBatch.from_arrays(columns, ["clip", "reference", "hypothesis", "seconds", "rt", "ht"])

    placed = dealt.select("clip", "part", "side", "start", "speaker", "end").repartition(_tasks(unions), "clip", "part").sortWithinPartitions("clip", "part", "side", "start", "speaker")
    return placed.mapInArrow(run, "clip string, reference string, hypothesis string, seconds double, rt double, ht double")


def _tasks(rows: DataFrame) -> int:
    """Partitions of what is costly beside its rows, so few small partitions would keep cores idle."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def overlaps(unions: DataFrame) -> DataFrame:
    """clip, reference, hypothesis, seconds: time together of every pair of speakers that meet."""
    return _matrix(unions).select("clip", "reference", "hypothesis", "seconds")


def jaccard(unions: DataFrame) -> DataFrame:
    """clip, reference, hypothesis, cost: one minus the time together over the time of either, of every pair of speakers that meet; of others it is 1."""
    both = _matrix(unions).where("reference IS NOT NULL AND hypothesis IS NOT NULL")
    return both.select("clip", "reference", "hypothesis", (1 - F.col("seconds") / (F.col("rt") + F.col("ht") - F.col("seconds"))).alias("cost"))


def _open_time(boundaries: np.ndarray, collar: float, times: np.ndarray) -> np.ndarray:
    """How much time before each of times no collar masks. It grows with time, so overlaps of what it gives are the unmasked parts of overlaps."""
    if not len(boundaries):
        return times
    x = np.sort(boundaries)
    apart = x[1:] - collar > x[:-1] + collar
    a, b = x[np.append(True, apart)] - collar, x[np.append(apart, True)] + collar
    through = np.cumsum(b - a)
    k = np.searchsorted(a, times, "right") - 1
    at = np.maximum(k, 0)
    inside = a[at] - (through[at] - (b[at] - a[at]))
    return np.where(k < 0, times, np.where(times <= b[at], inside, times - through[at]))


def _kinds(side: Side, start: np.ndarray, end: np.ndarray) -> tuple[Side, np.ndarray]:
    """One speaker for each set of those with the very same intervals, who stand for each other in any assignment, and the sets' sizes."""
    kept = end > start
    code, start, end = side.code[kept], start[kept], end[kept]
    cuts = [*np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)]).tolist(), len(code)]
    seen: dict[bytes, int] = {}
    sizes: list[int] = []
    spans = []
    for a, b in zip(cuts, cuts[1:]):
        kind = seen.setdefault(start[a:b].tobytes() + end[a:b].tobytes(), len(seen))
        if kind == len(sizes):
            sizes.append(0)
            spans.append((a, b))
        sizes[kind] += 1
    out = Side.__new__(Side)
    at = np.concatenate([np.arange(a, b) for a, b in spans]) if spans else np.empty(0, np.int64)
    out.speakers, out.code, out.start, out.end = pa.nulls(len(sizes)), np.repeat(np.arange(len(sizes)), [b - a for a, b in spans]).astype(np.int64), start[at], end[at]
    return out, np.array(sizes, np.int64)


def best_total(rows: pa.Table, collar: float = 0.0, shares: bool = False) -> tuple[float, int]:
    """Of one clip's unions: the largest total, over a one-to-one choice of speakers, of unmasked seconds or of shares; reference speakers."""
    from sparvox.functions import kernels

    sides = [Side(rows, k) for k in (0, 1)]
    boundaries = np.concatenate([sides[0].start, sides[0].end]) if collar else np.empty(0)
    (r, supply), (h, demand) = (_kinds(x, *(_open_time(boundaries, collar, t) for t in (x.start, x.end))) for x in sides)
    found = [(i.astype(np.int32), j.astype(np.int32), d) for i, j, d in together(r, h)]
    i, j, gains = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0))
    del found
    if shares:
        gains = gains / (r.seconds()[i] + h.seconds()[j] - gains)
    return kernels.best_flow(i, j, gains, supply, demand), len(sides[0].speakers)


def assigned(unions: DataFrame, collar: float = 0.0, shares: bool = False) -> DataFrame:
    """clip, best, speakers: best_total of every clip. A task takes a clip's intervals, which are fewer than its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparvox.operators import intervals

        for (clip,), rows in intervals.groups(batches, ["clip"]):
            best, n = intervals.best_total(rows, collar, shares)
            yield pa.RecordBatch.from_pydict({"clip": pa.array([clip], pa.string()), "best": pa.array([best], pa.float64()), "speakers": pa.array([n], pa.int64())})

    placed = unions.where("clip IS NOT NULL AND side IN (0, 1)").select("clip", "side", "start", "speaker", "end").repartition(_tasks(unions), "clip")
    return placed.sortWithinPartitions("clip", "side", "start", "speaker").mapInArrow(run, "clip string, best double, speakers long")


def der(timelines: DataFrame, collar: float = 0.0, duration: Column | float | None = None) -> DataFrame:
    """clip, missed, false_alarm, confusion, numerator, denominator, value (null without reference speech)."""
    clips = timelines.select("clip").distinct()
    if duration is not None:
        timelines = clipped(timelines, duration)
    parts = clips.join(der_parts(timelines, collar), "clip", "left").fillna(0.0)
    best = assigned(canonical_union(timelines), collar).select("clip", "best")
    out = parts.join(best, "clip", "left").withColumn("confusion", F.greatest(F.lit(0.0), F.col("common") - F.coalesce("best", F.lit(0.0))))
    errors = F.col("missed") + F.col("false_alarm") + F.col("confusion")
    return out.select("clip", "missed", "false_alarm", "confusion", errors.alias("numerator"), F.col("reference").alias("denominator"), F.when(F.col("reference") > 0, errors / F.col("reference")).alias("value"))


def jer(timelines: DataFrame, duration: Column | float | None = None) -> DataFrame:
    """clip, error_sum, reference_speakers, value (null without reference speakers)."""
    clips = timelines.select("clip").distinct()
    unions = canonical_union(timelines if duration is None else clipped(timelines, duration))
    done = clips.join(assigned(unions, shares=True), "clip", "left")
    n = F.coalesce("speakers", F.lit(0).cast("long"))
    error = n - F.coalesce("best", F.lit(0.0))  # 1 for whom nobody is left or met
    return done.select("clip", error.alias("error_sum"), n.alias("reference_speakers"), F.when(n > 0, error / n).alias("value"))


def speaker_count(timelines: DataFrame, duration: Column | float | None = None) -> DataFrame:
    """clip, reference_speakers, hypothesis_speakers, correct, absolute_error; exact counts of speakers with speech."""
    spoken = (timelines if duration is None else clipped(timelines, duration)).where("end > start")
    n = lambda k: F.count_distinct(F.when(F.col("side") == k, F.col("speaker")))
    counts = spoken.groupBy("clip").agg(n(0).alias("reference_speakers"), n(1).alias("hypothesis_speakers"))
    full = timelines.select("clip").distinct().join(counts, "clip", "left").fillna(0)
    error = F.abs(F.col("reference_speakers") - F.col("hypothesis_speakers"))
    return full.select("*", (error == 0).alias("correct"), error.alias("absolute_error"))
