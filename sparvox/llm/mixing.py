"""Mixing sources to target weights over a time-varying curriculum.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share SHARE of all words. No source gets over
LIMIT times its own size; what it can't take is shared out again by weight until none is above. That is a water level: target =
min(LIMIT * size, weight * level), and with sources in order of LIMIT * size / weight the level is found from running sums.

Curriculum. Over training time 0 to 1 the rate of a source is its weight times 1 + slope * (2t - 1); slopes follow the weights:
heavy sources fade out, light ones fade in. Its integral, scaled to the target, is the source's cumulative demand D(t) =
target * ((1 - slope) * t + slope * t^2). Documents of a source, in an order by hash, lie one after another on its words 0, 1,
2...; where the demand is larger than the source, the same order follows again. A copy that starts at word u is trained
on at the time with D(t) = u: position = the inverse of D, a square root. Words beyond the target aren't demanded: taken
counts the words before it, over all copies, so a source's taken words add up to its target, rounded.
schedule() gives each copy's position; mix() puts whole documents in order of position, ranges of it on different tasks.

Scale. A document's place in its source is a running sum. It is found in two levels: sums of (source, slice of the hash range)
first, running over a source's slices, then within a slice. Slices hold about SLICE documents whatever the source's size, and the
places don't depend on how many there are. Only tables with a row for each source go through one task.

Defined results: null text has size 0; documents without words take no part (taken 0, no position); a null source is a source; ties
in the hash are ordered by doc_id, text hash and a hash of the other columns; repeated rows each count and each has its own place, so
rows that are equal throughout are taken as often as their places are, whichever is which; empty tables give empty results; a doc_id that is
null hashes like any other value. Extra columns of df stay in mix(); those that hold maps play no part in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparvox.llm._joins import attach, group_key
from sparvox.runtime import cut, stage

WEIGHTS = (5, 2, 1)
SLOPES = (-0.6, 0.0, 0.6)
SHARE = 1.5
LIMIT = 2
SLICE = 10_000
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, size) with weight, slope and target. One row for each source: ordered in one task, in constant memory."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), turn + 1)
    weighed = sizes.withColumn("weight", pick(WEIGHTS)).withColumn("slope", pick(SLOPES)).withColumn("most", LIMIT * F.col("size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    full = by_ratio.rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    totals = weighed.select(
        "*",
        F.sum("most").over(full).alias("filled"),
        F.sum("weight").over(full).alias("gone"),
        F.sum("weight").over(everything).alias("weights"),
        (SHARE * F.sum("size").over(everything)).alias("demand"),
        F.row_number().over(by_ratio).alias("place"),
    )
    # The level if exactly the sources before this one are full; it holds for the first source that isn't above its limit then.
    before_filled, before_gone = F.col("filled") - F.col("most"), F.col("gone") - F.col("weight")
    level = (F.col("demand") - before_filled) / (F.col("weights") - before_gone)
    leveled = totals.withColumn("level", F.when(F.col("most") >= F.col("weight") * level, level))
    found = leveled.withColumn("water", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("place"))).over(everything))
    water = F.coalesce(F.col("weight") * F.col("water"), F.col("most").cast("double"))
    return found.select("source", "size", "weight", "slope", F.least(F.col("most").cast("double"), water).alias("target"))


def order_hash(doc_id: str, text: str) -> list[Column]:
    """The place of a row in its source (of id and text, so that rows without or with one id are spread as well), and what tells ties apart."""
    mark = F.xxhash64(F.col(text))
    return [F.xxhash64(F.lit(20250101), F.col(doc_id), mark).alias("__h"), mark.alias("__t")]


KEY = ["__g", "__h", "__t", "__w"]


def keyed(df: DataFrame) -> DataFrame:
    """df with KEY: source, order hashes, and a hash of all other columns that can be hashed."""
    rest = [F.col(f"`{c}`") for c, kind in df.dtypes if c not in ("doc_id", "text", "source") and "map<" not in kind and "variant" not in kind]
    h, t = order_hash("doc_id", "text")
    return df.withColumns({"__g": group_key("source"), "__h": h, "__t": t, "__w": F.xxhash64(*rest) if rest else F.lit(0).cast("long")})


def schedule(docs: DataFrame) -> DataFrame:
    """KEY, doc_id, size, source_size, target, taken, positions (array: the time of each copy's start) for stored rows doc_id, source, size, KEY."""
    g = docs
    sizes = g.groupBy("__g", "source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    sizes = cut(sizes)
    wanted = cut(targets(sizes.select("source", "size")).withColumn("__g", group_key("source")).withColumnRenamed("size", "source_size"))
    wanted = cut(wanted.join(sizes.select("__g", F.greatest(F.lit(1), F.ceil(F.col("docs") / SLICE)).cast("long").alias("slices")), "__g").drop("source"))
    rows = attach(g, wanted, "__g", F.col("__h"))
    # The top 31 bits of the hash, in order, cut into equal ranges.
    rank = F.shiftright("__h", 33) + (1 << 30)
    rows = rows.withColumn("__slice", F.floor(rank * F.col("slices") / (1 << 31)).cast("long"))
    parts = rows.groupBy("__g", "__slice").agg(F.sum("size").alias("in_slice"))
    running = Window.partitionBy("__g").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__g", "__slice", F.coalesce(F.sum("in_slice").over(running), F.lit(0)).alias("before"))
    inside = Window.partitionBy("__g", "__slice").orderBy("__h", "doc_id", "__t", "__w").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["__g", "__slice"])
    first = F.col("before") + F.col("within")
    second = first + F.col("source_size")
    end = F.round("target").cast("long")
    demanded = lambda u: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), end - u))
    b = F.lit(1.0) - F.col("slope")
    share = lambda u: u / F.col("target")
    # D(t) / target = b t + slope t^2, whose rising root is 2 x / (b + sqrt(b^2 + 4 slope x)).
    time = lambda u: 2 * share(u) / (b + F.sqrt(b * b + 4 * F.col("slope") * share(u)))
    times = F.filter(F.array(*(F.when(demanded(u) > 0, time(u)) for u in (first, second))), lambda x: x.isNotNull())
    return placed.select(*KEY, "doc_id", "size", "source_size", "target", (demanded(first) + demanded(second)).alias("taken"), times.alias("positions"))


def sized(df: DataFrame) -> DataFrame:
    n = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    return keyed(df).select("doc_id", "source", n.alias("size"), *KEY)


def report(df: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_position: range-sorted by the position of the first copy."""
    done = schedule(stage(sized(df), "sizes"))
    first = F.when(F.size("positions") > 0, F.get("positions", F.lit(0))).alias("first_position")
    return done.select("doc_id", "size", "source_size", "target", "taken", first).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def mix(df: DataFrame) -> DataFrame:
    """df's documents as often as they are taken, whole, in order of training position; columns as they were.

    A copy that starts before its source's target is there whole; a document of which nothing is taken is not.
    """
    done = schedule(stage(sized(df), "sizes"))
    copies = done.select(*KEY, F.explode("positions").alias("__position"))
    # Of rows that are equal throughout one goes to all of their places, so they needn't be numbered; texts are shuffled once for this, by KEY.
    first = keyed(df).withColumn("__n", F.row_number().over(Window.partitionBy(*KEY).orderBy("__h"))).where("__n = 1").drop("__n")
    return first.join(copies, KEY).orderBy("__position", "doc_id").select(*df.columns)
