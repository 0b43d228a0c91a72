"""Quality rules: base rules, then robust multivariate outliers by minimum covariance determinant (MCD).

Statistics of a text are transformed to a vector; for every (lang, source) the MCD estimate of centre and scatter is found by
concentration steps over all of the group's documents that pass the base rules, and a document is rejected if its squared
Mahalanobis distance exceeds the chi-square quantile with a tail of TAIL.

Estimation. Two deterministic starts (median with median absolute deviations; mean with covariance) are each improved by STEPS
C-steps: distances to the current estimate, the covariance of the COVER closest documents, and so on; the start that ends with the
smaller determinant wins, is made consistent at the normal distribution and reweighted once (documents within the 0.975
quantile). The closest ones are found without sorting: squared distances fall into eighths of octaves, counts and sums of
products by (group, bucket) are added up in Spark with map-side combining, and the buckets of a group are taken from the
nearest on until COVER of the group is reached. Vectors are rounded to 1/1024, and sums are of integers, so results
don't depend on the order of rows or partitions. The variance of each component has a floor (FLOORS), as many groups have no symbols or repeats
at all in their closest documents; it also keeps the scatter invertible.

A group of fewer than least documents (by default ten for each component, a usual least number for a scatter matrix) takes the estimate of
its language over all sources; where that has too few as well, that of all documents, however few these are.

Everything is DataFrame expressions. Documents meet estimates (one small row for each group) by a broadcast only if the groups have
been counted to be few, else by a salted join, so a hot source is no hot task.

Defined results: null text counts as empty: 0 words, base_failed; null lang or source is a group of its own; ties and repeated rows
are judged alike; an empty table gives an empty result; extra columns pass through; texts of any length are taken whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparvox.llm import _chi2
from sparvox.llm._joins import attach, group_key
from sparvox.runtime import cut, stage

SPACE = r"[\x20\x09-\x0D]+"
INK = r"[^\x20\x09-\x0D]"
SCALE = 1024
STEPS = 4
COVER = 0.75
TAIL = 1e-6
#: Least standard deviation of each component.
FLOORS = (0.5, 0.1, 0.5, 0.5, 1.0)
P = len(FLOORS)
#: Documents that a group must have for an estimate of its own, unless a caller says otherwise.
LEAST = 10 * P
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BUCKETS = 8


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur at least twice, the first occurrence included. words: an array that is at hand, as a variable of let is.

    An expression would be computed anew for every window, and so would a column whose definition the optimiser may put in its place. Windows are 64-bit hashes. Each is packed with its place into one number (as many low bits as places need), so that sorting
    numbers brings equal windows together; neighbours are then compared by their full hashes.
    """
    last = F.size(words) - 3
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(3))))

    def covered(h: Column) -> Column:
        bits = F.length(F.bin(F.size(h)))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        packed = F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))

        def places(p: Column) -> Column:
            at = lambda k: F.get(p, k).bitwiseAND(mask).cast("int")
            of = lambda k: F.get(h, at(k))
            same = lambda k, j: F.coalesce(let(of(k), lambda x: x == of(j)), F.lit(False))
            ks = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
            return F.sort_array(F.transform(ks, at))

        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["end"])).alias("n"), p.alias("end"))
        return F.aggregate(let(packed, places), start, step, lambda a: a["n"])

    none = F.lit(0)
    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))
    return F.when(last < 1, none).otherwise(found).cast("long")


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base statistics and base_failed."""
    names = df.columns
    t = df.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    t = t.withColumn("__words", F.array_remove(F.split("__text", SPACE), ""))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(INK))
    t = t.select(
        *names,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("__text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(F.col("__words"), repeated_words).alias("n_repeat_words"),
    )
    return t.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics as integers of 1/SCALE; of documents with words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.log1p(100 * F.col(c) / n)
    values = (F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), share("n_symbols"), share("n_dup_lines"), share("n_repeat_words"))
    return [F.round(SCALE * v).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
SUMS = ["n", *(f"s{i}" for i in range(P)), *(f"s{i}_{j}" for i, j in PAIRS)]


def summed() -> list[Column]:
    return [
        F.count("*").alias("n"),
        *(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)),
        *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS),
    ]


def estimate(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Centre m0.., Cholesky factor l0_0.. of the scatter (times factor, with floors) and logdet, from sums of each group."""
    n = F.col("n").cast("double")
    out = sums.select(*keys, "n", *((F.col(f"s{i}") / n).alias(f"m{i}") for i in range(P)), *(f"s{i}_{j}" for i, j in PAIRS))

    def scatter(i: int, j: int) -> Column:
        c = factor * (F.col(f"s{i}_{j}") / n - F.col(f"m{i}") * F.col(f"m{j}"))
        return F.greatest(c, F.lit((FLOORS[i] * SCALE) ** 2)) if i == j else c

    out = out.select(*keys, "n", *(f"m{i}" for i in range(P)), *(scatter(i, j).alias(f"c{i}_{j}") for i, j in PAIRS))
    return factored(out, keys)


def factored(out: DataFrame, keys: list[str]) -> DataFrame:
    """Cholesky factor of the scatter c, a column at a time. A pivot stays above a thousandth of its variance, come rounding what may."""
    for j in range(P):
        square = F.col(f"c{j}_{j}")
        for k in range(j):
            square = square - F.col(f"l{j}_{k}") * F.col(f"l{j}_{k}")
        out = out.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(square, F.col(f"c{j}_{j}") / 1000)))
        for i in range(j + 1, P):
            rest = F.col(f"c{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            out = out.withColumn(f"l{i}_{j}", rest / F.col(f"l{j}_{j}"))
    logdet = sum(F.log(f"l{j}_{j}") for j in range(P))
    return out.select(*keys, "n", *(f"m{i}" for i in range(P)), *(f"l{i}_{j}" for i, j in PAIRS), logdet.alias("logdet"))


def with_distance(df: DataFrame) -> DataFrame:
    """df, which has x and an estimate, with d2: the squared Mahalanobis distance, by forward substitution."""
    names = df.columns
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}_{j}") * F.col(f"z{j}")
        df = df.withColumn(f"z{i}", rest / F.col(f"l{i}_{i}"))
    return df.select(*names, sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)).alias("d2"))


def spread() -> Column:
    return F.struct(*(F.col(f"x{i}") for i in range(P)))


#: The group of all documents.
EVERY = "every"


def fit(stats: DataFrame) -> DataFrame:
    """The estimate of each group: g, its n, centre, factor. stats: a stored table of lang, source and the base statistics."""
    passed = stats.where("NOT base_failed").select(group_key("lang", "source").alias("own"), group_key("lang").alias("wide"), *vector())
    x = passed.select(F.explode(F.array(F.concat(F.lit("own"), "own"), F.concat(F.lit("all"), "wide"), F.lit(EVERY))).alias("g"), *(f"x{i}" for i in range(P)))
    x = stage(x, "vectors")

    medians = cut(x.groupBy("g").agg(F.count("*").alias("n"), *(F.expr(f"percentile(x{i}, 0.5)").alias(f"m{i}") for i in range(P))))
    deviations = [F.expr(f"percentile(abs(x{i} - m{i}), 0.5)").alias(f"d{i}") for i in range(P)]
    spreads = attach(x, medians, "g", spread()).groupBy("g").agg(F.first("n").alias("n"), *(F.first(f"m{i}").alias(f"m{i}") for i in range(P)), *deviations)
    variance = lambda i: F.greatest(F.pow(1.4826 * F.col(f"d{i}"), 2), F.lit((FLOORS[i] * SCALE) ** 2))
    diagonal = spreads.select("g", "n", *(f"m{i}" for i in range(P)), *((variance(i) if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in PAIRS))
    robust = factored(diagonal, ["g"]).withColumn("start", F.lit(0))
    classic = estimate(x.groupBy("g").agg(*summed()), ["g"], 1.0).withColumn("start", F.lit(1))
    now = cut(robust.unionByName(classic))
    sizes = medians.select("g", F.col("n").alias("size"))

    half = COVER / _chi2.cdf(_chi2.inverse(COVER, P), P + 2)
    fields = [c for c in now.columns if c != "g"]

    def paired(current: DataFrame) -> DataFrame:
        """Every vector with each estimate of its group."""
        held = cut(current.groupBy("g").agg(F.collect_list(F.struct(*fields)).alias("e")))
        return with_distance(attach(x, held, "g", spread()).withColumn("e", F.explode("e")).select("g", *(f"x{i}" for i in range(P)), "e.*"))

    for _ in range(STEPS):
        bucket = F.greatest(F.lit(-100), F.floor(BUCKETS * F.log2(F.greatest("d2", F.lit(1e-4))))).alias("bucket")
        parts = paired(now).groupBy("g", "start", bucket).agg(*summed())
        upto = Window.partitionBy("g", "start").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        running = parts.select("g", "start", "bucket", *(F.sum(c).over(upto).alias(c) for c in SUMS))
        reached = running.join(sizes, "g").where(F.col("n") >= COVER * F.col("size"))
        nearest = reached.groupBy("g", "start").agg(*(F.min_by(c, "bucket").alias(c) for c in SUMS))
        now = cut(estimate(nearest, ["g", "start"], half))

    best = cut(now.groupBy("g").agg(F.min_by(F.struct(*fields), F.struct("logdet", "start")).alias("e")).select("g", "e.*"))
    near, inside = _chi2.inverse(0.975, P), 0.975
    last = inside / _chi2.cdf(near, P + 2)
    final = estimate(paired(best).where(F.col("d2") <= near).groupBy("g").agg(*summed()), ["g"], last)
    return cut(final.drop("n").join(sizes.withColumnRenamed("size", "n"), "g"))


def judge(df: DataFrame, estimates: DataFrame, least: int = LEAST) -> DataFrame:
    """df, which has lang, source and the base statistics, with distance (null if base_failed) and kept."""
    names = df.columns
    e = estimates.where((F.col("n") >= least) | (F.col("g") == EVERY))
    fields = [c for c in e.columns if c != "g"]
    both = df.withColumns({"__own": F.concat(F.lit("own"), group_key("lang", "source")), "__all": F.concat(F.lit("all"), group_key("lang")), "__every": F.lit(EVERY)})
    for key in ("__own", "__all", "__every"):
        both = attach(both, e.select(F.col("g").alias(key), F.struct(*fields).alias(f"{key}_e")), key, F.struct("n_words", "word_chars"))
    x = both.select(*names, *vector(), F.coalesce("__own_e", "__all_e", "__every_e").alias("e")).select(*names, *(f"x{i}" for i in range(P)), "e.*")
    limit = _chi2.inverse(TAIL, P, upper=True)
    judged = with_distance(x)
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= limit, F.lit(False))
    return judged.select(*names, kept.alias("kept"), F.when(~F.col("base_failed"), F.col("d2")).alias("distance"))


def report(df: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, distance."""
    stats = stage(with_statistics(df.select("doc_id", "lang", "source", "text")).drop("text"), "statistics")
    return judge(stats, fit(stats), least).select("doc_id", *STATISTICS, "base_failed", "kept", "distance")


def keep_good(df: DataFrame, least: int = LEAST) -> DataFrame:
    """df without the documents that the rules reject; columns as they were. Rows are stored with their statistics, which are computed once."""
    rows = df.select(F.struct(*df.columns).alias("__row"), "lang", "source", "text")  # whatever df's other columns are called
    stats = stage(with_statistics(rows).drop("text"), "statistics")
    return judge(stats, fit(stats), least).where("kept").select("__row.*")
