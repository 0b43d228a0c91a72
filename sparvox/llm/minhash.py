"""Near-duplicates by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates.

Sketch. A document is the set of its distinct five-word shingles, as 64-bit hashes. One hash serves all 256 bins: its
upper byte names the bin, a bin holds the smallest hash in it. An empty bin takes the value of the first non-empty one in
an order of its own, fixed for all documents (Shrivastava 2017), so that any bin agrees between two sets with the
probability of their similarity J. 42 bands of 6 bins make the buckets: a pair with J = 0.85 shares none with a
probability of 2e-9, one with J = 0.8 of 3e-6, one with J = 0.2 has a bucket in common in 0.3 % of cases.

Candidates. Documents with equal sets are first folded into one representative, the smallest doc_id. In each bucket a
centre is paired with each other member: as many pairs as postings, however large the bucket. The centre is the member with the
most company over all its buckets, so that an original comes before copies of it that are further from each other.

Confirmation. Candidates whose sketches agree in too few bins (0.13 below the threshold; 5.8 standard deviations) are set
aside; the others are confirmed on the full sets, read anew from the texts: exact intersection and union.

The rest. A star misses a link when neither end is the centre. What is left to find are links between different components in a bucket (those
within one can't change the result), and one minus the similarity is a metric, so centres tell where they can be. A linked document is
within e = 1 - J of the centre of its star; others are stars of their own. Two stars with linked members have centres within 3 e of each other, and
such a member is within 2 e of the other star's centre. So in a bucket only the centres of different components are compared by sketch, in
blocks of at most 256 x 256; then the members of stars that are near each other with the other's centre; then what is left of the one side with
what is left of the other, in blocks again; and what may be similar is confirmed likewise. A bucket of many copies in few
components costs a comparison or two for each member. Nothing is capped.

Defined results: null or wordless text: an empty set, linked with nothing, its own component; fewer than five words: the
whole sequence is the one shingle; null doc_id: compared with nothing, component_id null, kept; repeated rows: each gets
its component, and all rows of the smallest doc_id are kept; rows of one doc_id with different texts are one document, linked by any of
its texts (their sketches aren't asked: what shares a bucket is confirmed on the texts); an empty table gives an empty result. Extra columns play no
part. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparvox.llm._joins import BROADCAST_ROWS, small
from sparvox.llm._shingles import shingles
from sparvox.llm.components import connected
from sparvox.runtime import cut, stage, workers_see_package

BINS, BANDS, ROWS = 256, 42, 6
#: How far below the threshold the share of agreeing bins may lie; and below the lower ones for centres, where it varies more (5.8 standard deviations).
SLACK, WIDE_SLACK = 0.13, 0.18
#: Members of one block of a bucket, and of one group around a centre.
BLOCK = 256

_rng = np.random.default_rng(20250101)
#: For each bin, the order in which it looks for a non-empty one.
PROBES = np.argsort(_rng.random((BINS, BINS)), axis=1)
_MULTIPLIERS = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(56)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The value of each bin; hashes is sorted and not empty."""
    first = np.searchsorted(hashes, _EDGES)
    full = np.append(first[1:], len(hashes)) > first
    values = hashes[np.minimum(first, len(hashes) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        order = PROBES[empty]
        values[empty] = values[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    """A bucket key for each band."""
    key = (values[: BANDS * ROWS].reshape(BANDS, ROWS) * _MULTIPLIERS).sum(axis=1, dtype=np.uint64)
    key ^= key >> np.uint64(31)
    key *= np.uint64(0x94D049BB133111EB)
    key ^= key >> np.uint64(30)
    return key.astype(np.int64)


SKETCH = "doc_id long, n long, print binary, sketch binary, keys array<long>"


def sketch_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        for at in range(0, len(batch), 1024):
            part = batch.slice(at, 1024)
            n, prints, sketches, keys = [], [], [], []
            for text in part.column(1).to_pylist():
                hashes = shingles(text, size) if text else ()
                n.append(len(hashes))
                if len(hashes):
                    values = signature(hashes)
                    prints.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    sketches.append(((values ^ values >> np.uint64(17)) & np.uint64(255)).astype(np.uint8).tobytes())
                    keys.append(bands(values))
                else:
                    prints.append(None)
                    sketches.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n", "print", "sketch", "keys"],
            )


def alike(a: pa.Array, b: pa.Array) -> pa.Array:
    """In how many bins two sketches agree; in all, if one is null."""
    x, y = unpacked(a), unpacked(b)
    known = np.array(a.is_valid()) & np.array(b.is_valid())
    return pa.array(np.where(known, (x == y).sum(axis=1, dtype=np.int32), np.int32(BINS)))


def unpacked(sketches: pa.Array) -> np.ndarray:
    """A row for each sketch; zeros for null."""
    return np.frombuffer(b"".join(x or bytes(BINS) for x in sketches.to_pylist()), np.uint8).reshape(-1, BINS)


def confirm_batches(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come as (a, block, b, text), a centre's own first, with b null; gives (a, b) of those that are similar."""
    now, centres = None, []
    for batch in batches:
        a_out, b_out = [], []
        for a, block, b, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if now != (a, block):
                now, centres = (a, block), []
            found = shingles(text, size)
            if b is None:
                centres.append(found)
                continue
            for centre in centres:
                small, large = sorted((len(found), len(centre)))
                if 100 * small < percent * large:
                    continue
                both = len(np.intersect1d(found, centre, assume_unique=True))
                if both and 100 * both >= percent * (small + large - both):
                    a_out.append(a)
                    b_out.append(b)
                    break
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, whatever batches they came in."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(len(batch), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            key = tuple(c[lo] for c in columns)
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            now = key
    if held:
        yield pa.Table.from_batches(held)


def cross_batches(batches: Iterator[pa.RecordBatch], percent: int, least: int) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks (key, x, y), sides 0 and 1, or of a block with itself (side 0 only): the pairs of different components whose sketches agree enough.

    percent: what the smaller set must be of the larger.
    """
    for group in grouped(batches, ["key", "other", "x", "y"]):
        ids, labels, sizes, side = (np.asarray(group.column(k)) for k in ("doc_id", "component", "n", "side"))
        marks, blank = unpacked(group.column("sketch")), np.array(group.column("sketch").is_null())
        order = np.arange(len(ids))
        right = np.flatnonzero(side == 1)
        found: list[np.ndarray] = []
        for i in np.flatnonzero(side == 0):
            others = right if len(right) else order[i + 1 :]
            others = others[labels[others] != labels[i]]
            small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
            free = blank[others] | blank[i]
            others = others[free | (100 * small >= percent * large)]
            others = others[blank[others] | blank[i] | ((marks[others] == marks[i]).sum(axis=1) >= least)]
            if len(others):
                found.append(np.stack((np.minimum(ids[others], ids[i]), np.maximum(ids[others], ids[i]))))
        if found:
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar on their full sets.

    Every text goes once to each centre that it is compared with, and a centre's own to each block of its members; a task
    holds one centre's set at a time. Where the pairs have been counted to be few, they go to the texts, else texts and pairs meet by id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparvox.llm import minhash

        return minhash.confirm_batches(batches, size, percent)

    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = cut(pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "blocks").alias("block")))
    roles = placed.select(F.col("b").alias("doc_id"), "a", "block", "b").union(placed.select("a", "a", "block", F.lit(None).cast("long")).distinct())
    if placed.count() <= BROADCAST_ROWS:
        sent = docs.join(F.broadcast(roles), "doc_id").select("a", "block", "b", "text")
    else:
        wanted = roles.groupBy("doc_id").agg(F.collect_list(F.struct("a", "block", "b")).alias("roles"))
        sent = wanted.join(docs, "doc_id").select(F.explode("roles").alias("r"), "text").select("r.a", "r.block", "r.b", "text")
    ordered = sent.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return cut(ordered.mapInArrow(run, "a long, b long"))


def rest(members: DataFrame, links: DataFrame, percent: int, marks: DataFrame, likely: Callable, crossing: Callable) -> DataFrame:
    """Pairs (a < b) of different components that may be similar though no star has them: members (key, doc_id, component) of mixed buckets, links (a: centre, b)."""
    near, far = 3 * percent - 200, 2 * percent - 100  # of centres; of a member and the other centre
    agree = lambda p: max(0, int((p / 100 - WIDE_SLACK) * BINS))
    ends = links.select(F.col("a").alias("doc_id"), F.col("a").alias("centre"), F.lit(None).cast("long").alias("near")).union(links.select("b", F.lit(None).cast("long"), "a"))
    stars = small(cut(ends.groupBy("doc_id").agg(F.coalesce(F.max("centre"), F.min("near")).alias("star"))))
    starred = members.join(stars, "doc_id", "left").withColumn("star", F.coalesce("star", "doc_id")).select("key", "doc_id", "component", "star")
    starred = cut(starred)
    sketches = marks.select("doc_id", "n", "sketch")

    # Centres of a bucket against each other.
    posted = starred.select("key", F.col("star").alias("doc_id"), "component").distinct()
    counted = posted.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = posted.join(counted, "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    placed = placed.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = F.least("own", "y").alias("x"), F.greatest("own", "y").alias("y")
    placed = placed.select("key", F.lit(0).cast("long").alias("other"), x, y, (F.col("own") > F.col("y")).cast("int").alias("side"), "doc_id", "component").join(sketches, "doc_id")
    close = cut(crossing(placed, max(0, near), agree(near)))

    # Members of stars that are near each other with the other's centre: each by itself, so a hot star is many rows of one small check.
    of = starred.select("star", "doc_id", "component").distinct()
    ways = close.select(F.col("a").alias("star"), F.col("b").alias("far"), F.lit(0).alias("side")).union(close.select(F.col("b").alias("star"), F.col("a").alias("far"), F.lit(1).alias("side")))
    tests = ways.join(of, "star").select(F.col("doc_id").alias("a"), F.col("far").alias("b"), "star", "side", "component")
    kept = cut(likely(tests, max(0, far), agree(far)).select(F.least("star", "b").alias("key"), F.greatest("star", "b").alias("other"), "side", F.col("a").alias("doc_id"), "component"))

    # What is left of both sides.
    blocks = kept.groupBy("key", "other").agg(*(F.ceil(F.count(F.when(F.col("side") == k, 1)) / BLOCK).cast("int").alias(f"blocks{k}") for k in (0, 1))).where("blocks0 > 0 AND blocks1 > 0")
    both = kept.join(blocks, ["key", "other"])
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("side") == 0, F.col("blocks0")).otherwise(F.col("blocks1"))).cast("int")
    both = both.withColumn("own", own).withColumn("across", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("blocks1")).otherwise(F.col("blocks0")) - 1)))
    x, y = (F.when(F.col("side") == k, F.col("own")).otherwise(F.col("across")).alias(n) for k, n in ((0, "x"), (1, "y")))
    return crossing(both.select("key", "other", x, y, "side", "doc_id", "component").join(sketches, "doc_id"), percent, int((percent / 100 - SLACK) * BINS))


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of df: similar means 100 * |A & B| >= percent * |A | B|."""
    workers_see_package(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    least = int((percent / 100 - SLACK) * BINS)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparvox.llm import minhash

        return minhash.sketch_batches(batches, size)

    def crossing(rows: DataFrame, part: int, agree: int) -> DataFrame:
        """Distinct pairs (a, b) by cross_batches of rows key, other, x, y, side, doc_id, component, n, sketch."""

        def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from sparvox.llm import minhash

            return minhash.cross_batches(batches, part, agree)

        return rows.repartition("key", "other", "x", "y").sortWithinPartitions("key", "other", "x", "y").mapInArrow(cross, "a long, b long").distinct()

    def agreeing(a: pa.Array, b: pa.Array) -> pa.Array:
        from sparvox.llm import minhash

        return minhash.alike(a, b)

    sketches = stage(docs.mapInArrow(sketch, SKETCH), "sketches")
    nodes = sketches.where("n > 0 AND doc_id IS NOT NULL")
    classes = nodes.groupBy("print").agg(F.min("doc_id").alias("rep"))
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()

    postings = nodes.select("doc_id", "keys").join(reps, "doc_id", "left_semi").select("doc_id", F.explode("keys").alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("company")).where("company > 1")
    live = cut(postings.join(shared, "key"))
    standing = live.groupBy("doc_id").agg(F.sum("company").alias("standing"))
    several = cut(nodes.groupBy("doc_id").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).where("lo != hi").select("doc_id", F.lit(True).alias("several")))
    one = nodes.select("doc_id", "n", "sketch").join(standing, "doc_id").dropDuplicates(["doc_id"]).join(small(several), "doc_id", "left")
    marks = stage(one.select("doc_id", "n", F.when(F.col("several").isNull(), F.col("sketch")).alias("sketch"), "standing"), "marks")

    ranked = live.join(marks.select("doc_id", "standing"), "doc_id")
    centres = ranked.groupBy("key").agg(F.min(F.struct((-F.col("standing")).alias("s"), F.col("doc_id").alias("a"))).alias("c")).select("key", "c.a")
    stars = live.join(centres, "key").where("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct()

    def likely(pairs: DataFrame, part: int = percent, agree: int = least) -> DataFrame:
        """Those of the pairs (a, b) whose sketches agree in so many bins, and of which the smaller set is at least part per cent of the larger."""
        a, b = (marks.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab")
        sized = pairs.join(a, "a").join(b, "b").where(F.col("sketch_a").isNull() | F.col("sketch_b").isNull() | (100 * F.least("n_a", "n_b") >= part * F.greatest("n_a", "n_b")))
        return sized.where(F.arrow_udf(agreeing, "int")("sketch_a", "sketch_b") >= agree).drop("n_a", "n_b", "sketch_a", "sketch_b")

    links = confirm(cut(likely(stars)), docs, size, percent)
    joined = connected(links)  # what links the texts of one document plays no part yet: such a document needs no sketch
    labelled = live.select("key", "doc_id").join(small(joined.withColumnRenamed("id", "doc_id")), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    split = cut(labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key"))
    crossed = rest(labelled.join(small(split), "key"), links, percent, marks, likely, crossing)
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossed = cut(crossed.join(done, ["a", "b"], "left_anti"))
    all_links = links if crossed.isEmpty() else links.union(confirm(crossed, docs, size, percent))

    texts_of_one = nodes.join(small(several), "doc_id", "left_semi").join(classes, "print").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = connected(all_links.union(texts_of_one)).withColumnRenamed("id", "rep")
    member = sketches.select("doc_id", "n", "print").join(classes, "print", "left").join(found, "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return member.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(df: DataFrame, **options) -> DataFrame:
    """df without the documents that are near-copies of one with a smaller doc_id; columns as they were."""
    verdicts = near_duplicates(df, **options)
    doc_id = options.get("doc_id", "doc_id")
    dropped = verdicts.where("NOT kept").select(F.col("doc_id").alias("__dropped"))
    return df.join(dropped, df[doc_id] == dropped["__dropped"], "left_anti")
