"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The text of a document is its words (A-Z lower-cased, runs of [^\\x20\\x09-\\x0D]) joined by single spaces, then one end.
The model is a trie of byte contexts of up to ORDER bytes with the symbols seen after each. A symbol is coded in the
longest context known; where that hasn't seen it, the model escapes to the next shorter one, in which the symbols of the
longer are excluded; below the empty context all 256 bytes left over are equally likely. Escapes are estimated by method D
(Howard): of a context with n counts and d symbols, each symbol gives up half a count, so a symbol of count c has
(2c - 1) / 2n and the escape d / 2n. Counts below the longest context follow update exclusion: how many longer contexts
a symbol was seen in. Every context's probabilities, with exclusions, add up to one.

Pretrained: windows of ORDER + 1 bytes of all training documents are counted in parallel, summed by Spark, and
the shorter contexts follow from these sums. Every gram of every length is kept, in tables that grow with the corpus. Up to
1 / SHARE training windows, workers load the trie whole. Beyond, they hold the windows with a share of at least SHARE (at most
1 / SHARE of them), as a cache: all other windows of a document come by a join with the table of all windows, and those that
no training text has by joins with the tables of the shorter grams and their contexts. What is cached doesn't change any result.
adaptive() instead codes each document by a trie that starts empty and learns from it as it goes.

Base model: log10((c + 0.1) / (N + 0.1 * (V + 1))) summed over word tokens and one end, c, N and V from all training tokens.
Words whose share is at least SHARE (at most 1 / SHARE of them) go to the workers with the trie; the
counts of all others, none of which can be hot, come by a join. Words are told apart by 64-bit hashes.

Defined results: null text -> empty text, one end token; null doc_id -> held out; no training text -> every
byte at 1 / 256 and c = N = V = 0; repeated rows are scored (and learnt from) each; extra columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparvox.llm._shingles import WordHashes, words
from sparvox.runtime import cut, shared_path, stage, workers_see_package

ORDER = 5
END = 0xFF
#: Windows and words of at least this share of the corpus are held by the workers; the others come by joins.
SHARE = 1 / (1 << 22)
#: Hash of the end token, which no word has.
END_WORD = 0
#: Bytes whose counts are summed up before they are sent, and bytes that are Python objects and temporary arrays (some 60 bytes for each) at once;
#: a longer document is taken by itself.
CHUNK = 1 << 21
PIECE = 1 << 18
#: Counts in an Arrow batch.
SENT = 1 << 16
#: Rows of an Arrow batch that are Python objects at once.
ROWS = 128

_hash = WordHashes(1 << 16)
_M = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(8)


def spelled(found: list[bytes]) -> bytes:
    return b" ".join(found) + b"\xff"


def windows(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-byte window that ends at each symbol of the texts, and where each text starts among them.

    Before a text's first byte stand order ends.
    """
    pad = b"\xff" * order
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    grams = np.zeros(len(data) - order, np.uint64)
    for k in range(order + 1):
        grams <<= _B
        grams |= data[k : len(data) - order + k]
    lengths = np.array([len(t) for t in texts])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    keep = np.ones(len(grams), bool)
    for k, at in enumerate((starts + order * np.arange(len(texts))).tolist()):
        if k:
            keep[at - order : at] = False
    return grams[keep], starts


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of documents, some so many bytes at once."""
    ids, texts, size = [], [], 0
    for part in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            ids.append(doc_id)
            texts.append(words(text) if text else [])
            size += len(text or b"")
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each is there; sorts the array in its place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def count_batches(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): kind 0 windows, 1 words; partial counts of some CHUNK bytes, SENT at once."""

    def flush(grams: list[np.ndarray], tally: Counter, ends: int) -> Iterator[pa.RecordBatch]:
        merged = np.concatenate(grams)
        grams.clear()
        hashes = np.array([_hash[w] for w in tally] + [END_WORD], np.uint64)
        for kind, (keys, sums) in ((0, tallied(merged)), (1, (hashes, np.array([*tally.values(), ends], np.int64)))):
            for k in range(0, len(keys), SENT):
                own = keys[k : k + SENT]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), signed(own), pa.array(sums[k : k + SENT].astype(np.int64))], ["kind", "key", "n"])

    grams, tally, ends, size = [], Counter(), 0, 0
    for _, texts in held(batches, PIECE):
        grams.append(windows([spelled(t) for t in texts], order)[0])
        for t in texts:
            tally.update(t)
        ends += len(texts)
        size += len(grams[-1])
        if size >= CHUNK:
            yield from flush(grams, tally, ends)
            grams, tally, ends, size = [], Counter(), 0, 0
    if grams:
        yield from flush(grams, tally, ends)


class Table:
    """Open addressing: the place of each key among those given, or -1; for whole arrays at once."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, self.EMPTY)
        self.places = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.keys[slot] == self.EMPTY
            self.places[slot[free]] = todo[free]
            self.keys[slot[free]] = keys[todo[free]]
            won = self.places[slot] == todo
            # A slot that several wanted has the key that was written last and may have another's place: settle by place.
            self.keys[slot[won]] = keys[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _M) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.places[slot], np.int32(-1))
        todo = np.flatnonzero((there != keys) & (there != self.EMPTY))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.places[slot[hit]]
            on = ~hit & (there != self.EMPTY)
            todo, slot = todo[on], slot[on]
        return out


def tagged(keys: np.ndarray, length: int) -> np.ndarray:
    """Byte strings of up to seven bytes, told apart by length."""
    return keys & np.uint64((1 << 8 * length) - 1) | np.uint64(length << 56)


def build(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """The trie as arrays. levels[j]: sorted grams of j + 1 bytes, their counts, and the count of all that their context has.

    A kept gram's suffixes are kept too. If grams are left out, they still count in their context: what they had goes to the escape.
    entries: key, direct (log10 probability in their own context), weight (log10 of twice the count less one). contexts:
    key, leave (log10 of the escape), below and on (log10 of twice the next context's count, and of the escape from it,
    when this one's symbols are excluded there).
    """
    keys, direct, weight, contexts, leave, below, on = [], [], [], [], [], [], []
    shorter: tuple = ()
    for j, (grams, counts, of) in enumerate(levels):
        if not len(grams):
            break
        context = grams >> _B
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        n = of[first].astype(np.float64)
        taken = np.add.reduceat(2.0 * counts - 1, first)
        lw = np.log10(2.0 * counts - 1)
        keys.append(tagged(grams, j + 1))
        direct.append(lw - np.log10(2.0 * of))
        weight.append(lw)
        own = context[first]
        contexts.append(tagged(own, j))
        leave.append(np.log10((2 * n - taken) / (2 * n)))
        if j:
            s_grams, s_counts, s_own, s_n, s_taken = shorter
            inside = s_counts[np.searchsorted(s_grams, grams & np.uint64((1 << 8 * j) - 1))].astype(np.float64)
            parent = np.searchsorted(s_own, own & np.uint64((1 << 8 * (j - 1)) - 1))
            rest = 2 * (s_n[parent] - np.add.reduceat(inside, first))
            free = rest - (s_taken[parent] - np.add.reduceat(2 * inside - 1, first))
            some = rest > 0
            below.append(np.log10(np.where(some, rest, 1)))
            on.append(np.log10(np.where(some, free, 1) / np.where(some, rest, 1)))
        else:
            below.append(np.zeros(1))
            on.append(np.zeros(1))
        shorter = (grams, counts, own, n, taken)
    cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    return {
        "keys": cat(keys, np.uint64), "direct": cat(direct, np.float32), "weight": cat(weight, np.float32),
        "contexts": cat(contexts, np.uint64), "leave": cat(leave, np.float32), "below": cat(below, np.float32), "on": cat(on, np.float32),
        "symbols": np.array([len(levels[0][0]) if levels else 0]),
    }


class Model:
    """A trie, or the frequent windows of one, with the base model's frequent words."""

    def __init__(self, arrays: dict[str, np.ndarray], order: int):
        self.a, self.order = arrays, order
        self.whole = "contexts" in arrays
        self.entries = Table(arrays["keys"])
        self.words = Table(arrays["words"]) if "words" in arrays else None
        if not self.whole:
            self.direct = np.append(arrays["direct"], 0.0)
            return
        self.contexts = Table(arrays["contexts"])
        self.last = math.log10(max(1, 256 - int(arrays["symbols"][0])))

    def symbols(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each window after the others."""
        a, order = self.a, self.order
        at = self.entries.find(tagged(grams, order + 1))
        out = np.where(at >= 0, a["direct"][at] if len(a["direct"]) else 0, 0).astype(np.float64)
        todo = np.flatnonzero(at < 0)
        spent = np.zeros(len(todo))
        begun = np.zeros(len(todo), bool)
        below = np.zeros(len(todo))
        on = np.zeros(len(todo))
        for j in range(order, -1, -1):
            g = grams[todo]
            if j < order:
                at = self.entries.find(tagged(g, j + 1))
                hit = at >= 0
                out[todo[hit]] = np.where(begun[hit], spent[hit] + a["weight"][at[hit]] - below[hit], a["direct"][at[hit]])
                todo, spent, begun, below, on, g = todo[~hit], spent[~hit], begun[~hit], below[~hit], on[~hit], g[~hit]
            spent[begun] += on[begun]
            c = self.contexts.find(tagged(g >> _B, j))
            there = c >= 0
            spent[there & ~begun] = a["leave"][c[there & ~begun]]
            below[there], on[there] = a["below"][c[there]], a["on"][c[there]]
            begun |= there
        out[todo] = spent - self.last
        return out

    def score(self, texts: list[list[bytes]]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of each text: the sum over the windows that are held, the distinct windows that aren't, and how often each is there."""
        grams, starts = windows([spelled(t) for t in texts], self.order)
        if self.whole:
            none = [np.empty(0, np.int64)] * len(texts)
            return np.add.reduceat(self.symbols(grams), starts), none, none
        at = self.entries.find(tagged(grams, self.order + 1))
        sums = np.add.reduceat(self.direct[at], starts)
        far = np.flatnonzero(at < 0)
        text, keys = np.searchsorted(starts, far, "right") - 1, grams[far]
        by = np.lexsort((keys, text))
        text, keys = text[by], keys[by]
        first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])))) if len(far) else far
        times = np.diff(np.append(first, len(far)))
        cuts = np.searchsorted(text[first], np.arange(1, len(texts)))
        return sums, np.split(keys[first].view(np.int64), cuts), np.split(times, cuts)


#: The model that this worker loaded last.
_loaded: dict[tuple[str, int], Model] = {}


def load(uri: str, order: int) -> Model:
    from pyarrow import fs

    if (uri, order) not in _loaded:
        _loaded.clear()  # before the next is read, so that there are never two
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as source:
            _loaded[uri, order] = Model(dict(np.load(source)), order)
    return _loaded[uri, order]


def save_batches(batches: Iterator[pa.RecordBatch], grams_uri: str, words_uri: str, uri: str, order: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Builds what workers hold from the stored grams and words, whose number is bounded, and stores it."""
    import io
    import uuid

    import pyarrow.dataset as ds
    from pyarrow import fs

    def rows(where: str) -> dict[str, np.ndarray]:
        system, path = fs.FileSystem.from_uri(where)
        found = ds.dataset(path, filesystem=system, format="parquet").to_table(use_threads=False)
        return {k: found.column(k).to_numpy() for k in found.column_names}

    for batch in batches:
        grams, frequent = rows(grams_uri), rows(words_uri)
        if whole:
            levels = []
            for j in range(order + 1):
                own = grams["bytes"] == j + 1
                keys = grams["key"][own].astype(np.int64).view(np.uint64)
                by = np.argsort(keys)
                levels.append((keys[by], grams["n"][own][by], grams["of"][own][by]))
            arrays = build(levels)
        else:
            arrays = {"keys": tagged(grams["key"].astype(np.int64).view(np.uint64), order + 1), "direct": grams["p"].astype(np.float64)}
        arrays |= {"words": frequent["key"].astype(np.int64).view(np.uint64), "counts": frequent["n"].astype(np.int64)}
        out = io.BytesIO()
        np.savez(out, **arrays)
        system, path = fs.FileSystem.from_uri(uri)
        temporary = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as to:
            to.write(out.getvalue())
        system.move(temporary, path)
        yield batch


def score_batches(batches: Iterator[pa.RecordBatch], uri: str, order: int, total: int, distinct: int) -> Iterator[pa.RecordBatch]:
    """Each document's scores; rare: hashes of its words that the model hasn't, repeated as they are; far, times: windows that it hasn't."""
    from pyspark import TaskContext

    model = load(uri, order)
    row = TaskContext.get().partitionId() << 33
    den = math.log10(total + 0.1 * (distinct + 1))
    counts = np.append(model.a["counts"], 0)
    logs = np.log10(counts + 0.1) - den
    for ids, texts in held(batches, PIECE):
        score, far, times = model.score(texts)
        lengths = np.array([len(t) + 1 for t in texts])
        hashes = np.fromiter((h for t in texts for h in (*map(_hash.__getitem__, t), END_WORD)), np.uint64, int(lengths.sum()))
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place = model.words.find(hashes)
        known = place >= 0
        base = np.add.reduceat(np.where(known, logs[place], 0.0), starts)
        n_known = np.add.reduceat(known.astype(np.int64), starts)
        rare = [hashes[s : s + n][~known[s : s + n]].view(np.int64) for s, n in zip(starts.tolist(), lengths.tolist())]
        for k in range(0, len(ids), 2048):
            x = slice(k, k + 2048)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row + k, row + min(len(ids), k + 2048)), pa.int64()), pa.array(ids[x], pa.int64()), pa.array(lengths[x]), pa.array(n_known[x]),
                    pa.array(base[x]), pa.array(score[x]), pa.array(rare[x], pa.list_(pa.int64())),
                    pa.array(far[x], pa.list_(pa.int64())), pa.array(times[x], pa.list_(pa.int64())),
                ],
                ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare", "far", "times"],
            )
        row += len(ids)


SCORED = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<long>, far array<long>, times array<long>"


def held_out(doc_id: str):
    """Documents that are not learnt from: a tenth, by the checksum of the id's text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10, F.lit(0)) == 0


def escaped(novel: DataFrame, levels: list[DataFrame], order: int) -> DataFrame:
    """key, p: log10 probability of windows that no training text has. levels[j]: all grams (key, n) of j + 1 bytes.

    From the longest context down, as Model.symbols: d, n and inside are the number of a context's symbols, their counts' sum and
    the sum of the counts that the next shorter context has for them. Tables of at most 2^16 rows are broadcast.
    """
    low = lambda column, size: column.bitwiseAND(F.lit((1 << 8 * size) - 1))
    small = lambda df, size: F.broadcast(df) if size <= 2 else df
    none = F.lit(None)
    rows = novel.select("key", none.cast("double").alias("p"), none.cast("double").alias("spent"), none.cast("long").alias("d"), none.cast("long").alias("inside"))
    for j in range(order, -1, -1):
        context = low(F.shiftright("key", 8), j).alias("context")
        own = levels[j].select(context, "key", "n").join(novel.select(context).distinct(), "context", "left_semi")
        if j:
            shorter = levels[j - 1].select(F.col("key").alias("suffix"), F.col("n").alias("there"))
            own = own.withColumn("suffix", low(F.col("key"), j)).join(small(shorter, j), "suffix")
        else:
            own = own.withColumn("there", F.lit(0))
        stats = own.groupBy("context").agg(F.sum("n").alias("n_"), F.count("*").alias("d_"), F.sum("there").alias("inside_"))
        rows = rows.withColumn("context", context).join(small(stats, j), "context", "left")
        rest = 2 * (F.col("n_") - F.col("inside"))
        begun = F.col("spent").isNotNull()
        if j < order:
            grams = levels[j].select(F.col("key").alias("gram"), F.col("n").alias("c"))
            rows = rows.withColumn("gram", low(F.col("key"), j + 1)).join(small(grams, j + 1), "gram", "left")
            weight = F.log10(2.0 * F.col("c") - 1)
            hit = F.when(begun, F.col("spent") + weight - F.log10(rest)).otherwise(weight - F.log10(2.0 * F.col("n_")))
            rows = rows.withColumn("p", F.coalesce("p", hit))
        on = F.when(rest > 0, F.log10((F.col("d_") - F.col("d")) / rest)).otherwise(0.0)
        leave = F.log10(F.col("d_") / (2 * F.col("n_")))
        rows = rows.select("key", "p", F.when(begun, F.col("spent") + on).otherwise(leave).alias("spent"), F.col("d_").alias("d"), F.col("inside_").alias("inside"))
    return rows.select("key", F.coalesce("p", F.col("spent") - F.log10(F.greatest(F.lit(1), 256 - F.col("d")))).alias("p"))


def score(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, share: float = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of df."""
    spark = df.sparkSession
    workers_see_package(spark)
    if not 0 <= order <= 6:
        raise ValueError("a window and its length must fit in 64 bits: order is 0 to 6")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparvox.llm import ppm

        return ppm.count_batches(batches, order)

    counted = docs.where(~held_out("doc_id")).mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = stage(counted, "counts")
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()}
    positions, (total, distinct) = (sums[0]["n"], (sums[1]["n"], sums[1]["d"])) if sums else (0, (0, 0))

    whole = share * positions <= 1
    level = counts.where("kind = 0").select("key", F.col("n").alias("seen"), "n")
    levels = [level]
    for size in range(order, 0, -1):
        suffix = F.col("key").bitwiseAND(F.lit((1 << 8 * size) - 1))
        level = cut(level.groupBy(suffix.alias("key")).agg(F.sum("seen").alias("seen"), F.count("*").alias("n")))
        levels.insert(0, level)

    def with_wholes(level: DataFrame) -> DataFrame:
        own = level.withColumn("context", F.shiftright("key", 8))
        return own.join(own.groupBy("context").agg(F.sum("n").alias("of")), "context")

    grams_uri, words_uri, uri = (shared_path(spark, f"ppm-{k}") for k in ("grams", "words", "model"))
    if whole:
        kept = None
        for j in range(order, -1, -1):
            own = with_wholes(levels[j]).select(F.lit(j + 1).alias("bytes"), "key", "n", "of")
            kept = own if kept is None else kept.union(own)
    else:
        direct = with_wholes(levels[order]).select("key", "seen", F.log10((2.0 * F.col("n") - 1) / (2.0 * F.col("of"))).alias("p"))
        direct = stage(direct, "windows")
        kept = direct.where(F.col("seen") >= share * positions).select("key", "p")
    kept.write.parquet(grams_uri)
    vocabulary = counts.where("kind = 1").select("key", "n")
    vocabulary.where(F.col("n") >= share * total).write.parquet(words_uri)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparvox.llm import ppm

        return ppm.save_batches(batches, grams_uri, words_uri, uri, order, whole)

    spark.range(1, numPartitions=1).mapInArrow(save, "id long").count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparvox.llm import ppm

        return ppm.score_batches(batches, uri, order, total, distinct)

    scored = stage(docs.mapInArrow(run, SCORED), "scored")
    den = math.log10(total + 0.1 * (distinct + 1))
    rare = scored.select("row", F.explode("rare").alias("key")).join(vocabulary, "key", "left")
    parts = rare.select("row", F.col("n").isNotNull().cast("long").alias("known"), (F.log10(F.coalesce("n", F.lit(0)) + 0.1) - den).alias("base"), F.lit(0.0).alias("sum"))
    if not whole:
        far = scored.select("row", "doc_id", F.explode(F.arrays_zip("far", "times")).alias("x")).select("row", "doc_id", "x.far", "x.times").withColumnRenamed("far", "key")
        novel = cut(far.where(held_out("doc_id")).select("key").distinct().join(direct, "key", "left_anti"))
        every = direct.select("key", "p").union(cut(escaped(novel, levels, order)))
        found = far.join(every, "key").select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("times") * F.col("p")).alias("sum"))
        parts = parts.union(found)
    parts = parts.groupBy("row").agg(F.sum("known").alias("more"), F.sum("base").alias("base"), F.sum("sum").alias("sum"))
    both = scored.drop("rare", "far", "times").join(parts, "row", "left")
    zero = F.lit(0.0)
    return both.select(
        "doc_id", held_out("doc_id").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("sum", zero)).alias("score"),
    )


def adaptive_score(text: bytes, order: int = ORDER) -> float:
    """log10 probability of one text under a trie that starts empty and learns each symbol after coding it."""
    trie: dict[bytes, dict[int, int]] = {}
    history, total = b"\xff" * order, 0.0
    for symbol in spelled(words(text)):
        excluded: set[int] = set()
        coded = -1
        for j in range(order, -1, -1):
            seen = trie.get(history[len(history) - j :])
            rest = {s: c for s, c in seen.items() if s not in excluded} if seen else {}
            if not rest:
                continue
            n = 2 * sum(rest.values())
            if symbol in rest:
                total += math.log10((2 * rest[symbol] - 1) / n)
                coded = j
                break
            total += math.log10(len(rest) / n)
            excluded |= rest.keys()
        if coded < 0:
            total -= math.log10(256 - len(excluded))
        for j in range(max(coded, 0), order + 1):
            node = trie.setdefault(history[len(history) - j :], {})
            node[symbol] = node.get(symbol, 0) + 1
        history = (history + bytes([symbol]))[-order:] if order else b""
    return total


def adaptive(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, n_bytes, code_bits: each document's own adaptive code length."""
    workers_see_package(df.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        from sparvox.llm import ppm

        return pa.array([-ppm.adaptive_score(t or b"", order) / math.log10(2) for t in texts.to_pylist()])

    return df.select(doc_id, F.coalesce(F.octet_length(text), F.lit(0)).alias("n_bytes"), F.arrow_udf(run, "double")(F.col(text).cast("binary")).alias("code_bits"))
