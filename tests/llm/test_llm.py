"""The ten operators against brute force, on small tables and on the odd cases that their docstrings define."""

from __future__ import annotations

import array
import base64
import collections
import hashlib
import io
import itertools
import json
import math
import random
import re
import time
import tracemalloc
import types
import weakref
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sparvox.runtime import stage
from sparvox.llm import _chi2, _texts, byte_bpe, components, lines, minhash, mixing, ppm, quality, queries, srs, url_lists, warc, wavelet

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "a", "a b", "a  b", " a", "b ", "\n", "a\n b", "don't I'll", "x y z", "naïve 中文 12,5%", "  q", "<|endoftext|>", "\U0001f600 ok", "tab\tin", "word, Word. WORD"]


def documents(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("n", F.lit(1)).withColumn("rank", F.lit("x")) if extra else df


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r for r in docs.collect()}


# Byte-level BPE


@pytest.fixture(scope="module")
def reference_encoding():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_rank_files_library(spark, docs, reference_encoding):
    found = {r["doc_id"]: r for r in byte_bpe.digests(docs, queries.tokenizer_file("byte_bpe_50k.tiktoken")).collect()}
    assert len(found) == docs.count()
    for row in docs.collect():
        ids = array.array("I", reference_encoding.encode_ordinary(row["text"]))
        got = found[row["doc_id"]]
        assert (got["n_tokens"], got["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got["decoded_sha256"] == hashlib.sha256(row["text"].encode()).hexdigest()


def test_bpe_odd_texts(reference_encoding):
    codec = byte_bpe.codec(queries.tokenizer_file("byte_bpe_50k.tiktoken"), byte_bpe.PATTERN)
    rng = random.Random(5)
    made = ["".join(rng.choice("ab \n\t  '  sé中1 \x0b\x1c\x85​!#.,\U0001f600\x00▁") for _ in range(rng.randrange(40))) for _ in range(3000)]
    for text, ids in zip(ODD + made, codec.encode(ODD + made)):
        assert array.array("I", ids).tolist() == reference_encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
        assert " ".join(_texts.chunks(text)) == text


def test_bpe_nulls_and_clashing_columns(spark):
    path = queries.tokenizer_file("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (1, "a b", "y")], "doc_id long, text string, ids string")
    rows = byte_bpe.decode(byte_bpe.encode(df, path), path).collect()
    assert sorted(bytes(r["decoded"]) for r in rows) == [b"", b"a b", b"a b"]
    assert byte_bpe.encode(df.limit(0), path).count() == 0


def test_serialised_model_has_every_piece():
    import sentencepiece

    ranks = byte_bpe.read_ranks(queries.tokenizer_file("byte_bpe_50k.tiktoken"))
    model = sentencepiece.SentencePieceProcessor(model_proto=byte_bpe.serialise(ranks))
    assert model.get_piece_size() == len(ranks) + 1
    assert all(model.get_score(r) == -r for r in range(0, len(ranks), 997))


# Wavelet matrix


def test_wavelet_matrix_answers_from_the_file():
    rng = np.random.default_rng(1)
    tokens = np.minimum(rng.zipf(1.3, 20_000), 50_000).astype(np.uint16)
    lengths = np.array([5000, 0, 15_000])
    matrix = wavelet.WaveletMatrix(io.BytesIO(wavelet.serialise(np.array([3, 4, 9]), lengths, tokens)))
    assert (matrix.tokens() == tokens).all()
    assert [x.tolist() for x in matrix.documents()] == [[3, 4, 9], lengths.tolist()]
    for i in rng.integers(0, len(tokens), 50).tolist():
        assert matrix.access(i) == tokens[i]
    for token in [1, 2, 7, 50_000, 12_345]:
        places = np.flatnonzero(tokens == token)
        assert matrix.count(token) == len(places)
        assert matrix.count(token, 777, 9_999) == int(((places >= 777) & (places < 9_999)).sum())
        for nth in range(0, len(places), max(1, len(places) // 7)):
            assert matrix.select(token, nth) == places[nth]
    with pytest.raises(IndexError):
        matrix.select(49_999, 10**6)


def test_wavelet_round_trip(spark, docs, texts, monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    more = spark.createDataFrame([(-7, None), (10**12, "")], "doc_id long, text string")
    rows = wavelet.round_trip(docs.select("doc_id", "text").union(more), path).collect()
    start = 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        text = texts[r["doc_id"]]["text"] if r["doc_id"] in texts else ""
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert wavelet.round_trip(more.limit(0), path).count() == 0


def test_wavelet_encoder_odd_texts():
    encoder = wavelet.encoder(queries.tokenizer_file("byte_bpe_50k.json"))
    for text, ids in zip(ODD, encoder.encode(ODD)):
        assert array.array("I", ids).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_wavelet_encoder_knows_added_tokens():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), wavelet.encoder(path)
    some = ["a <|endoftext|> b", "plain", "<|endoftext|>", "", "x<|endoftext|><|endoftext|>y\n", "<|endoftext", *ODD]
    for texts in (some, some[:1], some[1:2]):
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert array.array("I", ids).tolist() == library.encode(text, add_special_tokens=False).ids
    assert array.array("I", encoder.encode(some)[0]).tolist() == [64, 220, 50256, 275]


# MinHash


def shingle_set(text, size=5):
    found = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def brute_components(sets, percent):
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    by_shingle = collections.defaultdict(list)
    for k, s in sets.items():
        for x in s:
            by_shingle[x].append(k)
    pairs = {p for ks in by_shingle.values() for p in itertools.combinations(sorted(ks), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_equals_brute_force(spark, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in docs.collect()}
    want = brute_components(sets, percent)
    rows = minhash.near_duplicates(docs, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {k: (len(sets[k]), c, c == k) for k, c in want.items()}


def test_minhash_finds_copies_around_a_centre_and_chains(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(1000, " ".join(base))]
    for k in range(300):
        edited = list(base)
        edited[rng.randrange(200)] = f"x{k}"
        edited[rng.randrange(200)] = f"y{k}"
        rows.append((k, " ".join(edited)))
    for k in range(40):  # each is near the one before only
        base2 = base2[5:] + [f"z{rng.randrange(10**6)}" for _ in range(5)] if k else [f"v{i}" for i in range(150)]  # noqa: F821
        rows.append((2000 + k, " ".join(base2)))
    rows += [(3000 + k, "same text of seven words in all") for k in range(50)] + [(4000, None), (4001, ""), (4002, " \n"), (4003, "One TWO"), (4004, "one two"), (4005, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(5)).withColumn("key", F.lit("k"))
    want = brute_components({k: shingle_set(t) for k, t in rows}, 85)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, percent=85).collect()}
    assert got == want
    assert minhash.deduplicate(df, percent=85).columns == ["doc_id", "text", "n", "key"]
    assert minhash.deduplicate(df, percent=85).count() == len(set(want.values()))


def test_minhash_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string")
    rows = [tuple(r) for r in minhash.near_duplicates(df).collect()]
    assert sorted(rows, key=str) == sorted([(None, 2, None, True), (5, 2, 5, True), (7, 2, 5, False), (7, 2, 5, False)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_minhash_one_id_with_several_texts(spark):
    rng = random.Random(12)
    a, b, c = ([f"{x}{rng.randrange(10**6)}" for _ in range(120)] for x in "abc")
    rows = [(1, " ".join(a)), (9, " ".join(a[:-2])), (9, " ".join(b)), (9, " ".join(c)), (12, " ".join(b[2:])), (15, " ".join(c)), (20, "alone " + " ".join(c[:9])), (21, None), (21, "x")]
    got = collections.defaultdict(set)
    for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect():
        got[r["doc_id"]].add(r["component_id"])
    assert got == {1: {1}, 9: {1}, 12: {1}, 15: {1}, 20: {20}, 21: {21}}


def test_minhash_in_mixed_buckets_of_many_copies(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    families = []
    for _ in range(8):  # too far from each other to be linked, but with buckets in common
        family = list(base)
        for at in rng.sample(range(160), 4):
            family[at] = f"f{rng.randrange(10**9)}"
        families.append(family)
    rows = []
    for k in range(160):
        text = list(families[k % 8])
        text[rng.randrange(160)] = f"x{k}"
        rows.append((k, " ".join(text)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert got == brute_components({k: shingle_set(t) for k, t in rows}, 85) and 1 < len(set(got.values())) <= 8


def test_densified_bins_agree_as_often_as_sets_do():
    rng = np.random.default_rng(9)
    for size in (12, 60, 400):
        rates = []
        for _ in range(150):
            pool = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(pool[: int(size * 0.95)]), np.unique(pool[int(size * 0.05) :])
            rates.append((minhash.signature(a) == minhash.signature(b)).mean())
        union = len(np.union1d(pool[: int(size * 0.95)], pool[int(size * 0.05) :]))
        want = len(np.intersect1d(pool[: int(size * 0.95)], pool[int(size * 0.05) :])) / union
        assert abs(np.mean(rates) - want) < 0.03


def test_components(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    root = {k: k for e in edges for k in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    assert {r["id"]: r["component"] for r in components.connected(df).collect()} == root
    assert components.connected(df.limit(0)).count() == 0


# Prediction by partial matching


def brute_tries(train, order):
    """Full counts of every context by update exclusion: a window counts once in the shorter context for each longer one."""
    top = collections.Counter()
    for t in train:
        data = b"\xff" * order + t
        top.update(data[i : i + order + 1] for i in range(len(t)))
    tries = {}
    level = dict(top)
    while level:
        for g, n in level.items():
            tries.setdefault(g[:-1], {})[g[-1]] = n
        if len(next(iter(level))) == 1:
            break
        level = collections.Counter(g[1:] for g in level)
    return tries


def brute_symbol(tries, context, symbol):
    total, excluded = 0.0, set()
    for j in range(len(context) + 1):
        rest = {s: c for s, c in tries.get(context[j:], {}).items() if s not in excluded}
        if not rest:
            continue
        n = 2 * sum(rest.values())
        if symbol in rest:
            return total + math.log10((2 * rest[symbol] - 1) / n)
        total += math.log10(len(rest) / n)
        excluded |= rest.keys()
    return total - math.log10(256 - len(excluded))


@pytest.mark.parametrize("order", [0, 3, 5])
def test_ppm_equals_brute_force(spark, docs, texts, order):
    rows = {r["doc_id"]: r for r in ppm.score(docs, order=order, share=0.0).collect()}
    spelled = {k: ppm.spelled([w.encode() for w in WORD.findall(r["text"])]).lower() for k, r in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    tries = brute_tries([t for k, t in spelled.items() if not held[k]], order)
    count = collections.Counter(w for k, t in spelled.items() if not held[k] for w in [*t[:-1].split(), b"\xff"])
    total = sum(count.values())
    for k in list(texts)[::20]:
        t = spelled[k]
        data = b"\xff" * order + t
        want = sum(brute_symbol(tries, data[i : i + order], t[i]) for i in range(len(t)))
        tokens = [*t[:-1].split(), b"\xff"]
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in tokens)
        r = rows[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(tokens), sum(w in count for w in tokens), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(want, rel=1e-4)


def test_ppm_leaves_rare_words_to_the_join(docs):
    a = {r["doc_id"]: r for r in ppm.score(docs, share=0.0).collect()}
    b = {r["doc_id"]: r for r in ppm.score(docs, share=1e-3).collect()}
    for k, r in a.items():
        assert (r["n_known"], r["n_tokens"]) == (b[k]["n_known"], b[k]["n_tokens"])
        assert r["base_score"] == pytest.approx(b[k]["base_score"], rel=1e-9)


@pytest.mark.parametrize("order", [0, 3, 5])
def test_ppm_scores_do_not_depend_on_what_workers_hold(docs, order):
    whole = {r["doc_id"]: r for r in ppm.score(docs, order=order, share=0.0).collect()}
    for share in (1e-4, 2.0):
        for r in ppm.score(docs, order=order, share=share).collect():
            assert r["score"] == pytest.approx(whole[r["doc_id"]]["score"], rel=1e-6)
            assert r["base_score"] == pytest.approx(whole[r["doc_id"]]["base_score"], rel=1e-9)
            assert r["n_known"] == whole[r["doc_id"]]["n_known"]


def test_ppm_probabilities_add_up():
    texts = [ppm.spelled(t) for t in ([b"abra", b"cadabra"], [b"abra"], [b"bar"])]
    for least in (0, 2):
        grams, counts = np.unique(ppm.windows(texts, 3)[0], return_counts=True)
        levels, seen = [], counts
        for size in range(4, 0, -1):
            if size < 4:
                grams, at = np.unique(grams & np.uint64((1 << 8 * size) - 1), return_inverse=True)
                seen, counts = np.bincount(at, seen).astype(np.int64), np.bincount(at).astype(np.int64)
            _, at = np.unique(grams >> np.uint64(8), return_inverse=True)
            of = np.bincount(at, counts).astype(np.int64)[at]
            keep = seen >= least
            levels.append((grams[keep], counts[keep], of[keep]))
        model = ppm.Model(ppm.build(levels[::-1]), 3)
        for context in (b"abr", b"bra", b"zzz", b"\xff\xff\xff", b"zab"):
            windows = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
            assert (10 ** model.symbols(windows)).sum() == pytest.approx(1, rel=1e-5)


def test_ppm_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (3, "a b"), (3, "a b")], "doc_id long, text string").withColumn("score", F.lit("s"))
    rows = ppm.score(df).collect()
    assert sorted(r["n_tokens"] for r in rows) == [1, 1, 3, 3, 3]
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    assert all(math.isfinite(r["score"]) for r in rows)
    assert ppm.score(df.limit(0)).count() == 0
    alone = ppm.score(df.where("doc_id IS NULL")).first()
    assert (alone["train_tokens"], alone["n_known"], alone["score"]) == (0, 0, pytest.approx(-4 * math.log10(256)))


def test_ppm_workers_memory_is_bounded(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(60_000)}" for _ in range(300)).encode() for _ in range(1600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text"])
    arrays = {"keys": np.empty(0, np.uint64), "direct": np.empty(0), "words": np.empty(0, np.uint64), "counts": np.empty(0, np.int64)}
    monkeypatch.setattr(ppm, "load", lambda uri, order, model=ppm.Model(arrays, 5): model)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    count, far, peaks = collections.Counter(), collections.Counter(), []
    for run in (lambda: ppm.count_batches(iter([batch]), 5), lambda: ppm.score_batches(iter([batch]), "", 5, 1, 1)):
        ppm._hash.clear()
        tracemalloc.start()
        most = 0
        for out in run():
            most = max(most, tracemalloc.get_traced_memory()[1])
            if out.num_columns == 3:  # Arrow's own memory isn't traced
                count.update({0: pc.sum(pc.if_else(pc.equal(out["kind"], 0), out["n"], 0)).as_py(), 1: pc.sum(pc.if_else(pc.equal(out["kind"], 1), out["n"], 0)).as_py()})
            else:
                far.update(rows=out.num_rows, windows=pc.sum(out["times"].flatten()).as_py(), tokens=pc.sum(out["n_tokens"]).as_py())
        peaks.append(most >> 20)
        tracemalloc.stop()
    symbols = sum(len(t) + 1 for t in texts)
    assert (count[0], count[1]) == (symbols, 301 * len(texts))
    assert far == {"rows": len(texts), "windows": symbols, "tokens": 301 * len(texts)}
    assert max(peaks) < 64, peaks


def test_ppm_workers_hold_one_model(tmp_path):
    arrays = ppm.build([])
    for k in range(2):
        np.savez(tmp_path / f"{k}.npz", **arrays)
    first = weakref.ref(ppm.load(f"file://{tmp_path}/0.npz", 5))
    assert ppm.load(f"file://{tmp_path}/0.npz", 5) is first()
    with pytest.raises(FileNotFoundError):
        ppm.load(f"file://{tmp_path}/none.npz", 5)
    assert first() is None
    assert ppm.load(f"file://{tmp_path}/1.npz", 5).order == 5


def test_ppm_adaptive(spark):
    df = spark.createDataFrame([(1, "la " * 200), (2, None)], "doc_id long, text string")
    bits = {r["doc_id"]: r["code_bits"] for r in ppm.adaptive(df).collect()}
    assert 0 < bits[1] < 400 and bits[2] == pytest.approx(8)


# Nearest neighbours


def test_srs_recall_and_form(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    v = np.array([r["embedding"] for r in rows], np.float64)
    ids = np.array([r["vec_id"] for r in rows])
    n = np.sqrt((v * v).sum(axis=1))
    got = collections.defaultdict(list)
    for r in srs.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r)
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 50 == 0)
    hit = 0
    for q, found in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        cosine = (v * v[at]).sum(axis=1) / (n * n[at])
        want = [i for _, i in sorted((-c, i) for c, i in zip(cosine.tolist(), ids.tolist()) if i != q)][:5]
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
        for r in found:
            assert r["score"] == pytest.approx(cosine[int(np.flatnonzero(ids == r["vec_id"])[0])], abs=1e-15)
        hit += len({r["vec_id"] for r in found} & set(want))
    assert hit / (5 * len(got)) >= 0.9


def test_srs_many_cells_and_copies(spark, monkeypatch):
    monkeypatch.setattr(srs, "CELL", 60)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 12))
    v = centres[rng.integers(0, 20, 900)] + 0.2 * rng.standard_normal((900, 12))
    v[300:600] = v[300]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    n = np.sqrt((v * v).sum(axis=1))
    got = collections.defaultdict(list)
    for r in srs.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    hit = 0
    for q in range(0, 900, 50):
        cosine = (v * v[q]).sum(axis=1) / (n * n[q])
        hit += len(set(got[q]) & set([i for _, i in sorted((-c, i) for i, c in enumerate(cosine.tolist()) if i != q)][:5]))
    assert hit >= 0.9 * 18 * 5
    assert got[300] == [301, 302, 303, 304, 305]


def test_srs_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0]), (None, [1.0, 0.0]), (7, [-1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 0.0]), (8, [-1e-200, 1e-220]), (9, [-1e300, -1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit(1))
    got = [tuple(r)[:3] for r in srs.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 1), (0, 3, 9), (0, 4, 7), (0, 5, 8)]
    assert srs.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_chi_square():
    assert _chi2.inverse(0.95, 8) == pytest.approx(15.50731, rel=1e-6)
    assert _chi2.cdf(6.62568, 5) == pytest.approx(0.75, rel=1e-5)
    assert _chi2.tail(_chi2.inverse(1e-6, 5, upper=True), 5) == pytest.approx(1e-6, rel=1e-6)


# WARC


def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    copies = pages.where("page_id < 20").select((F.col("page_id") + 10_000).alias("page_id"), "url", "html")
    odd = spark.createDataFrame([(-5, None, None), (20_000, "u\r\nv", ""), (20_001, "z", "\r\n\r\n")], "page_id long, url string, html string")
    table = pages.union(copies).union(odd)
    rows = table.collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[(r["html"] or "").encode()].append(r["page_id"])
    got = {r["page_id"]: r for r in warc.round_trip(table).collect()}
    assert len(got) == len(rows)
    for r in rows:
        data = (r["html"] or "").encode()
        top = max(by[data])
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want = (len(data), digest, "response" if r["page_id"] == top else "revisit", None if r["page_id"] == top else top)
        g = got[r["page_id"]]
        assert (g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) == want
    assert warc.round_trip(table.limit(0)).count() == 0


def test_warc_reader_verifies():
    good = warc.record(3, "http://a/", b"x" * 200_000, warc.sha1(b"x" * 200_000), None) + warc.record(-4, None, b"x" * 200_000, warc.sha1(b"x" * 200_000), 3)
    found = list(warc.read_records(io.BytesIO(good)))
    assert [f["warc-type"] for f, _ in found] == ["response", "revisit"]
    assert warc.payload_of(*found[0])[2] == b"x" * 200_000
    assert warc.payload_of(*found[1])[:2] == (200_000, warc.sha1(b"x" * 200_000))
    assert warc.page_of(found[1][0]["warc-record-id"].strip("<>")) == -4
    with pytest.raises((warc.Damaged, zlib.error)):
        list(warc.read_records(io.BytesIO(good[:-20])))
    raw = zlib.decompress(warc.record(3, "http://a/", b"abc", warc.sha1(b"abc"), None), 31)
    for bad in (raw.replace(b"abc", b"abd"), raw + b"more", raw[:-6], raw.replace(b"Content-Length: ", b"Content-Length: 9")):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(warc.Damaged):
            list(warc.read_records(io.BytesIO(packer.compress(bad) + packer.flush())))


def test_warc_null_page_ids(spark):
    df = spark.createDataFrame([(None, "u", "a"), (None, "u", "a"), (4, "u", "a"), (4, "u", "a"), (2, "u", "a")], "page_id long, url string, html string")
    rows = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    assert rows == [("2", "revisit", 4), ("4", "response", None), ("4", "response", None), ("None", "response", None), ("None", "response", None)]


# Quality rules


def brute_statistics(text):
    found = WORD.findall(text or "")
    windows = list(zip(found, found[1:], found[2:]))
    count = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    held = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(found)
    return n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(held) - len(set(held)), len(covered)


def test_quality_statistics(spark, docs):
    made = [(-1, None), (-2, ""), (-3, "a b c a b c a b"), (-4, "x\nx\n\n \nx\ny"), (-5, "#a *b $c %d &e |f <g >h"), (-6, "é 中 文 \x0b q"), (-7, "a a a a a"), (-8, "la " * 5000)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in quality.with_statistics(table).collect()}
    for r in table.collect():
        got = rows[r["doc_id"]]
        want = brute_statistics(r["text"])
        assert tuple(got[c] for c in quality.STATISTICS) == want, r["doc_id"]
        assert got["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def brute_mcd(x):
    """The operator's method by itself, in numpy."""
    p, n = quality.P, len(x)
    floors = (np.array(quality.FLOORS) * quality.SCALE) ** 2
    half = quality.COVER / _chi2.cdf(_chi2.inverse(quality.COVER, p), p + 2)

    def scatter(y, factor):
        m = y.mean(axis=0)
        c = factor * ((y.T @ y) / len(y) - np.outer(m, m))
        np.fill_diagonal(c, np.maximum(np.diag(c), floors))
        return m, c

    def distance(m, c):
        z = np.linalg.solve(np.linalg.cholesky(c), (x - m).T)
        return (z * z).sum(axis=0)

    med = np.median(x, axis=0)
    starts = [(med, np.diag(np.maximum((1.4826 * np.median(abs(x - med), axis=0)) ** 2, floors))), scatter(x, 1.0)]
    best = []
    for m, c in starts:
        for _ in range(quality.STEPS):
            bucket = np.maximum(-100, np.floor(quality.BUCKETS * np.log2(np.maximum(distance(m, c), 1e-4))))
            edge = np.sort(bucket)[math.ceil(quality.COVER * n) - 1]
            m, c = scatter(x[bucket <= edge], half)
        best.append((np.linalg.slogdet(c)[1], m, c))
    _, m, c = min(best, key=lambda b: b[0])
    near = _chi2.inverse(0.975, p)
    m, c = scatter(x[distance(m, c) <= near], 0.975 / _chi2.cdf(near, p + 2))
    return distance(m, c)


def test_quality_distances_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id < 30 THEN NULL ELSE 'b' END"))
    rows = quality.report(docs).collect()
    groups = {r["doc_id"]: (r["lang"], r["source"]) for r in docs.select("doc_id", "lang", "source").collect()}
    passed = [r for r in rows if not r["base_failed"]]

    def vector(r):
        n = max(1, r["n_words"])
        values = [math.log(n), math.log(max(1, r["word_chars"]) / n), *(math.log1p(100 * r[c] / n) for c in quality.STATISTICS[2:])]
        return [math.floor(abs(quality.SCALE * v) + 0.5) * (1 if v >= 0 else -1) for v in values]

    want, limit = {}, _chi2.inverse(quality.TAIL, quality.P, upper=True)
    for level in range(3):
        by = collections.defaultdict(list)
        for r in passed:
            by[groups[r["doc_id"]][:level]].append(r)
        for members in by.values():
            if len(members) >= quality.LEAST or not level:
                want |= {r["doc_id"]: d for r, d in zip(members, brute_mcd(np.array([vector(r) for r in members], float)))}
    for r in rows:
        if r["base_failed"]:
            assert not r["kept"] and r["distance"] is None
        elif r["doc_id"] in want:
            assert r["distance"] == pytest.approx(want[r["doc_id"]], rel=1e-6, abs=1e-9)
            assert r["kept"] == (want[r["doc_id"]] <= limit)
    assert sum(r["kept"] for r in passed) < len(passed)


def test_quality_odd_tables(spark):
    rows = [(1, None, None, None), (None, "a " * 60, "en", None), (2, " ".join(f"w{i}" for i in range(60)), None, "s")]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.report(documents(spark, rows)).collect()}
    assert got == {1: (True, False), None: (True, False), 2: (False, True)}
    assert quality.report(documents(spark, rows).limit(0)).count() == 0
    kept = quality.keep_good(documents(spark, rows, extra=True))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n", "rank"] and [r["doc_id"] for r in kept.collect()] == [2]


def test_quality_splits_a_text_a_bounded_number_of_times(docs):
    stand_in = docs.sparkSession.createDataFrame([("every", 1, *[0.0] * 5, *[1.0] * 15, 0.0)], ["g", "n", *(f"m{i}" for i in range(5)), *(f"l{i}_{j}" for i, j in quality.PAIRS), "logdet"])
    judged = quality.judge(quality.with_statistics(docs), stand_in).where("kept")
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("split(") < 12
    began = time.monotonic()
    assert judged.count() >= 0
    assert time.monotonic() - began < 20


def test_quality_small_groups_take_wider_estimates(spark):
    rng = random.Random(8)
    text = lambda n, width: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, width))) for _ in range(n))
    rows = [(k, text(rng.randrange(80, 120), 9), "en", f"s{k % 2}") for k in range(30)] + [(100, "#$% " * 20 + text(80, 9) + " |&<>" * 30, "fr", "t"), (101, text(100, 9), None, None)]
    got = {r["doc_id"]: r for r in quality.report(documents(spark, rows)).collect()}
    assert all(r["distance"] is not None for r in got.values())
    assert not got[100]["kept"] and got[101]["kept"]
    alone = quality.report(documents(spark, rows), least=16).collect()
    assert sum(r["kept"] for r in alone) >= 30


# Mixing


def brute_targets(sizes):
    """Shares by weight; what is above a limit is shared out again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, free, out = mixing.SHARE * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > mixing.LIMIT * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in free}
        for s in full:
            out[s] = mixing.LIMIT * sizes[s]
            left -= out[s]
        free -= full
    return out


@pytest.mark.parametrize("slices", [10_000, 3])
def test_mixing(spark, docs, monkeypatch, slices):
    monkeypatch.setattr(mixing, "SLICE", slices)
    source = F.expr("CASE WHEN doc_id % 2 = 0 THEN 'big' WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'é' ELSE 'Z' END")
    table = docs.withColumn("source", source).select("doc_id", "text", "source")
    table = table.union(spark.createDataFrame([(-1, None, "none"), (-2, "", "none"), (-3, "a b", "two"), (None, "q", "two")], "doc_id long, text string, source string"))
    of = {r["doc_id"]: (r["source"], len(WORD.findall(r["text"] or ""))) for r in table.collect()}
    sizes = collections.Counter()
    for s, n in of.values():
        sizes[s] += n
    want = brute_targets(sizes)
    rows = mixing.report(table).collect()
    taken = collections.Counter()
    for r in rows:
        s, n = of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[s]) and 0 <= r["taken"] <= 2 * n
        assert r["target"] == pytest.approx(want[s], rel=1e-9)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5
    times = [r["first_position"] for r in rows if r["first_position"] is not None]
    assert times == sorted(times) and 0 <= times[0] and times[-1] < 1
    assert sorted(rows, key=str) == sorted(mixing.report(table.repartition(3)).collect(), key=str)


def test_mixing_copies_and_order(spark, docs):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    rows = {r["doc_id"]: r for r in mixing.report(docs).collect()}
    for k, r in rows.items():
        assert copies[k] == (0 if not r["taken"] else 1 if r["taken"] <= r["size"] else 2)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_gives_each_repeated_row_its_place(spark):
    rows = [(None if s < "d" else 7, "x y z", "en", s) for s, n in (("a", 30), ("b", 20), ("c", 50), ("d", 40)) for _ in range(n)]
    table = documents(spark, rows)
    want = {}
    for r in mixing.report(table).collect():
        want[r["source_size"]] = min(2 * r["source_size"] // 3, math.ceil(round(r["target"]) / 3))
    got = collections.Counter(r["source"] for r in mixing.mix(table).collect())
    assert got == {"a": want[90], "b": want[60], "c": want[150], "d": want[120]}


def test_curriculum_shares_follow_the_schedule(spark, docs):
    done = mixing.schedule(mixing.sized(docs)).collect()
    for r in done:
        for t in r["positions"]:
            assert 0 <= t < 1


# URL lists


def test_url_lists_equal_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    want = {r[0]: (r[3], r[4], r[5]) for r in con.sql(url_lists.SQL).fetchall()}
    got = {r["page_id"]: (r["blocked"], r["n_rules"], r["lists"]) for r in url_lists.report(spark.read.parquet(f"{d}/pages.parquet")).collect()}
    assert got == want and any(x[0] for x in got.values()) and not all(x[0] for x in got.values())


@pytest.mark.parametrize("limit", [100_000, 0])
def test_url_lists_as_of(spark, monkeypatch, limit):
    monkeypatch.setattr(url_lists, "BROADCAST_ROWS", limit)
    entries = spark.createDataFrame(
        [
            ("spam", "host", "bad.org", "add", "2024-01-10"), ("spam", "host", "bad.org", "remove", "2024-02-01"), ("spam", "host", "bad.org", "add", "2024-03-01"),
            ("adult", "prefix", "ok.org/x/y", "add", "2024-01-01"), ("adult", "host", "both.org", "add", "2024-01-01"), ("adult", "host", "both.org", "remove", "2024-01-01"),
            ("adult", "host", None, "add", "2024-01-01"), ("adult", "host", "bad.org", "what", "2024-01-01"), (None, "host", "ok.org", "add", "2024-01-01"),
        ],
        "list string, kind string, rule string, action string, effective string",
    ).withColumn("effective", F.col("effective").cast("timestamp"))
    cases = [
        ("http://a.BAD.org:80/q", "2024-01-10", 1), ("http://bad.org", "2024-01-09", 0), ("https://u@bad.org./", "2024-02-01", 0), ("http://bad.org/", "2025-01-01", 1), ("http://notbad.org/", "2024-01-15", 0),
        ("http://ok.org/x/y/z?u", "2024-05-01", 1), ("http://ok.org/x/yz", "2024-05-01", 0), ("http://both.org/", "2024-05-01", 0), (None, "2024-05-01", 0), ("nonsense", "2024-05-01", 0), ("http://bad.org/", None, 0), ("http://bad.org/", "2025-01-01", 1),
    ]
    captures = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, url string, fetched string, want int").withColumn("fetched", F.col("fetched").cast("timestamp")).withColumn("lists", F.lit(1))
    rows = url_lists.evaluate(captures, entries).collect()
    assert len(rows) == len(cases)
    for r in rows:
        assert (r["n_rules"], r["blocked"]) == (r["want"], bool(r["want"])), r
    assert url_lists.evaluate(captures.limit(0), entries).count() == 0
    assert not any(r["blocked"] for r in url_lists.evaluate(captures, entries.limit(0)).collect())


# Lines


def test_lines_equal_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(lines.SQL).fetchall()}
    got = {r["doc_id"]: tuple(r)[1:] for r in lines.report(spark.read.parquet(f"{d}/documents.parquet")).collect()}
    assert got == want and sum(x[1] for x in want.values())


@pytest.mark.parametrize("limit", [100_000, 0])
def test_lines_by_host(spark, monkeypatch, limit):
    from sparvox.llm import _joins

    monkeypatch.setattr(_joins, "BROADCAST_ROWS", limit)
    rows = [(i, f"menu\n\nown {i}\nmenu", "en", "a") for i in range(20)] + [(100 + i, f"menu\nown {i}", "en", None) for i in range(20)]
    rows += [(200 + i, "menu" if i < 5 else f"t{i}", "en", "b") for i in range(60)] + [(300, None, "en", "a"), (301, "", "en", "a"), (302, "menu", "en", "c")]
    df = documents(spark, rows, extra=True)
    out = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(df, host="source", ratio=0.1).collect()}
    assert out[3] == "\nown 3" and out[103] == "own 3" and out[200] == "menu" and out[302] == "menu" and out[300] is None and out[301] == ""
    assert lines.drop_boilerplate(df, host="source").columns == df.columns
    assert lines.drop_boilerplate(df.limit(0), host="source").count() == 0
    counts = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in lines.drop_boilerplate(df, host="source", counts=True).collect()}
    assert counts[3] == (4, 2) and counts[300] == (0, 0) and counts[301] == (1, 0)
    clash = lines.drop_boilerplate(df.withColumn("n_lines", F.lit("x")), host="source", counts=True)
    assert clash.columns == [*df.columns, "n_lines", "n_dropped"] and dict(clash.dtypes)["n_lines"] == "bigint"


def test_lines_planted_among_clean_text(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{rng.randrange(10**4)}" for _ in range(60))
    planted = {"Home | About | Contact": 8, passage: 20, "This work is licensed under the terms of the licence.": 30}
    rows, own = [], {}
    for k in range(400):
        own[k] = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(9)) for _ in range(rng.randrange(1, 9))]
        put = list(own[k])
        for line, every in planted.items():
            if k % every == 0:
                put.insert(rng.randrange(len(put) + 1), line)
        if k in (7, 77, 177, 277):  # too rare to be the site's
            own[k] = put = [*put, "Quoted by some."]
        rows.append((k, "\n".join(put), "en", "site"))
    rows += [(1000 + k, passage, "en", f"elsewhere{k}") for k in range(4)]
    out = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(documents(spark, rows), host="source").collect()}
    assert all(out[k] == "\n".join(x) for k, x in own.items())
    assert all(out[1000 + k] == passage for k in range(4))


# Pipeline and registration


def test_pipeline_stages(spark, docs, texts, sf):
    import corpus_pipeline

    now = docs
    seen = []
    for name, apply in corpus_pipeline.STAGES:
        after = stage(apply(spark, now, sf), "test")
        seen.append(after.count())
        if name != "token ids":
            assert after.columns == docs.columns
        now = after
    assert docs.count() > seen[0] >= seen[1] >= seen[2] > 0 and seen[4] == seen[3]
    failed = {k for k, r in texts.items() if (s := brute_statistics(r["text"]))[0] < 50 or 100 * s[4] > 50 * s[0]}
    assert not failed & {r["doc_id"] for r in now.select("doc_id").collect()}


def brute_quality(rows):
    """Ids of the rows that the base rules and the outlier test accept."""
    passed, by = {}, collections.defaultdict(list)
    for r in rows:
        s = brute_statistics(r["text"])
        n = s[0]
        if n >= 50 and 100 * s[4] <= 50 * n:
            values = [math.log(n), math.log(max(1, s[1]) / n), *(math.log1p(100 * c / n) for c in s[2:])]
            passed[r["doc_id"]] = [math.floor(abs(quality.SCALE * v) + 0.5) * (1 if v >= 0 else -1) for v in values]
            for group in ((), (r["lang"],), (r["lang"], r["source"])):
                by[group].append(r["doc_id"])
    distance = {}
    for group in sorted(by, key=len):
        if len(by[group]) >= quality.LEAST or not group:
            distance |= zip(by[group], brute_mcd(np.array([passed[k] for k in by[group]], float)))
    limit = _chi2.inverse(quality.TAIL, quality.P, upper=True)
    return {k for k in passed if distance.get(k, 0) <= limit}


def brute_lines(rows):
    pages, count = collections.Counter(r["source"] for r in rows), collections.Counter()
    for r in rows:
        count.update((r["source"], line) for line in set(r["text"].split("\n")) if WORD.search(line))
    gone = {k for k, n in count.items() if n >= lines.PAGES and n > lines.RATIO * pages[k[0]]}
    return [r | {"text": "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in gone)} for r in rows]


def brute_mix(rows, place):
    """Each row as often as it is taken; place: the order within a source."""
    sizes, out = collections.Counter(), []
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    want, at = brute_targets(sizes), collections.Counter()
    for r in sorted(rows, key=lambda r: place[r["doc_id"]]):
        n, s = len(WORD.findall(r["text"])), r["source"]
        out += [r for start in (at[s], at[s] + sizes[s]) if n and start < math.floor(want[s] + 0.5)]
        at[s] += n
    return out


def test_pipeline_run_equals_brute_force(spark, docs, reference_encoding, tmp_path):
    import corpus_pipeline

    planted = "This line stands on many pages of one site."
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    for r in rows:
        r["source"] = "abc"[r["doc_id"] % 3]
        if r["source"] == "a" and r["doc_id"] % 2 and r["text"]:
            r["text"] += "\n" + planted
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")

    good = brute_quality(rows)
    assert {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, table, str(tmp_path)).collect()} == good
    kept = brute_lines([r for r in rows if r["doc_id"] in good])
    assert any(planted in r["text"] for r in rows if r["doc_id"] in good) and not any(planted in r["text"] for r in kept)
    root = brute_components({r["doc_id"]: shingle_set(r["text"]) for r in kept}, 80)
    single = [r for r in kept if root[r["doc_id"]] == r["doc_id"]]
    assert 0 < len(single) < len(kept) < len(rows)
    left = spark.createDataFrame([(r["doc_id"], r["text"]) for r in single], "doc_id long, text string")  # the order goes by the texts that the mix is given
    place = {r["doc_id"]: r["h"] for r in left.select("doc_id", mixing.order_hash("doc_id", "text")[0].alias("h")).collect()}
    want = collections.Counter()
    for r in brute_mix(single, place):
        ids = reference_encoding.encode_ordinary(r["text"])
        raw = np.array(ids, "<u4").tobytes()
        want[r["doc_id"], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest(), raw] += 1
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and sum(want.values()) > len(single) / 2


def test_registered_queries():
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= {k.split("_")[0] for k in __spark_entry__.queries()}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    json.dumps(sorted(__spark_entry__.queries()))
