"""Normalizers, tokens, alignment and assignment against published expectations and brute force."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparvox.functions import kernels, languages, normalize, text

CASES = [
    ("whisper_basic", "Héllo, Straße!", "héllo straße "),
    ("whisper_english", "Twenty-one dollars and fifty cents.", "$21.50"),
    ("whisper_english", "double oh seven", "007"),
    ("whisper_english", "It's the colour of two hundred and five grey cats, isn't it?", "it is the color of 205 gray cats is not it"),
    ("unicode_marks", "ÉTÉ [noise] <laugh> (aside)", "été"),
    ("turkic", "İSTANBUL ISPARTA, ŞİİR!", "istanbul ısparta şiir"),
    ("cjk", "學習，ｶﾞｸｾｲ！한글", "學習 ガクセイ 한글"),
    ("chinese_t2s", "學習語言，臺灣", "学习语言 台湾"),
    ("arabic", "أُسْتَاذة ـإلى", "استاذة الي"),
    ("thai", "ภาษาไทยฯ TV! ป่า", "ภาษาไทย tv ป่า"),
    ("annotations", "one {발음: 하나} {2} [noise] two", "one 2 two"),
]


@pytest.mark.parametrize("key,said,want", CASES)
def test_normalizers(key, said, want):
    assert kernels.BY_KEY[key](said) == want


def test_parentheses_and_escapes():
    assert " ".join(kernels.strip_parentheses("a （b (c) d） e").split()) == "a e"
    assert kernels.strip_parentheses("a\\u3000b (x") == "a　b  x"


def test_normalizers_in_spark(spark):
    df = spark.createDataFrame([(said, key) for key, said, _ in CASES] + [(None, "thai")], "said string, key string")
    for key, said, want in CASES[::3]:
        got = {r[0]: r[1] for r in df.select("said", normalize.by_key(F.col("said"), key)).collect()}
        assert got[said] == want and got[None] is None
    rows = spark.createDataFrame([("日 本 語", "ja-JP"), ("Ｅｔé!", "fr"), ("x", None)], "t string, lang string")
    got = [tuple(r) for r in normalize.with_metadata(rows, "t", "lang").select("normalized.text", "normalized.language", "normalized.normalizer").collect()]
    assert got == [("日本語", "ja", "cjk"), ("eté", "fr", "unicode_marks"), ("x", None, "whisper_basic")]
    assert [r[0] for r in rows.select(normalize.custom(str.upper)(F.col("t"))).collect()] == ["日 本 語", "ＥＴÉ!", "X"]


def test_column_cleanup_equals_the_kernels(spark):
    said = ["a [b] <c>d</c> {e} {2}", "x (y (z)) w", "", "  q  ", "{12} [long" + "x" * 90 + "]", "mixed （a） \\u00a0b", "tab\tnew\nline\x1cfs"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    c = F.col("s")
    got = df.orderBy("i").select(text.strip_tags(c), text.strip_annotations(c), text.strip_parentheses(c), text.tokens(c, "wer"), text.tokens(c, "cer")).collect()
    for s, r in zip(said, got):
        assert (r[0], r[2]) == (kernels.strip_tags(s), kernels.strip_parentheses(s))
        assert r[1] == (kernels.strip_annotations(s) if s else "")
        assert (r[3], r[4]) == (kernels.tokens(s, "wer"), kernels.tokens(s, "cer"))


def test_redaction(spark):
    df = spark.createDataFrame([("failed: api_key=abcd1234 with Bearer abcdefghijkl and sk-aaaaaaaaaaaa",)], "m string")
    got = df.select(text.redact(F.col("m"))).first()[0]
    assert "abcd1234" not in got and "abcdefghijkl" not in got and "aaaaaaaaaaaa" not in got and got.startswith("failed:")


def test_languages(spark):
    languages.validate_public_metrics()
    with pytest.raises(ValueError):
        languages.validate_public_metrics({"en": "wer"})
    assert languages.canonical(" PT_br ") == "pt" and languages.canonical("  ") is None and languages.canonical(None) is None
    assert languages.resolve_metric("vi") == ("vi", "wer", "ser") and languages.resolve_metric("zh-Hant") == ("zh", "cer", "cer")
    for bad in (("zh", "wer"), ("en", "ser"), ("en", "per")):
        with pytest.raises(ValueError):
            languages.resolve_metric(*bad)
    df = spark.createDataFrame([(" PT_br ",), ("vi",), ("ja",), ("xx",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(languages.canonical_language(F.col("t")), languages.public_metric(F.col("t")), languages.source_metric(F.col("t")), languages.metric_for(F.col("t"))).collect()]
    assert got == [("pt", "wer", "wer", "wer"), ("vi", "wer", "ser", "ser"), ("ja", "cer", "cer", "cer"), ("xx", None, None, "wer"), (None, None, None, "wer"), (None, None, None, "wer")]


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_edits(a, b):
    s, d, i, h = kernels.edit_counts(a, b)
    assert s + d + i == brute_distance(a, b) == kernels.distance(a, b)
    assert s + d + h == len(a) and d - i == len(a) - len(b)


def test_edits_of_long_pairs_are_halved(monkeypatch):
    rng = random.Random(2)
    a = [rng.randrange(50) for _ in range(300)]
    b = [x for x in a if rng.random() > 0.1] + [7] * 9
    want = brute_distance(a, b)
    monkeypatch.setattr(kernels, "MOST_CELLS", 2000)
    s, d, i, h = kernels.edit_counts(a, b)
    assert s + d + i == want and s + d + h == len(a)


def test_edit_columns(spark):
    df = spark.createDataFrame([("alpha beta gamma", "alpha delta extra"), ("a", ""), ("", "b c"), ("", "")], "r string, h string")
    r, h = text.tokens(F.col("r"), "wer"), text.tokens(F.col("h"), "wer")
    got = [tuple(x[0]) + tuple(x[1:]) for x in df.select(normalize.edit_counts(r, h), text.token_distance(r, h), normalize.token_distance(r, h)).collect()]
    assert got == [(2, 0, 0, 1, 2, 2), (0, 1, 0, 0, 1, 1), (0, 0, 2, 0, 2, 2), (0, 0, 0, 0, 0, 0)]


def test_assignment():
    rng = np.random.default_rng(4)
    for _ in range(150):
        n, m = rng.integers(1, 6, 2).tolist()
        costs = np.round(rng.random((n, m)), 3).tolist()
        k = min(n, m)
        totals = [sum(costs[i][j] for i, j in zip(r, c)) for r in itertools.combinations(range(n), k) for c in itertools.permutations(range(m), k)]
        for maximize, best in ((False, min(totals)), (True, max(totals))):
            pairs = kernels.assign(costs, maximize)
            assert len(pairs) == k and sum(costs[i][j] for i, j in pairs) == pytest.approx(best)
    assert kernels.assign([]) == []


def test_best_matches_equal_assignment():
    rng = random.Random(2)
    for _ in range(60):
        n, m = rng.randrange(1, 7), rng.randrange(1, 7)
        gains = {(i, j): rng.choice([rng.random() * 9, float(rng.randrange(1, 4))]) for i in range(n) for j in range(m) if rng.random() < 0.5}
        chosen = kernels.best_matches([(i, j, g) for (i, j), g in gains.items()])
        assert len({p[0] for p in chosen}) == len({p[1] for p in chosen}) == len(chosen)
        best = sum(gains.get(x, 0) for x in kernels.assign([[gains.get((i, j), 0.0) for j in range(m)] for i in range(n)], maximize=True))
        assert abs(sum(p[2] for p in chosen) - best) < 1e-9
    assert kernels.best_matches([]) == []


def test_best_flow_equals_assignment_of_every_copy():
    rng = random.Random(5)
    for _ in range(60):
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        supply, demand = ([rng.randrange(1, 5) for _ in range(k)] for k in (n, m))
        gains = {(i, j): rng.choice([rng.random() * 9, float(rng.randrange(1, 4))]) for i in range(n) for j in range(m) if rng.random() < 0.6}
        pairs = list(gains)
        rng.shuffle(pairs)
        i, j = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        found = kernels.best_flow(i, j, np.array([gains[p] for p in pairs]), np.array(supply), np.array(demand))
        rows, columns = ([k for k, q in enumerate(x) for _ in range(q)] for x in (supply, demand))
        table = [[gains.get((a, b), 0.0) for b in columns] for a in rows]
        assert found == pytest.approx(sum(table[a][b] for a, b in kernels.assign(table, maximize=True)))


def test_distance_takes_the_shorter_side_step_by_step():
    class Counted(list):
        steps = 0

        def __iter__(self):
            for x in super().__iter__():
                Counted.steps += 1
                yield x

        def __getitem__(self, k):
            found = super().__getitem__(k)
            return Counted(found) if isinstance(k, slice) else found

    long, short = Counted([1, *range(5000), 2]), Counted([1, 3, 9, 7, 2])
    for pair in ((long, short), (short, long)):
        assert kernels.distance(*pair) == brute_distance(list(long), list(short))
    same = Counted(range(5000))
    Counted.steps = 0
    assert kernels.distance(same, Counted(range(5000))) == 0 and Counted.steps == 0


def test_english_rules_are_searched_for_only_where_they_can_hold(monkeypatch):
    tried = []

    class Pattern:
        def __init__(self, part, pattern):
            self.part, self.pattern = part, pattern

        def sub(self, put, text):
            tried.append(self.part)
            return self.pattern.sub(put, text)

    monkeypatch.setattr(kernels, "_CONTRACTIONS", [(part, Pattern(part, p), put) for part, p, put in kernels._CONTRACTIONS])
    assert kernels.whisper_english("Plain words, only 1,234 of them") == "plain words only 1234 of them" and not tried
    assert kernels.whisper_english("We won't go, Mr. Grey") == "we will not go mister gray" and set(tried) == {"won't", "mr", "st"}


def test_few_rows_of_a_batch_are_python_objects(monkeypatch):
    import pyarrow as pa

    taken = []
    array = pa.array([["a"] * k for k in range(1000)])
    sizes = lambda r: taken.append(1) or len(r)
    monkeypatch.setattr(normalize, "SLICE", 64)
    made = []
    whole = pa.concat_arrays
    monkeypatch.setattr(normalize.pa, "concat_arrays", lambda parts: made.append([len(p) for p in parts]) or whole(parts))
    assert normalize.mapped(sizes, pa.int64(), array).to_pylist() == list(range(1000)) and len(taken) == 1000
    assert max(made[0]) == 64
    rows = pa.array([["a", None], None, [], ["b"], ["c", "d"]])
    for k in range(5):
        assert normalize.objects(rows.slice(k, 3)) == rows.slice(k, 3).to_pylist()


def test_edit_tables_take_bits():
    import tracemalloc

    rng = random.Random(6)
    a, b = ([rng.randrange(900) for _ in range(2000)] for _ in range(2))
    tracemalloc.start()
    s, d, i, h = kernels.edit_counts(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert s + d + i == kernels.distance(a, b) and most < 4_000_000  # 16 MB as numbers
