"""JSONL, datasets, recordings, configurations, streams, the command line and the registered queries."""

import hashlib
import json

import duckdb
import numpy as np
import pytest

import __spark_entry__
from sparvox import cli
from sparvox.operators import runs
from sparvox.sources import audio, configs, datasets, jsonl
from sparvox.streaming import results


def test_strict_jsonl(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": null}\n')
    assert [tuple(r) for r in jsonl.read(spark, str(path), "a int, b string").collect()] == [(1, "x"), (2, None)]
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', "[1]", '{"a": ', '{"a": Infinity}'):
        path.write_text('{"a": 1}\n' + bad + "\n")
        with pytest.raises(Exception, match="rows.jsonl"):
            jsonl.read(spark, str(path), "a int").collect()
        with pytest.raises(ValueError, match=":2:"):
            jsonl.read_local(path)
    jsonl.write(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))


def wav(seconds=0.01, value=1000):
    return audio.encode_wav(np.full(int(seconds * 16_000), value / 32767, np.float32))


def clip(name="c-1", **more):
    data = wav()
    alignments = {"ch1": [{"text": "a", "start_s": 0.0, "end_s": 0.01, "words": [{"start": 0.0, "end": 0.01, "text": "a"}]}]}
    return {"schema_version": 2, "clip_id": name, "language": "en-US", "duration_s": 0.01, "audio": {"ch1": {"path": f"audio/{name}.wav", "sha256": hashlib.sha256(data).hexdigest(), "duration_s": 0.01}}, "word_alignments": alignments, "metadata": {}} | more


def test_manifests(spark, tmp_path):
    path = tmp_path / "manifest.jsonl"
    path.write_text("".join(jsonl.dumps(clip(n)) + "\n" for n in ("c-1", "c-2")))
    assert sorted(r["clip_id"] for r in datasets.read_manifest(spark, str(path)).collect()) == ["c-1", "c-2"]
    outside = {"ch1": [{"text": "a", "start_s": 0.0, "end_s": 0.01, "words": [{"start": 0.0, "end": 0.5, "text": "a"}]}]}
    for bad in ({"schema_version": 3}, {"clip_id": "../x"}, {"duration_s": 0}, {"duration_s": True}, {"word_alignments": {}}, {"references": {}}, {"word_alignments": outside}, {"audio": {"ch1": {"path": "/abs", "sha256": "0" * 64, "duration_s": 1}}}):
        assert datasets.clip_problem(clip(**bad)), bad
        path.write_text(json.dumps(clip(**bad)) + "\n")
        with pytest.raises(ValueError):
            datasets.read_manifest(spark, str(path))
    path.write_text((jsonl.dumps(clip()) + "\n") * 2)
    with pytest.raises(ValueError, match="twice"):
        datasets.read_manifest(spark, str(path))


def test_materialize_and_verify(spark, tmp_path):
    source, root = tmp_path / "source", tmp_path / "root"
    for n in ("c-1", "c-2"):
        datasets.write_atomic(source / "audio" / f"{n}.wav", wav())
    (source / "manifest.jsonl").write_text("".join(jsonl.dumps(clip(n)) + "\n" for n in ("c-1", "c-2")))
    receipt = datasets.materialize(datasets.DirectorySource(str(source)), str(root), languages=["EN_us"], ids=["c-2"])
    clips, found = datasets.load_selection(str(root))
    assert [c["clip_id"] for c in clips] == ["c-2"] and found == receipt
    assert [r["problem"] for r in datasets.verify_assets(spark, str(root), clips).collect()] == [None]
    (root / "audio" / "c-2.wav").write_bytes(wav(value=5))
    assert [r["problem"] for r in datasets.verify_assets(spark, str(root), clips).collect()] == ["digest differs"]
    with pytest.raises(ValueError, match="c-9"):
        datasets.materialize(datasets.DirectorySource(str(source)), str(root), ids=["c-9"])
    (root / "selection.jsonl").write_text(jsonl.dumps(clip("c-1")) + "\n")
    with pytest.raises(ValueError):
        datasets.load_selection(str(root))
    (tmp_path / "link").symlink_to(root)
    with pytest.raises(ValueError):
        datasets.write_atomic(tmp_path / "link", b"")
    assert {r["sha256"] for r in datasets.file_digests(spark, str(source / "audio")).collect()} == {hashlib.sha256(wav()).hexdigest()}
    assert datasets.combined_digest({"b": "2", "a": "1"}) == datasets.combined_digest({"a": "1", "b": "2"})
    with pytest.raises(ValueError):
        datasets.safe_relative_path("../x")


def test_release_tables(spark, tmp_path):
    row = ("s1", "en", "en-US", "short", 1.0, 2, "t", "none", 0.0, "f", "m", "set", [(1, 0.0, 0.5, "x", [(0.0, 0.5, "hi")]), (2, 0.5, 0.9, "x", [(0.5, 0.9, "yo")])], (b"abc",))
    df = spark.createDataFrame([row], datasets.RELEASE + ", audio_ch1 struct<bytes:binary>")
    df.coalesce(1).write.parquet(str(tmp_path / "data" / "en" / "en.parquet"))
    rows = datasets.read_release(spark, str(tmp_path / "data" / "en" / "en.parquet"), "en")
    channels = rows.select(datasets.channel_segments(rows.word_alignments).alias("c")).first()["c"]
    assert channels["ch1"][0]["text"] == "hi" and channels["ch2"][0]["end_s"] == 0.9
    assert [bytes(r["content"]) for r in datasets.embedded_audio(rows).collect()] == [b"abc"]
    assert datasets.union_release(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="invalid release row"):
        datasets.read_release(spark, str(tmp_path / "data" / "en" / "en.parquet"), "fr").collect()
    df.drop("topic").write.parquet(str(tmp_path / "bad.parquet"))
    with pytest.raises(ValueError, match="topic"):
        datasets.read_release(spark, str(tmp_path / "bad.parquet"))


def test_audio():
    assert audio.problem(wav(), 0.01) is None and "lasts" in audio.problem(wav(), 0.5) and "unreadable" in audio.problem(b"RIFF", 1)
    info = b"fLaC" + bytes([0x80, 0, 0, 34]) + b"\x10\x00\x10\x00" + b"\0" * 6 + ((16_000 << 44) | (0 << 41) | (15 << 36) | 160).to_bytes(8, "big") + b"\0" * 16
    assert audio.flac_info(info) == (16_000, 1, 16, 160) and audio.problem(info, 0.01) is None
    done = audio.mono_mix(wav(0.01, 30000), wav(0.02, 30000))
    samples, rate = audio.decode_wav(done["content"])
    assert (len(samples), rate, done["duration_s"]) == (320, 16_000, 0.02) and samples.max() > 0.99 and done["sha256"] == hashlib.sha256(done["content"]).hexdigest()
    with pytest.raises(ValueError):
        audio.mix(np.array([np.nan]), np.zeros(1))
    rng = np.random.default_rng(0)
    loud = rng.standard_normal(16_000 * 40).astype(np.float32) * 0.3
    loud[16_000 * 16 : 16_000 * 18] *= 1e-4
    loud[16_000 * 30 : 16_000 * 30 + 8_000] *= 1e-4
    loud[: 16_000 * 5] *= 1e-4
    gaps = audio.silences(loud)
    assert gaps == [(0, pytest.approx(5, abs=0.1)), (pytest.approx(16, abs=0.1), pytest.approx(18, abs=0.1))]  # half a second is a pause in speech
    cuts = audio.windows(40, 20, gaps)
    assert audio.windows(610, 600, [(300, 302)]) == [(0, 301), (301, 610)] and audio.windows(595, 600, [(300, 302)]) == [(0, 301), (301, 595)]
    assert audio.windows(588, 600, []) == [(0, 588)] and audio.windows(589, 600, []) == [(0, 588), (588, 589)]
    assert audio.windows(1000, 600, [(9, 11), (480, 484), (540, 541)]) == [(0, 482), (482, 1000)]
    tone = np.sin(2 * np.pi * 440 * np.arange(48_000) / 48_000).astype(np.float32)
    low = audio.resample(tone, 48_000)
    assert len(low) == 16_000 and np.abs(low - np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000))[200:-200].max() < 1e-3
    assert audio.reusable_mix(done["content"], wav(0.01, 30000), wav(0.02, 30000), done["sha256"])["reused"] and not audio.reusable_mix(b"x", wav(0.01, 30000), wav(0.02, 30000), done["sha256"])["reused"]
    assert cuts[0][1] == pytest.approx(17, abs=0.1) and cuts[-1][1] == 40 and all(b - a <= 20 for a, b in cuts)
    joined = audio.stitch([(0, {"text": "a", "words": [{"text": "a", "start_s": 0, "end_s": 1, "speaker": "x"}]}), (10, {"text": " b", "words": [{"text": "b", "start_s": 1, "end_s": 2, "speaker": "x"}]})])
    assert joined["text"] == "a b" and [(w["start_s"], w["speaker"]) for w in joined["words"]] == [(0, "window0:x"), (11, "window1:x")]


def test_configs(spark, tmp_path):
    good = 'schema_version = 1\nname = "n"\nchannels = ["ch1"]\nsample_rate_hz = 16000\n[model]\nbackend = "openai"\nmodel_id = "m"\n'
    (tmp_path / "c.toml").write_text(good)
    assert configs.load_run_config(str(tmp_path / "c.toml")).channels == ("ch1",)
    for bad in (good.replace("[model]", "x = 1\n[model]"), good.replace('["ch1"]', '["ch1", "ch1"]'), good.replace("16000", "true"), good + "transcribes = false\n", good + 'environment = ["a=b"]\n', good.replace('name = "n"', 'name = ""')):
        with pytest.raises(ValueError):
            configs.parse_run_config(bad)
    assert len(configs.BUILT_IN) == 18 and len({configs.load_run_config(k).digest for k in configs.BUILT_IN}) == 18
    record = 'key = "k"\nname = "n"\nprovider = "p"\ntasks = ["transcription"]\n'
    (tmp_path / "models").mkdir()
    (tmp_path / "models" / "k.toml").write_text(record)
    assert configs.catalog_table(spark, configs.model_catalog(str(tmp_path / "models"))).count() == 1
    with pytest.raises(TypeError):
        configs.model_catalog()["qwen3-asr-1.7b"]["key"] = 1
    with pytest.raises(ValueError):
        configs.model("nothing")
    with pytest.raises(TypeError):
        configs.model(3)


def test_stream_counts_each_task_once(spark, tmp_path):
    incoming, seen = tmp_path / "in", []
    incoming.mkdir()
    row = lambda t, n: json.dumps({"task_id": t, "model": "m", "language": "en", "numerator": n, "denominator": 4, "at": "2025-01-01T00:00:00Z"})
    (incoming / "a.json").write_text(row("1", 1) + "\n" + row("2", 2) + "\n" + row("1", 1) + "\n")
    write = lambda df, n: seen.extend(df.collect())
    for extra in (None, row("2", 2) + "\n" + row("3", 3) + "\n"):
        if extra:
            (incoming / "b.json").write_text(extra)
        results.start(results.once(results.read_results(spark, str(incoming))), write, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted(r["task_id"] for r in seen) == ["1", "2", "3"]
    out = []
    results.start(results.running_rates(results.read_results(spark, str(incoming))), lambda df, n: out.append(df.collect()), str(tmp_path / "c2"), "complete").awaitTermination(120)
    assert out[-1][0]["items"] == 5
    assert results.hourly_rates(results.read_results(spark, str(incoming))).isStreaming


def run_cli(capsys, *argv):
    code = cli.main(list(argv))
    return code, json.loads(capsys.readouterr().out)


class Length(runs.Backend):
    identity = {"name": "length"}

    def transcribe(self, sample_id, channel, content):
        return {"bytes": len(content)}


def test_cli(spark, tmp_path, capsys):
    assert run_cli(capsys, "normalize", "ÉTÉ!", "--language", "fr")[1]["text"] == "été"
    assert run_cli(capsys, "score", "--reference", "a b", "--hypothesis", "a c", "--language", "id")[1]["value"] == 0.5
    path = tmp_path / "pairs.jsonl"
    path.write_text("".join(json.dumps({"reference": "a b", "hypothesis": h, "language": "id", "model": "m", "set": s}) + "\n" for h, s in (("a", "x"), ("a b", "x"), ("c", "y"))))
    done = run_cli(capsys, "score", "--input", str(path), "--group-by", "set")[1]
    assert [(a["dimensions"]["set"], a["numerator"], a["denominator"]) for a in done["aggregate"]] == [("x", 1, 4), ("y", 2, 2)]
    assert run_cli(capsys, "manifest")[1]["policy"] and run_cli(capsys, "models")[1]
    for n, b in (("a", wav()), ("b", wav(0.02))):
        (tmp_path / f"{n}.wav").write_bytes(b)
    assert run_cli(capsys, "mix-mono", str(tmp_path / "a.wav"), str(tmp_path / "b.wav"), str(tmp_path / "m.wav"))[1]["samples"] == 320
    datasets.write_atomic(tmp_path / "src" / "audio" / "c-1.wav", wav())
    (tmp_path / "src" / "manifest.jsonl").write_text(jsonl.dumps(clip()) + "\n")
    assert run_cli(capsys, "dataset", "pull", str(tmp_path / "src"), str(tmp_path / "dst"))[1]["clips"] == 1
    assert run_cli(capsys, "dataset", "verify", str(tmp_path / "dst")) [0] == 0
    assert run_cli(capsys, "run", str(tmp_path / "dst"), str(tmp_path / "out0"), "--preflight")[1]["tasks"] == 1
    found = [run_cli(capsys, "run", str(tmp_path / "dst"), str(tmp_path / f"out{k}"), "--backend", "test_sources:Length", "--shard", str(k), "--shards", "2")[1] for k in (0, 1)]
    assert [m["status"] for m in found] == ["complete"] * 2 and sum(m["coverage"]["successful_total"] for m in found) == 1
    merged = run_cli(capsys, "merge-shards", str(tmp_path / "out0"), str(tmp_path / "out1"), "--output", str(tmp_path / "all"))[1]
    assert merged["status"] == "complete" and json.loads(spark.read.parquet(str(tmp_path / "all" / "results")).first()["output"]) == {"bytes": len(wav())}
    for bad in (["normalize", "x", "--profile", "none"], ["score", "--reference", "a", "--language", "zh", "--metric", "wer"], ["score", "--input", str(tmp_path / "a.wav")]):
        with pytest.raises(SystemExit) as e:
            cli.main(bad)
        assert e.value.code == 2


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in order) for r in map(tuple, rows)) if rows else []


SQL_NAMES = sorted(k for k in __spark_entry__.oracle_sql() if not k.startswith("op") and k != "pipeline")


@pytest.mark.parametrize("name", SQL_NAMES)
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in "customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    key = str
    a, b = ([tuple(round(float(x), 9) if isinstance(x, float) else x for _, x in sorted(zip(cols, r))) for r in rows] for rows, cols in ((map(tuple, got.collect()), got.columns), (want.fetchall(), want.columns)))
    assert sorted(a, key=key) == sorted(b, key=key)


def test_flagship_equals_brute_force(spark, sf):
    from sparvox.functions import kernels
    from sparvox.plans.evaluation import successive

    got = {r["language"]: (r["items"], r["numerator"], r["denominator"]) for r in __spark_entry__.entry(spark).collect()}
    want = {}
    for r in successive(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        a, b = (kernels.punctuation_to_spaces(r[k].lower()).split() for k in ("reference", "hypothesis"))
        i, n, d = want.get(r["language"], (0, 0, 0))
        want[r["language"]] = (i + 1, n + sum(kernels.edit_counts(a, b)[:3]), d + len(a))
    assert got == want
