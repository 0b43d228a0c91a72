"""Command line: normalize, score, manifest, mix-mono, dataset pull, dataset verify, models, run, merge-shards. Errors end with status 2."""

from __future__ import annotations

import argparse
import hashlib
import importlib
import inspect
import json
import sys
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from sparvox import __version__
from sparvox.functions import kernels, languages, text
from sparvox.operators import intervals, runs, samples, scoring
from sparvox.runtime import workers_see_package
from sparvox.sources import audio, configs, datasets, jsonl


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("sparvox").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def normalization_manifest() -> dict:
    """Policy, profiles, metrics and the digest of the modules that normalise and score."""
    sources = (kernels, text, languages, scoring, intervals, samples)
    code = hashlib.sha256("\0".join(inspect.getsource(m) for m in sources).encode()).hexdigest()
    return {"version": __version__, "policy": kernels.POLICY, "profiles": list(kernels.PROFILES), "benchmark": kernels.BENCHMARK, "whisper_baseline": kernels.WHISPER, "metrics": languages.PUBLIC_METRIC, "implementation_sha256": code}


def _score(a) -> object:
    if not a.input:
        return scoring.score_pair(None, a.reference, a.hypothesis, language=a.language, metric=a.metric, profile=a.profile)
    spark = session()
    rows = jsonl.read_local(a.input)
    if not rows:
        raise ValueError("no records")
    for i, r in enumerate(rows):
        for k in ("reference", "hypothesis", "language"):
            if not isinstance(r.get(k), str):
                raise ValueError(f"record {i}: {k} must be a text")
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    scores = scoring.score_records(df, metric=a.metric, profile=a.profile)
    dims = tuple(x for x in (a.group_by or "").split(",") if x)
    return {"scores": [json.loads(x) for x in scores.toJSON().collect()], "aggregate": [json.loads(x) for x in scoring.aggregate_records(scores, dims).toJSON().collect()]}


def _mix(a) -> dict:
    done = audio.mono_mix(Path(a.ch1).read_bytes(), Path(a.ch2).read_bytes())
    content = done.pop("content")
    if a.expect_sha256 and a.expect_sha256 != done["sha256"]:
        raise ValueError("the mix has another digest")
    datasets.write_atomic(a.output, content)
    return done


def _verify(a) -> dict:
    clips, receipt = datasets.load_selection(a.root)
    bad = datasets.verify_assets(session(), a.root, clips).where("problem IS NOT NULL").orderBy("clip_id", "channel").collect()
    return {"clips": len(clips), "languages": sorted({c["language"] for c in clips}), "problems": [r.asDict() for r in bad], "selection_sha256": receipt["selection_sha256"]}


def _run(a) -> dict:
    """Transcribes a dataset folder's recordings, which all executors must see, by a backend class; or only says what that would take."""
    clips, receipt = datasets.load_selection(a.root)
    spark = session()
    workers_see_package(spark)
    rows = [(c["clip_id"], ch, x["path"], float(x["duration_s"])) for c in clips for ch, x in sorted((c.get("audio") or {}).items())]
    tasks = spark.createDataFrame(rows, "sample_id string, channel string, path string, duration_s double")
    if a.preflight:
        return runs.preflight(tasks.select("sample_id", "channel"), tasks.groupBy("sample_id").agg(F.max("duration_s").alias("duration_s")))
    module, _, name = a.backend.partition(":")
    backend = getattr(importlib.import_module(module), name)()
    root = str(Path(a.root).resolve())

    def read(paths: pa.Array) -> pa.Array:
        return pa.array([(Path(root) / datasets.safe_relative_path(x)).read_bytes() for x in paths.to_pylist()], pa.binary())

    spec = {"dataset": receipt["source_id"], "revision": receipt["resolved_revision"], "selection_sha256": receipt["selection_sha256"], "config": {"backend": a.backend}}
    wanted = tasks.select("sample_id", "channel", F.arrow_udf(read, "binary")("path").alias("content"))
    return runs.execute(spark, wanted, backend, a.output, spec, shard=a.shard, shards=a.shards)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparvox", description=__doc__)
    sub = p.add_subparsers(required=True)

    def verb(name, run, *options, parent=sub):
        c = parent.add_parser(name)
        for names, kw in options:
            c.add_argument(*names, **kw)
        c.set_defaults(run=run)

    language, profile = (("--language",), {}), (("--profile",), {"default": "benchmark"})
    verb("normalize", lambda a: {"text": kernels.normalize(a.text, a.language, a.profile), "normalizer": kernels.key_for(a.language, a.profile), "policy": kernels.POLICY}, (("text",), {}), language, profile)
    options = ((("--reference",), {"default": ""}), (("--hypothesis",), {"default": ""}), language, profile, (("--metric",), {"default": "auto", "choices": ["auto", *languages.METRICS]}), (("--input",), {}), (("--group-by",), {}))
    verb("score", _score, *options)
    verb("manifest", lambda a: normalization_manifest())
    verb("models", lambda a: {k: {"provider": r["provider"], "tasks": list(r["tasks"])} for k, r in configs.model_catalog().items()})
    verb("mix-mono", _mix, (("ch1",), {}), (("ch2",), {}), (("output",), {}), (("--expect-sha256",), {}))
    whole = {"type": int}
    verb("run", _run, (("root",), {}), (("output",), {}), (("--backend",), {"default": ""}), (("--shard",), whole | {"default": 0}), (("--shards",), whole | {"default": 1}), (("--preflight",), {"action": "store_true"}))
    verb("merge-shards", lambda a: runs.merge_runs(session(), a.shards, a.output), (("shards",), {"nargs": "+"}), (("--output",), {"required": True}))
    d = sub.add_parser("dataset").add_subparsers(required=True)
    many = {"action": "append"}
    pull = ((("source",), {}), (("root",), {}), (("--revision",), {"default": "latest"}), (("--language",), many), (("--id",), many), (("--limit",), {"type": int}))
    verb("pull", lambda a: datasets.materialize(datasets.DirectorySource(a.source), a.root, revision=a.revision, languages=a.language, ids=a.id, limit=a.limit), *pull, parent=d)
    verb("verify", _verify, (("root",), {}), parent=d)
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    try:
        done = a.run(a)
    except (ValueError, TypeError, OSError) as e:
        p.error(str(e))
    json.dump(done, sys.stdout, sort_keys=True, indent=2, allow_nan=False, ensure_ascii=False)
    print()
    return 2 if isinstance(done, dict) and done.get("problems") else 0


if __name__ == "__main__":
    sys.exit(main())
