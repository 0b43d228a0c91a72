"""Evaluation datasets: release tables, manifests, selections with receipts, and their verification."""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import tempfile
from abc import ABC, abstractmethod
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparvox.sources import audio, jsonl

WORD = "struct<start:double,end:double,text:string>"
RELEASE = (
    "sample_id string, language string, locale string, duration_type string, duration_s double, n_speakers long, topic string, overlap_type string, clip_overlap_frac double, "
    f"speaker1_gender string, speaker2_gender string, benchmark_set string, word_alignments array<struct<speaker:long,start:double,end:double,timing_source:string,words:array<{WORD}>>>"
)
OPTIONAL = {"audio_ch1": "struct<bytes:binary>", "audio_ch2": "struct<bytes:binary>", "speaker1_id": "string", "speaker2_id": "string"}
SEGMENT = f"array<struct<text:string,start_s:double,end_s:double,timing_source:string,words:array<{WORD}>>>"
ASSET = "struct<path:string,sha256:string,duration_s:double>"
CLIP = f"schema_version int, clip_id string, language string, duration_s double, audio map<string,{ASSET}>, references map<string,array<struct<text:string,start_s:double,end_s:double>>>, word_alignments map<string,{SEGMENT}>, metadata map<string,string>"
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,199}$"
TABLE = re.compile(r"data/([a-z]{2,3})/\1\.parquet$")


def safe_relative_path(path: str) -> str:
    """The path if it stays below its root."""
    parts = PurePosixPath(path)
    if not path or parts.is_absolute() or ".." in parts.parts or "\\" in path or "\0" in path:
        raise ValueError(f"unsafe path {path!r}")
    return path


def sha256_text(value: str) -> str:
    if not re.fullmatch(r"[0-9a-f]{64}", value or ""):
        raise ValueError("not a lower-case SHA-256")
    return value


def finite(value: object, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{name} must be a finite number")
    return float(value)


# Release tables


def release_tables(root: str) -> dict[str, str]:
    """Language -> table path below a directory, by the layout data/<language>/<language>.parquet."""
    found = {}
    for path in sorted(Path(root).rglob("*.parquet")):
        if m := TABLE.search(path.as_posix()):
            found[m[1]] = str(path)
    return found


def read_release(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """A release table; missing and unexpected columns, unsafe ids and rows of another language raise when read."""
    there = {f.name for f in spark.read.parquet(path).schema}
    wanted = T._parse_datatype_string(RELEASE)
    missing, extra = [f.name for f in wanted if f.name not in there], sorted(there - {f.name for f in wanted} - set(OPTIONAL))
    if missing or extra:
        raise ValueError(f"{path}: missing columns {missing}, unexpected {extra}")
    schema = RELEASE + "".join(f", {k} {v}" for k, v in OPTIONAL.items() if k in there)
    rows = spark.read.schema(schema).parquet(path)
    ok = F.col("sample_id").rlike(SAFE_ID) & F.col("duration_s").isNotNull() & (F.col("duration_s") > 0)
    if language:
        ok = ok & (F.col("language") == language)
    return rows.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("invalid release row "), F.coalesce("sample_id", F.lit("(null)")))).cast("boolean")))


def unsafe_ids(rows: DataFrame) -> DataFrame:
    """Up to five ids that can't be file names: a preview."""
    return rows.where(~F.coalesce(F.col("sample_id").rlike(SAFE_ID), F.lit(False))).select("sample_id").limit(5)


def union_release(spark: SparkSession, root: str, languages: list[str] | None = None) -> DataFrame:
    """All tables of the languages; an id in two rows raises. Validation sees all rows before any filter."""
    tables = {k: v for k, v in release_tables(root).items() if not languages or k in languages}
    if not tables:
        raise ValueError("no release table for the languages")
    out = None
    for language, path in tables.items():
        rows = read_release(spark, path, language)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    twice = out.groupBy("sample_id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"ids occur twice: {[r[0] for r in twice]}")
    return out


def channel_segments(alignments: Column) -> Column:
    """word_alignments of a release row as map ch1/ch2 -> segments with text: speaker 1 is ch1, speaker 2 ch2."""

    def of(speaker: int) -> Column:
        own = F.filter(alignments, lambda s: s["speaker"] == speaker)
        said = lambda s: F.array_join(F.transform(s["words"], lambda w: w["text"]), " ")
        return F.transform(own, lambda s: F.struct(said(s).alias("text"), s["start"].alias("start_s"), s["end"].alias("end_s"), s["timing_source"], s["words"]))

    bad = F.exists(alignments, lambda s: ~F.coalesce(s["speaker"].isin(1, 2), F.lit(False)))
    return F.when(bad, F.raise_error(F.lit("speaker must be 1 or 2")).cast(f"map<string,{SEGMENT}>")).otherwise(F.create_map(F.lit("ch1"), of(1), F.lit("ch2"), of(2)))


def embedded_audio(rows: DataFrame) -> DataFrame:
    """sample_id, channel, content of the audio columns that are filled."""
    out = None
    for channel in ("ch1", "ch2"):
        if f"audio_{channel}" in rows.columns:
            part = rows.select("sample_id", F.lit(channel).alias("channel"), F.col(f"audio_{channel}.bytes").alias("content")).where("content IS NOT NULL")
            out = part if out is None else out.union(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], "sample_id string, channel string, content binary")


# Manifests and selections


def clip_problem(clip: dict) -> str | None:
    """What is wrong with a manifest clip, if anything is."""
    try:
        version = clip.get("schema_version")
        allowed = {"schema_version", "clip_id", "language", "duration_s", "audio", "metadata", "references" if version == 1 else "word_alignments"}
        if version not in (1, 2):
            return "schema_version must be 1 or 2"
        if extra := set(clip) - allowed:
            return f"unknown fields {sorted(extra)}"
        if not re.match(SAFE_ID, clip.get("clip_id") or ""):
            return "unsafe clip_id"
        if not (clip.get("language") or "").strip():
            return "no language"
        if finite(clip.get("duration_s"), "duration_s") <= 0:
            return "duration_s must be positive"
        for asset in (clip.get("audio") or {}).values():
            safe_relative_path(asset["path"])
            sha256_text(asset["sha256"])
            finite(asset["duration_s"], "duration_s")
        spans = clip.get("references") if version == 1 else clip.get("word_alignments")
        if spans is None:
            return "references are required" if version == 1 else "word_alignments are required"
        if version == 2 and set(spans) != set(clip.get("audio") or {}):
            return "word_alignments must be of the audio channels"
        for segments in spans.values():
            for s in segments:
                a, b = finite(s["start_s"], "start_s"), finite(s["end_s"], "end_s")
                if a < 0 or b < a:
                    return "segment times out of order"
                for w in s.get("words") or ():
                    if finite(w["start"], "start") < a - 1e-6 or finite(w["end"], "end") > b + 1e-6 or w["end"] < w["start"]:
                        return "a word lies outside its segment"
    except (KeyError, TypeError, ValueError, AttributeError) as e:
        return str(e) or type(e).__name__
    return None


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Clips of a JSONL manifest. A clip that isn't valid, an id that occurs twice and an empty manifest raise."""

    def problems(lines: pa.Array) -> pa.Array:
        from sparvox.sources import datasets, jsonl

        return pa.array([datasets.clip_problem(jsonl.loads(x)) for x in lines.to_pylist()], pa.string())

    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = lines.withColumn("problem", F.arrow_udf(problems, "string")("value")).where("problem IS NOT NULL").limit(1).collect()
    if bad:
        raise ValueError(f"{path}: {bad[0]['problem']}: {bad[0]['value'][:80]}")
    clips = jsonl.read(spark, path, CLIP)
    twice = clips.groupBy("clip_id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{path}: clips occur twice: {[r[0] for r in twice]}")
    if clips.isEmpty():
        raise ValueError(f"{path}: no clips")
    return clips


def selection_digest(clips: list[dict]) -> str:
    """SHA-256 over the clips' canonical JSON lines."""
    return hashlib.sha256("".join(jsonl.dumps(c) + "\n" for c in clips).encode()).hexdigest()


def write_atomic(path: str | Path, data: bytes) -> None:
    """The file whole or not at all; links aren't followed."""
    target = Path(path)
    if target.is_symlink():
        raise ValueError(f"{target} is a link")
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        os.replace(temporary, target)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def write_json(path: str | Path, value: object) -> None:
    write_atomic(path, (json.dumps(value, sort_keys=True, indent=2, allow_nan=False, ensure_ascii=False) + "\n").encode())


def write_selection(root: str, clips: list[dict], *, source_type: str, source_id: str, revision: str, resolved_revision: str) -> dict:
    """selection.jsonl and its receipt; gives the receipt."""
    for clip in clips:
        if problem := clip_problem(clip):
            raise ValueError(f"{clip.get('clip_id')}: {problem}")
    write_atomic(Path(root) / "selection.jsonl", "".join(jsonl.dumps(c) + "\n" for c in clips).encode())
    kind = "pinned" if re.fullmatch(r"[0-9a-f]{40}", revision) else "floating"
    receipt = {"schema_version": 2, "source_type": source_type, "source_id": source_id, "revision": revision, "resolved_revision": resolved_revision, "revision_type": kind, "selection_sha256": selection_digest(clips), "clips": len(clips)}
    write_json(Path(root) / "receipt.json", receipt)
    return receipt


def load_selection(root: str) -> tuple[list[dict], dict]:
    """Clips and receipt; a digest that differs raises. A receipt of version 1 (repo_id) is read as version 2."""
    receipt = jsonl.loads((Path(root) / "receipt.json").read_text())
    if receipt.get("schema_version") == 1:
        receipt = {**{k: v for k, v in receipt.items() if k != "repo_id"}, "schema_version": 2, "source_type": "hub", "source_id": receipt["repo_id"]}
    clips = jsonl.read_local(Path(root) / "selection.jsonl")
    if selection_digest(clips) != receipt["selection_sha256"]:
        raise ValueError("the selection isn't the one that the receipt names")
    return clips, receipt


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, size of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def combined_digest(digests: dict[str, str]) -> str:
    return hashlib.sha256("".join(f"{k}\0{v}\n" for k, v in sorted(digests.items())).encode()).hexdigest()


def verify_assets(spark: SparkSession, root: str, clips: list[dict]) -> DataFrame:
    """clip_id, channel, size, problem (null if the file is there, below root, no link, of the digest and a valid recording)."""
    rows = [(c["clip_id"], ch, a["path"], a["sha256"], float(a["duration_s"])) for c in clips for ch, a in sorted((c.get("audio") or {}).items())]
    assets = spark.createDataFrame(rows, "clip_id string, channel string, path string, sha256 string, duration_s double")

    def check(paths: pa.Array, shas: pa.Array, durations: pa.Array) -> pa.Array:
        from sparvox.sources import datasets

        found = [datasets.asset_problem(root, *x) for x in zip(paths.to_pylist(), shas.to_pylist(), durations.to_pylist())]
        return pa.array([{"size": n, "problem": p} for n, p in found], pa.struct([("size", pa.int64()), ("problem", pa.string())]))

    done = assets.withColumn("r", F.arrow_udf(check, "struct<size:long,problem:string>")("path", "sha256", "duration_s"))
    return done.select("clip_id", "channel", "r.size", "r.problem")


def asset_problem(root: str, path: str, sha256: str, duration_s: float) -> tuple[int | None, str | None]:
    try:
        whole = Path(root) / safe_relative_path(path)
        if any(p.is_symlink() for p in [whole, *whole.parents][: len(PurePosixPath(path).parts)]):
            return None, "link"
        data = whole.read_bytes()
    except (OSError, ValueError) as e:
        return None, str(e)
    if hashlib.sha256(data).hexdigest() != sha256:
        return len(data), "digest differs"
    return len(data), audio.problem(data, duration_s)


class DatasetSource(ABC):
    """Where a dataset's manifest and files come from."""

    identity: tuple[str, str]

    @abstractmethod
    def resolve(self, revision: str) -> str:
        """The full revision that a name stands for."""

    @abstractmethod
    def clips(self) -> list[dict]: ...

    @abstractmethod
    def fetch(self, path: str) -> bytes: ...


class DirectorySource(DatasetSource):
    """A dataset in a directory; its revision is the digest of its manifest."""

    def __init__(self, root: str):
        self.root, self.identity = Path(root), ("directory", str(root))

    def resolve(self, revision: str) -> str:
        found = hashlib.sha256((self.root / "manifest.jsonl").read_bytes()).hexdigest()[:40]
        if revision not in ("latest", "main", found):
            raise ValueError(f"no revision {revision!r}")
        return found

    def clips(self) -> list[dict]:
        return jsonl.read_local(self.root / "manifest.jsonl")

    def fetch(self, path: str) -> bytes:
        return (self.root / safe_relative_path(path)).read_bytes()


def materialize(source: DatasetSource, root: str, *, revision: str = "latest", languages: list[str] | None = None, ids: list[str] | None = None, limit: int | None = None) -> dict:
    """Fetches a selection's files below root (those with the right digest stay), verifies them, writes selection and receipt last."""
    resolved = source.resolve(revision)
    clips = source.clips()
    for clip in clips:
        if problem := clip_problem(clip):
            raise ValueError(f"{clip.get('clip_id')}: {problem}")
    if languages:
        wanted = {x.replace("_", "-").lower() for x in languages}
        clips = [c for c in clips if c["language"].replace("_", "-").lower() in wanted]
    if ids:
        if missing := sorted(set(ids) - {c["clip_id"] for c in clips}):
            raise ValueError(f"ids not found: {missing}")
        clips = [c for c in clips if c["clip_id"] in set(ids)]
    clips = clips[:limit] if limit is not None else clips
    owners: dict[str, str] = {}
    for clip in clips:
        for asset in (clip.get("audio") or {}).values():
            if owners.setdefault(asset["path"], asset["sha256"]) != asset["sha256"]:
                raise ValueError(f"{asset['path']} is claimed with two digests")
    for path, sha in owners.items():
        target = Path(root) / safe_relative_path(path)
        if not (target.is_file() and not target.is_symlink() and hashlib.sha256(target.read_bytes()).hexdigest() == sha):
            data = source.fetch(path)
            if hashlib.sha256(data).hexdigest() != sha:
                raise ValueError(f"{path}: digest differs")
            write_atomic(target, data)
    kind, name = source.identity
    return write_selection(root, clips, source_type=kind, source_id=name, revision=revision, resolved_revision=resolved)
