"""Strict JSONL: repeated keys, NaN and infinity, and lines that aren't objects are errors, where Spark's reader would let them pass."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparvox.runtime import workers_see_package


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("an object has a key twice")
    return out


def _constant(name: str):
    raise ValueError(f"{name} isn't JSON")


def loads(line: str) -> dict:
    """One JSON object, strictly."""
    found = json.loads(line, object_pairs_hook=_pairs, parse_constant=_constant)
    if not isinstance(found, dict):
        raise ValueError("not a JSON object")
    return found


def dumps(value: object) -> str:
    """Canonical JSON: sorted keys, no blanks, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The file's objects as rows. Blank lines are skipped; a bad line raises with its file and text."""
    workers_see_package(spark)

    def check(lines: pa.Array, files: pa.Array) -> pa.Array:
        from sparvox.sources import jsonl

        out = []
        for line, file in zip(lines.to_pylist(), files.to_pylist()):
            try:
                out.append(json.dumps(jsonl.loads(line)))
            except ValueError as e:
                raise ValueError(f"{file}: {e}: {line[:80]}") from e
        return pa.array(out, pa.string())

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    checked = lines.select(F.arrow_udf(check, "string")("value", "file").alias("line"))
    return checked.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_local(path: str | Path) -> list[dict]:
    """The same on the driver, with line numbers: for receipts and the command line."""
    out = []
    for n, line in enumerate(Path(path).read_text(encoding="utf-8").splitlines(), 1):
        if line.strip():
            try:
                out.append(loads(line))
            except ValueError as e:
                raise ValueError(f"{path}:{n}: {e}") from e
    return out


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object for each row, nulls written; Spark commits whole files only."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
