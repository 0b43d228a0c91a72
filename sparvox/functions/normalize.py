"""Arrow UDFs around the Python kernels: normalisation by language, edit counts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparvox.functions import kernels
from sparvox.functions.languages import canonical_language

COUNTS = "struct<substitutions:long,deletions:long,insertions:long,hits:long>"


#: Rows of a batch that are Python objects at once; the rest stays in Arrow.
SLICE = 128


def objects(rows: pa.Array) -> list:
    """rows.to_pylist(); lists of strings by way of one flat array, which is several times as fast."""
    if not (pa.types.is_list(rows.type) and pa.types.is_string(rows.type.value_type)):
        return rows.to_pylist()
    flat, out, at = rows.flatten().to_numpy(zero_copy_only=False).tolist(), [], 0
    for n in pc.list_value_length(rows).to_pylist():
        out.append(None if n is None else flat[at : at + n])
        at += n or 0
    return out


def mapped(apply: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """apply over the rows of columns, SLICE rows at a time."""
    parts = (zip(*(objects(c.slice(k, SLICE)) for c in columns)) for k in range(0, len(columns[0]), SLICE))
    return pa.concat_arrays([pa.array([], kind), *(pa.array([apply(*row) for row in rows], kind) for rows in parts)])


def each(apply: Callable, returns: str) -> Callable[..., Column]:
    """A column function from a Python function of one row's values; Arrow batches in and out. Null in, null out."""

    def run(*columns: pa.Array) -> pa.Array:
        return mapped(lambda *row: None if None in row else apply(*row), _TYPES.get(returns, pa.string()), *columns)

    if returns == COUNTS:

        def one(a: pa.Array, b: pa.Array) -> pa.Array:
            from sparvox.functions import kernels

            names = ("substitutions", "deletions", "insertions", "hits")
            counted = lambda x, y: None if x is None or y is None else dict(zip(names, kernels.edit_counts(x, y)))
            return mapped(counted, pa.struct([(k, pa.int64()) for k in names]), a, b)

        return F.arrow_udf(one, COUNTS)
    return F.arrow_udf(run, returns)


_TYPES = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def normalized(text: Column, language: Column, profile: str = "benchmark") -> Column:
    """Normalized text; one batch may hold any mix of languages."""
    profile = kernels.canonical_profile(profile)

    def run(texts: pa.Array, tags: pa.Array) -> pa.Array:
        from sparvox.functions import kernels

        return mapped(lambda t, tag: None if t is None else kernels.normalize(t, tag, profile), pa.string(), texts, tags)

    return F.arrow_udf(run, "string")(text, language)


def by_key(text: Column, key: str) -> Column:
    """One named normalizer by itself."""
    if key not in kernels.BY_KEY:
        raise ValueError(f"unknown normalizer {key!r}")

    def run(texts: pa.Array) -> pa.Array:
        from sparvox.functions import kernels

        apply = kernels.BY_KEY[key]
        return mapped(lambda t: None if t is None else apply(t), pa.string(), texts)

    return F.arrow_udf(run, "string")(text)


def with_metadata(df: DataFrame, text: str, language: str, profile: str = "benchmark") -> DataFrame:
    """Adds normalized: struct of text, language, profile, normalizer, policy."""
    table = kernels.WHISPER if kernels.canonical_profile(profile) == "whisper_baseline" else kernels.BENCHMARK
    lookup = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    code = canonical_language(F.col(language))
    key = F.coalesce(F.try_element_at(lookup, F.coalesce(code, F.lit(""))), F.lit("whisper_basic"))
    parts = (normalized(F.col(text), F.col(language), profile).alias("text"), code.alias("language"), F.lit(profile).alias("profile"), key.alias("normalizer"), F.lit(kernels.POLICY).alias("policy"))
    return df.withColumn("normalized", F.struct(*parts))


def edit_counts(reference: Column, hypothesis: Column) -> Column:
    """Struct of substitutions, deletions, insertions, hits of two token arrays."""
    return each(kernels.edit_counts, COUNTS)(reference, hypothesis)


def token_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of token arrays of any length."""

    def run(references: pa.Array, hypotheses: pa.Array) -> pa.Array:
        from sparvox.functions import kernels

        return mapped(lambda r, h: None if r is None or h is None else kernels.distance(r, h), pa.int64(), references, hypotheses)

    return F.arrow_udf(run, "long")(reference, hypothesis)


def custom(apply: Callable[[str], str]) -> Callable[[Column], Column]:
    """A column function from the caller's own text normalizer."""
    return each(apply, "string")
