"""Languages, their public and source metrics, and the columns that look them up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = tuple("ar bn de en es fr hi id it ja ko mr pt ru ta te th tl tr vi zh".split())
CHARACTER_LANGUAGES = frozenset({"zh", "ja", "ko", "th"})
#: Languages without spaces between words, in which a word rate means nothing.
WORDLESS = frozenset({"zh", "ja", "th"})
METRICS = ("wer", "cer", "ser")
PUBLIC_METRIC = {code: "cer" if code in CHARACTER_LANGUAGES else "wer" for code in LANGUAGES}
SOURCE_METRIC = PUBLIC_METRIC | {"vi": "ser"}


def canonical(language: str | None) -> str | None:
    """Primary subtag, lower-cased; nothing for null and blank tags."""
    if language is None:
        return None
    return language.strip().lower().replace("_", "-").partition("-")[0] or None


def canonical_language(tag: Column) -> Column:
    primary = F.split_part(F.replace(F.lower(F.trim(tag)), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))
    return F.nullif(primary, F.lit(""))


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def public_metric(tag: Column) -> Column:
    """wer or cer; null for other languages."""
    return F.try_element_at(_lookup(PUBLIC_METRIC), F.coalesce(canonical_language(tag), F.lit("")))


def source_metric(tag: Column) -> Column:
    return F.try_element_at(_lookup(SOURCE_METRIC), F.coalesce(canonical_language(tag), F.lit("")))


def validate_public_metrics(metrics: dict[str, str] | None = None) -> None:
    """Raises if the map and the language list have drifted apart."""
    found = PUBLIC_METRIC if metrics is None else metrics
    missing, extra = sorted(set(LANGUAGES) - set(found)), sorted(set(found) - set(LANGUAGES))
    wrong = sorted(k for k, v in found.items() if v not in ("wer", "cer"))
    if missing or extra or wrong:
        raise ValueError(f"public metrics don't cover the languages: missing {missing}, extra {extra}, invalid {wrong}")


def resolve_metric(language: str | None, metric: str = "auto") -> tuple[str | None, str, str]:
    """(code, public, source) of a requested metric; combinations that mean nothing are errors."""
    code = canonical(language)
    if metric == "auto":
        return code, PUBLIC_METRIC.get(code or "", "wer"), SOURCE_METRIC.get(code or "", "wer")
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if metric == "wer" and code in WORDLESS:
        raise ValueError(f"word error rate isn't defined for {code}")
    if metric == "ser" and code != "vi":
        raise ValueError("syllable error rate is defined for vi only")
    if code == "vi" and metric in ("wer", "ser"):
        return code, "wer", "ser"
    return code, metric, metric


def metric_for(tag: Column, metric: str = "auto") -> Column:
    """The source metric of each row's language as resolve_metric has it; a row that it refuses raises."""
    code = canonical_language(tag)
    if metric == "auto":
        return F.coalesce(source_metric(tag), F.lit("wer"))
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if metric == "wer":
        banned = F.raise_error(F.lit("word error rate isn't defined for this language"))
        return F.when(code.isin(*WORDLESS), banned).when(code == "vi", F.lit("ser")).otherwise(F.lit("wer"))
    if metric == "ser":
        return F.when(code == "vi", F.lit("ser")).otherwise(F.raise_error(F.lit("syllable error rate is defined for vi only")))
    return F.lit("cer")
