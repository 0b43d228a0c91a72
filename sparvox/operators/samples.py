"""References, hypotheses and the metrics of one sample; for tables, as an Arrow UDF over their JSON."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparvox.functions import kernels
from sparvox.functions.languages import WORDLESS, canonical
from sparvox.operators import transcripts
from sparvox.operators.scoring import permuted
from sparvox.runtime import workers_see_package
from sparvox.sources import jsonl

GAP = 0.2
Span = tuple[str, float, float]


class TimingError(ValueError):
    """Times that can't be scored; texts still can."""


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def span(speaker: object, start: object, end: object) -> Span:
    """A checked segment."""
    if not isinstance(speaker, str) or not speaker.strip():
        raise TimingError("a segment needs a speaker")
    if not (_number(start) and _number(end)) or start < 0 or end < start:
        raise TimingError(f"invalid times {start}, {end}")
    return speaker, float(start), float(end)


def union(spans: list[Span], apart: Callable[[float, float], bool]) -> list[Span]:
    out: list[Span] = []
    for s, a, b in sorted(x for x in spans if x[2] > x[1]):
        if out and out[-1][0] == s and not apart(a, out[-1][2]):
            out[-1] = (s, out[-1][1], max(out[-1][2], b))
        else:
            out.append((s, a, b))
    return out


def canonical_union(spans: list[Span], duration: float | None = None) -> list[Span]:
    if duration is not None:
        if not _number(duration) or duration <= 0:
            raise ValueError("the duration must be positive")
        spans = [(s, max(0.0, a), min(duration, b)) for s, a, b in spans]
    return union(spans, lambda start, end: start > end)


def merged(spans: list[Span], gap: float = GAP) -> list[Span]:
    if any(b <= a for _, a, b in spans):
        raise TimingError("speech of no length")
    return union(spans, lambda start, end: start > end + gap + 1e-12)


def word_activity(words: list[dict], *, skip_reversed: bool = False) -> list[Span]:
    spans = []
    for w in words:
        if _number(w.get("start_s")) and _number(w.get("end_s")) and w["end_s"] < w["start_s"] and skip_reversed:
            continue
        spans.append(span(w.get("speaker"), w.get("start_s"), w.get("end_s")))
    return sorted(union(spans, lambda start, end: start - end > GAP + 1e-12), key=lambda x: (x[1], x[2], x[0]))


def atoms(reference: list[Span], hypothesis: list[Span], collar: float = 0.0) -> list[tuple[float, set[str], set[str]]]:
    """(length, reference speakers, hypothesis speakers) of the intervals between boundaries that no collar masks."""
    masks = [(x - collar, x + collar) for _, a, b in reference for x in (a, b)] if collar else []
    points = sorted({x for _, a, b in [*reference, *hypothesis] for x in (a, b)} | {x for m in masks for x in m})
    active = lambda spans, t: {s for s, a, b in spans if a <= t < b}
    return [(v - u, active(reference, u), active(hypothesis, u)) for u, v in zip(points, points[1:]) if not any(a <= u < b for a, b in masks)]


def der(reference: list[Span], hypothesis: list[Span], *, collar: float = 0.0, duration: float | None = None) -> dict:
    if isinstance(collar, bool) or not _number(collar) or collar < 0:
        raise ValueError("the collar must be finite and not negative")
    found = atoms(canonical_union(reference, duration), canonical_union(hypothesis, duration), collar)
    rows, columns = sorted({s for _, r, _ in found for s in r}), sorted({s for _, _, h in found for s in h})
    met = [[sum(d for d, r, h in found if a in r and b in h) for b in columns] for a in rows]
    missed = sum(d * max(0, len(r) - len(h)) for d, r, h in found)
    alarm = sum(d * max(0, len(h) - len(r)) for d, r, h in found)
    common = sum(d * min(len(r), len(h)) for d, r, h in found)
    total = sum(d * len(r) for d, r, _ in found)
    confusion = max(0.0, common - sum(met[i][j] for i, j in kernels.assign(met, maximize=True)))
    errors = missed + alarm + confusion
    return {"missed": missed, "false_alarm": alarm, "confusion": confusion, "numerator": errors, "denominator": total, "value": errors / total if total else None}


def jer(reference: list[Span], hypothesis: list[Span], *, duration: float | None = None) -> dict:
    found = atoms(canonical_union(reference, duration), canonical_union(hypothesis, duration))
    rows, columns = sorted({s for _, r, _ in found for s in r}), sorted({s for _, _, h in found for s in h})
    length = lambda k, s: sum(x[0] for x in found if s in x[k])
    costs = [[1 - (o := sum(d for d, r, h in found if a in r and b in h)) / (length(1, a) + length(2, b) - o) for b in columns] for a in rows]
    errors = [1.0] * len(rows)
    for i, j in kernels.assign(costs):
        errors[i] = costs[i][j]
    return {"error_sum": sum(errors), "reference_speakers": len(rows), "value": sum(errors) / len(rows) if rows else None}


def speaker_count(reference: list[Span], hypothesis: list[Span], *, duration: float | None = None) -> dict:
    r, h = (len({s for s, _, _ in canonical_union(x, duration)}) for x in (reference, hypothesis))
    return {"reference_speakers": r, "hypothesis_speakers": h, "correct": r == h, "absolute_error": abs(r - h)}


# References


def audit(document: dict, durations: dict[str, float], expected: list[str] | None = None) -> dict:
    """Counts and issues of an alignment document: missing and extra annotations, speakers, windows, words out of order or range."""
    issues: list[tuple[str, str]] = []
    seen: set[str] = set()
    words = empty = 0
    for a in document.get("annotations") or ():
        name = a.get("annotationId") or ""
        parts = name.split(":")
        if name in seen:
            issues.append((name, "duplicate"))
        seen.add(name)
        if len(parts) != 3 or parts[0] != document.get("jobId") or parts[1] not in durations or not parts[2].isdigit():
            issues.append((name, "identity"))
            continue
        start, end, last = a.get("audioStart"), a.get("audioEnd"), None
        if not (_number(start) and _number(end)) or not 0 <= start < end:
            issues.append((name, "window"))
            continue
        own = a.get("words") or []
        for w in own:
            words += 1
            s, e = w.get("start"), w.get("end")
            if not (_number(s) and _number(e)) or e < s or s < start - 0.05 or e > min(end, durations[parts[1]]) + 0.05:
                issues.append((name, "word time"))
                continue
            empty += e == s
            if last is not None and s < last:
                issues.append((name, "word order"))
            last = s
        language = canonical(document.get("lang")) or ""
        if kernels.lexical_key(a.get("silverText") or "", language) != kernels.lexical_key("".join(w.get("text") or "" for w in own), language):
            issues.append((name, "text"))
        if not a.get("speakerId"):
            issues.append((name, "speaker"))
    if expected is not None:
        issues += [(x, "missing") for x in sorted(set(expected) - seen)] + [(x, "extra") for x in sorted(seen - set(expected))]
    return {"annotations": len(seen), "words": words, "zero_length_words": empty, "issues": issues}


def forced_regions(document: dict, durations: dict[str, float]) -> list[Span]:
    """Speech by channel from a clean document's words, gaps of up to 0.2 s filled."""
    found = audit(document, durations)
    if found["issues"] or found["zero_length_words"]:
        raise TimingError(f"the alignment isn't clean: {found['issues'][:3] or 'words of no length'}")
    spans = []
    for a in document["annotations"]:
        channel = a["annotationId"].split(":")[1]
        for w in a["words"]:
            if w["end"] > durations[channel]:
                raise TimingError("a word ends after the audio")
            spans.append((channel, float(w["start"]), float(w["end"])))
    return merged(spans)


def reference_from_alignment(document: dict, *, channel_durations_s: dict[str, float]) -> dict:
    """language, text_by_speaker, mixed_text, timeline and duration of an alignment document."""
    rows = sorted(document["annotations"], key=lambda a: (a["audioStart"], a["annotationId"].split(":")[1]))
    said: dict[str, list[str]] = {c: [] for c in channel_durations_s}
    for a in rows:
        said[a["annotationId"].split(":")[1]].append(a["silverText"])
    return {
        "language": document["lang"], "text_by_speaker": {k: " ".join(v) for k, v in said.items()}, "mixed_text": " ".join(a["silverText"] for a in rows),
        "timeline": forced_regions(document, channel_durations_s), "duration_s": max(channel_durations_s.values()),
    }


def reference_from_clip(clip: dict) -> dict:
    """The same from a manifest clip's word alignments; a word may end 0.05 s after the clip."""
    said, spans, rows = {}, [], []
    for channel, segments in sorted(clip["word_alignments"].items()):
        said[channel] = " ".join(t for s in segments if (t := (s.get("text") or " ".join(w["text"] for w in s["words"])).strip()))
        for k, s in enumerate(segments):
            rows.append((s["start_s"], channel, k, s.get("text") or " ".join(w["text"] for w in s["words"])))
            for w in s["words"]:
                if w["end"] > clip["duration_s"] + 0.05:
                    raise TimingError("a word ends after the clip")
                spans.append(span(channel, w["start"], w["end"]))
    return {"language": clip["language"], "text_by_speaker": said, "mixed_text": " ".join(r[3].strip() for r in sorted(rows) if r[3].strip()), "timeline": merged(spans), "duration_s": clip["duration_s"]}


# Hypotheses


def label(item: dict) -> str:
    """Speaker of a blob's item."""
    if item.get("speaker_external_id") is not None:
        return str(item["speaker_external_id"])
    return str(item["channel_index"]) if item.get("channel_index") is not None else "1"


def validate_blob(blob: dict) -> dict:
    """The blob; {} is a successful empty output, null is none."""
    if not isinstance(blob, dict):
        raise TypeError("a hypothesis must be an object")
    for s in (blob.get("verbatim") or {}).get("segments") or ():
        if not isinstance(s, dict) or not isinstance(s.get("text"), str):
            raise ValueError("a segment needs a text")
    return blob


def blob_from_text(record: dict) -> dict:
    """A local record's text as a blob: one segment without invented times."""
    said = record.get("hypothesis") or ""
    return {"verbatim": {"segments": [{"text": said, "start_ms": 0, "end_ms": 0}]}} if said.strip() else {}


def blob_from_transcript(transcript: dict, activity: str | None = None) -> dict:
    """A transcript (seconds) as a blob (milliseconds)."""
    ms = lambda x: None if x is None else round(1000 * x)
    item = lambda x: {"text": x.get("text", ""), "speaker_external_id": x.get("speaker"), "start_ms": ms(x.get("start_s")), "end_ms": ms(x.get("end_s"))}
    segments = [item(s) for s in transcript.get("segments") or ()] or ([{"text": transcript["text"], "start_ms": 0, "end_ms": 0}] if (transcript.get("text") or "").strip() else [])
    blob: dict = {"verbatim": {"segments": segments}} if segments else {}
    if transcript.get("words"):
        blob["words"] = [item(w) for w in transcript["words"]]
    if blob and activity:
        blob["activity_source"] = activity
    if blob and transcript.get("word_alignment_complete") is False:
        blob["provider_meta"] = {"1": {"word_alignment_complete": False}}
    return blob


def text_by_speaker(blob: dict) -> dict[str, str]:
    """What each speaker says, whatever the times."""
    said: dict[str, list[str]] = {}
    for s in (blob.get("verbatim") or {}).get("segments") or ():
        said.setdefault(label(s), []).append(s["text"].strip())
    return {k: " ".join(x for x in v if x) for k, v in said.items()}


def timeline(blob: dict) -> list[Span]:
    """Speech of a blob by its activity source: words with a speaker, else the segments as they are."""
    seconds = lambda x, k: x[k] / 1000 if _number(x.get(k)) else x.get(k)
    if any((m or {}).get("word_alignment_complete") is False for m in (blob.get("provider_meta") or {}).values() if isinstance(m, dict)):
        raise TimingError("word times are incomplete")
    source = blob.get("activity_source", "native_segments")
    if source in ("speaker_words", "speaker_words_lenient"):
        words = [{"speaker": label(w), "start_s": seconds(w, "start_ms"), "end_s": seconds(w, "end_ms")} for w in blob.get("words") or ()]
        if not words and text_by_speaker(blob):
            raise TimingError("there are no words with times")
        return word_activity(words, skip_reversed=source.endswith("lenient"))
    if source != "native_segments":
        raise TimingError(f"unknown activity source {source!r}")
    segments = (blob.get("verbatim") or {}).get("segments") or ()
    spans = [span(label(s), seconds(s, "start_ms"), seconds(s, "end_ms")) for s in segments]
    if spans and all(a == b == 0 for _, a, b in spans):
        raise TimingError("the segments have no times")
    return spans


def checked_timeline(blob: dict, provider: str | None = None) -> list[Span]:
    """Speech of a blob. A provider whose responses are kept (gemini_transcribe) has words and turns of the blob held against its response first."""
    if provider != "gemini_transcribe" or not blob:
        return timeline(blob)
    kept = blob.get("provider_meta") or {}
    if len(kept) != 1 or blob.get("physical_channel_blobs"):
        raise TimingError("there must be one response, to mixed audio")
    (channel, meta), = kept.items()
    if not isinstance(meta, dict) or not isinstance(meta.get("response"), dict):
        raise TimingError("the response isn't kept")
    if meta.get("word_alignment_complete") is False:
        raise TimingError("word times are incomplete")
    try:
        words = transcripts.gemini(meta["response"], diarize=True)["words"]
    except (KeyError, transcripts.ResponseError) as e:
        raise TimingError(f"the response can't be read: {e}") from e
    ms = lambda w: (1000 * w["start_s"], 1000 * w["end_s"])
    if [(w.get("start_ms"), w.get("end_ms")) for w in blob.get("words") or ()] != [ms(w) for w in words]:
        raise TimingError("the stored words aren't those of the response")
    named = [w | {"speaker": f"{channel}:{w['speaker']}"} for w in words]
    said = [(t["speaker"], *ms(t)) for t in transcripts.turns(named)]
    if [(label(s), s.get("start_ms"), s.get("end_ms")) for s in blob["verbatim"]["segments"]] != said:
        raise TimingError("the stored turns aren't those of the response")
    return word_activity(named, skip_reversed=True)


# One sample's metrics


def _rate(key: str, n: float, d: float, **more) -> dict:
    return {"metric": key, "numerator": float(n), "denominator": float(d), "value": n / d if d else None, **more}


def _counted(key: str, counts: tuple[int, int, int, int]) -> dict:
    return _rate(key, sum(counts[:3]), counts[0] + counts[1] + counts[3], **dict(zip(("substitutions", "deletions", "insertions", "hits"), counts)))


def units_of(language: str) -> tuple[list[str], str]:
    """The units that a language is scored in, and the one that its permuted rate is in."""
    code = canonical(language)
    units = ["cer", *(["ser"] if code == "vi" else [] if code in WORDLESS else ["wer"])]
    return units, "cer" if code in {*WORDLESS, "ko"} else units[-1]


def score_sample(reference: dict, hypothesis: dict | None, *, condition: str = "mono", transcribes: bool = True, diarizes: bool = True, provider: str | None = None) -> dict:
    """language, condition, metrics (rows of metric, numerator, denominator, value, and edit counts of texts) and unavailable (metric family -> why).

    dual: hypothesis is {ch1: blob, ch2: blob}; each channel is scored by itself and the counts add up. mono: one blob; with diarization
    permuted speakers are scored under the plain names, without it the mixed text. Permuted rates need two speakers with text.
    A null hypothesis is a failed request: nothing is scored.
    """
    if condition not in ("dual", "mono"):
        raise ValueError("condition is dual or mono")
    if not (transcribes or diarizes) or (condition == "dual" and not transcribes):
        raise ValueError("dual needs transcription, mono transcription or diarization")
    head = {"language": reference["language"], "condition": condition}
    if hypothesis is None:
        return head | {"metrics": [], "unavailable": {"all": "no hypothesis"}}
    if condition == "dual" and set(hypothesis) != {"ch1", "ch2"}:
        raise ValueError("dual needs both ch1 and ch2")
    for blob in hypothesis.values() if condition == "dual" else (hypothesis,):
        validate_blob(blob)
    code = canonical(reference["language"])
    units, primary = units_of(code)
    rows: list[dict] = []
    unavailable: dict[str, str] = {}
    whole = lambda blob: " ".join(s.get("text") or "" for s in (blob.get("verbatim") or {}).get("segments") or ())
    # Channels of a reference may be named 1 and 2 or ch1 and ch2.
    own = reference["text_by_speaker"]
    said = {k if k in own else k.removeprefix("ch"): whole(v) for k, v in hypothesis.items()} if condition == "dual" else text_by_speaker(hypothesis)
    if transcribes:
        for unit in units:
            cut = lambda t: kernels.tokens(kernels.normalize(t, code), unit)  # noqa: E731, B023
            r, h = ({k: cut(v) for k, v in x.items()} for x in (own, said))
            if condition == "dual":
                counts = tuple(map(sum, zip(*(kernels.edit_counts(r.get(k, []), x) for k, x in h.items()))))
            elif diarizes:
                counts = permuted(r, h)[0]
            else:
                counts = kernels.edit_counts(cut(reference["mixed_text"]), cut(whole(hypothesis)))
            rows.append(_counted(unit, counts))
            if unit == primary and sum(map(bool, own.values())) >= 2 and (condition == "dual" or diarizes):
                rows.append(_counted(f"cp{unit}", permuted(r, h)[0]))
    if condition == "mono" and diarizes:
        try:
            spoken, duration = checked_timeline(hypothesis, provider), reference.get("duration_s")
            for key, collar in (("der_forced", 0.0), ("der_forced_c25", 0.25)):
                d = der(reference["timeline"], spoken, collar=collar, duration=duration)
                rows.append(_rate(key, 1000 * d["numerator"], 1000 * d["denominator"]))
                rows += [_rate(f"{key}_{short}", 1000 * d[part], 1000 * d["denominator"]) for short, part in (("miss", "missed"), ("fa", "false_alarm"), ("conf", "confusion"))]
            j, n = jer(reference["timeline"], spoken, duration=duration), speaker_count(reference.get("count_timeline") or reference["timeline"], spoken, duration=duration)
            rows += [_rate("jer_forced", j["error_sum"], j["reference_speakers"]), _rate("sca", n["correct"], 1), _rate("spk_count_mae", n["absolute_error"], 1)]
        except (TimingError, TypeError) as e:
            unavailable["diarization"] = str(e)
    return head | {"metrics": rows, "unavailable": unavailable}


# Scores of fresh transcripts, and of whole runs

#: Backends whose speech is taken from their words.
BY_WORDS = {"elevenlabs", "mai", "gemini", "xai"}


def connector_blob(transcript: dict, *, diarizes: bool, backend: str | None = None) -> dict:
    """A fresh transcript (seconds) as a blob; what it lacks for diarization raises."""
    if not diarizes:
        return {"verbatim": {"segments": [{"text": transcript["text"]}]}}
    segments, words = transcript.get("segments") or [], transcript.get("words") or []
    if transcript["text"].strip() and not segments:
        raise ValueError("a diarized text has no segments")
    if any(s.get("speaker") is None for s in segments):
        raise ValueError("a segment of diarized output has no speaker")
    incomplete = transcript.get("word_alignment_complete") is False
    if backend in BY_WORDS:
        said = {}
        for s in segments:
            said[s["speaker"]] = said.get(s["speaker"], "") + s["text"]
        spoken = {w.get("speaker") for w in words}
        incomplete |= not transcripts.words_complete(said, words) if backend == "mai" else any(t.strip() and k not in spoken for k, t in said.items())
    ms = lambda x, k: None if x.get(k) is None else 1000 * x[k]
    item = lambda x: {"text": x["text"], "speaker_external_id": x.get("speaker"), "start_ms": ms(x, "start_s"), "end_ms": ms(x, "end_s")}
    blob = {"activity_source": "speaker_words" if backend in BY_WORDS else "native_segments", "verbatim": {"segments": list(map(item, segments))}, "words": list(map(item, words))}
    return blob | ({"provider_meta": {"1": {"word_alignment_complete": False}}} if incomplete else {})


def score_connector_output(clip: dict, transcript: dict, channel: str, *, backend: str | None = None, transcribes: bool = True, diarizes: bool = False) -> dict:
    """A fresh transcript against its clip: a physical channel by its own text, mono as score_sample does. Raises without aligned words of every channel."""
    reference = reference_from_clip(clip)
    if channel == "mono":
        return score_sample(reference, connector_blob(transcript, diarizes=diarizes, backend=backend), transcribes=transcribes, diarizes=diarizes)
    code, rows = canonical(reference["language"]), []
    for unit in units_of(code)[0] if transcribes else ():
        r, h = (kernels.tokens(kernels.normalize(t, code), unit) for t in (reference["text_by_speaker"][channel], transcript["text"]))
        rows.append(_counted(unit, kernels.edit_counts(r, h)))
    return {"language": reference["language"], "condition": channel, "metrics": rows, "unavailable": {}}


def dual_result(left: dict, right: dict) -> dict:
    """Two channels' results as one of the pair: counts of the metrics that both have add up."""
    second = {m["metric"]: m for m in right["metrics"]}
    rows = []
    for m in left["metrics"]:
        if other := second.get(m["metric"]):
            sums = {k: m[k] + other[k] for k in m if k not in ("metric", "value") and m[k] is not None}
            rows.append({"metric": m["metric"], **sums, "value": sums["numerator"] / sums["denominator"] if sums["denominator"] else None})
    why = {k: x["unavailable"] for k, x in (("ch1", left), ("ch2", right)) if x["unavailable"]}
    return {"language": left["language"], "condition": "dual", "metrics": rows, "unavailable": why}


def run_scores(records: DataFrame) -> DataFrame:
    """Scored records (sample_id, model, channel, result as JSON, and whatever else) without failed ones, and a row for each pair of channels that are both there.

    A pair's other columns are ch1's. A channel that is there twice raises. Channels meet by (sample_id, model), two rows at most.
    """
    workers_see_package(records.sparkSession)
    scored = records.where("result IS NOT NULL")
    more = [c for c in records.columns if c not in ("sample_id", "model", "channel", "result")]

    def pair(lefts: pa.Array, rights: pa.Array) -> pa.Array:
        from sparvox.operators import samples

        return pa.array([json.dumps(samples.dual_result(json.loads(a), json.loads(b)), ensure_ascii=False, allow_nan=False) for a, b in zip(lefts.to_pylist(), rights.to_pylist())], pa.string())

    keys = ["sample_id", "model"]
    sides = scored.where("channel IN ('ch1', 'ch2')").groupBy(*keys, "channel").agg(F.count("*").alias("n"), F.first("result").alias("result"), *(F.first(c).alias(c) for c in more))
    once = sides.withColumn("result", F.when(F.col("n") == 1, F.col("result")).otherwise(F.raise_error(F.lit("a channel was scored twice")).cast("string")))
    right = once.where("channel = 'ch2'").select(*keys, F.col("result").alias("__right"))
    both = once.where("channel = 'ch1'").join(right, keys)
    dual = both.withColumn("result", F.arrow_udf(pair, "string")("result", "__right")).withColumn("channel", F.lit("dual"))
    return scored.unionByName(dual.select(*records.columns))


def write_run_scores(records: DataFrame, path: str) -> None:
    """run_scores as JSON lines; Spark commits whole files only."""
    jsonl.write(run_scores(records), path, "overwrite")


def load_reference(folder: str) -> dict:
    """The reference of a clip's release folder (metadata.json, scoring_reference.json); a transcript that isn't what metadata records raises."""
    meta = json.loads((Path(folder) / "metadata.json").read_text(encoding="utf-8"))
    body = (Path(folder) / "scoring_reference.json").read_bytes()
    if hashlib.sha256(body).hexdigest() != meta["reference"]["sha256"]:
        raise ValueError("the transcript isn't the one that metadata.json records")
    document = json.loads(body)
    if (document["jobId"], document["lang"]) != (meta["item_key"], meta["metadata"]["language"]):
        raise ValueError("the transcript is of another clip or language")
    return reference_from_alignment(document, channel_durations_s={c: meta["audio"][c]["duration_s"] for c in ("ch1", "ch2")})


METRICS = "struct<metrics:array<struct<metric:string,numerator:double,denominator:double,value:double,substitutions:long,deletions:long,insertions:long,hits:long>>,unavailable:map<string,string>>"


def score_samples(df: DataFrame, *, condition: str = "mono", transcribes: bool = True, diarizes: bool = True) -> DataFrame:
    """df (reference and hypothesis as JSON texts) with metrics and unavailable."""
    workers_see_package(df.sparkSession)

    def run(references: pa.Array, hypotheses: pa.Array) -> pa.Array:
        from sparvox.operators import samples

        out = []
        for r, h in zip(references.to_pylist(), hypotheses.to_pylist()):
            done = samples.score_sample(json.loads(r), None if h is None else json.loads(h), condition=condition, transcribes=transcribes, diarizes=diarizes)
            out.append({"metrics": done["metrics"], "unavailable": list(done["unavailable"].items())})
        rows = pa.list_(pa.struct([("metric", pa.string()), ("numerator", pa.float64()), ("denominator", pa.float64()), ("value", pa.float64()), *((k, pa.int64()) for k in ("substitutions", "deletions", "insertions", "hits"))]))
        return pa.array(out, pa.struct([("metrics", rows), ("unavailable", pa.map_(pa.string(), pa.string()))]))

    scored = df.withColumn("__s", F.arrow_udf(run, METRICS)("reference", "hypothesis"))
    return scored.select(*df.columns, "__s.metrics", "__s.unavailable")
