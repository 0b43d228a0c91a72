"""Recordings: WAV by the standard library, FLAC headers, mono mixes, silence and windows."""

from __future__ import annotations

import hashlib
import io
import math
import struct
import wave

import numpy as np

RATE = 16_000


def flac_info(data: bytes) -> tuple[int, int, int, int]:
    """(rate, channels, bits, frames) from the STREAMINFO block."""
    if data[:4] != b"fLaC" or len(data) < 42 or data[4] & 0x7F:
        raise ValueError("not FLAC")
    packed = int.from_bytes(data[18:26], "big")
    return packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1


def wav_info(data: bytes) -> tuple[int, int, int, int]:
    with wave.open(io.BytesIO(data)) as w:
        return w.getframerate(), w.getnchannels(), 8 * w.getsampwidth(), w.getnframes()


def problem(data: bytes, duration_s: float) -> str | None:
    """What is wrong with a recording that should be mono PCM and so long, within a millisecond or a sample."""
    try:
        rate, channels, bits, frames = flac_info(data) if data[:4] == b"fLaC" else wav_info(data)
    except (ValueError, wave.Error, EOFError, struct.error) as e:
        return f"unreadable: {e}"
    if channels != 1:
        return "not mono"
    if bits not in (16, 24, 32):
        return f"{bits} bits a sample"
    return None if abs(frames / rate - duration_s) <= max(1e-3, 1 / rate) else f"lasts {frames / rate} s, not {duration_s}"


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples in [-1, 1) as float32, channels averaged, and the rate; 16-bit PCM."""
    with wave.open(io.BytesIO(data)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM is decoded")
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
        return x.reshape(-1, w.getnchannels()).mean(axis=1, dtype=np.float32), w.getframerate()


def encode_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(samples * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum, the shorter padded with silence; scaled down only if it would clip."""
    for x in (a, b):
        if x.ndim != 1 or not np.isfinite(x).all():
            raise ValueError("a channel must be one row of finite samples")
    out = np.zeros(max(len(a), len(b)), np.float32)
    out[: len(a)] += a
    out[: len(b)] += b
    peak = float(np.abs(out).max(initial=0))
    return out / peak if peak > 1 else out


def resample(samples: np.ndarray, rate: int, target: int = RATE, *, taps: int = 32) -> np.ndarray:
    """Band-limited interpolation: a Kaiser-windowed sinc of taps zero crossings on each side, cut off below the lower of the two rates."""
    if isinstance(rate, bool) or not isinstance(rate, int) or rate <= 0:
        raise ValueError("a sample rate must be a positive integer")
    if rate == target or not len(samples):
        return np.asarray(samples, np.float32)
    count, scale = -(-len(samples) * target // rate), min(1.0, target / rate) * 0.97
    reach = int(np.ceil(taps / scale))
    padded = np.concatenate((np.zeros(reach, np.float64), samples, np.zeros(reach + 1, np.float64)))
    offsets = np.arange(-reach + 1, reach + 1)
    out = np.empty(count, np.float32)
    for at in range(0, count, 1 << 14):  # in blocks, so that memory has a bound
        place = np.arange(at, min(count, at + (1 << 14))) * (rate / target)
        first = np.floor(place).astype(np.int64)
        away = (place - first)[:, None] - offsets
        weights = scale * np.sinc(scale * away) * np.i0(12 * np.sqrt(np.clip(1 - (away / reach) ** 2, 0, None))) / np.i0(12)
        out[at : at + len(place)] = (padded[first[:, None] + offsets + reach] * weights).sum(axis=1)
    return out


def mono_mix(ch1: bytes, ch2: bytes) -> dict:
    """content, sha256, sample_rate_hz, samples, duration_s of two WAV channels' mix, each brought to RATE first."""
    first, second = (resample(*decode_wav(x)) for x in (ch1, ch2))
    samples = mix(first, second)
    content = encode_wav(samples)
    return {"content": content, "sha256": hashlib.sha256(content).hexdigest(), "sample_rate_hz": RATE, "samples": len(samples), "duration_s": len(samples) / RATE}


def reusable_mix(stored: bytes | None, ch1: bytes, ch2: bytes, sha256: str | None = None) -> dict:
    """The mix of two channels; a stored one is used again if it is what its recorded digest says, else the mix is made anew."""
    if stored is not None and sha256 and hashlib.sha256(stored).hexdigest() == sha256:
        rate, channels, _, frames = wav_info(stored)
        if (rate, channels) == (RATE, 1):
            return {"content": stored, "sha256": sha256, "sample_rate_hz": RATE, "samples": frames, "duration_s": frames / RATE, "reused": True}
    return mono_mix(ch1, ch2) | {"reused": False}


def silences(samples: np.ndarray, rate: int = RATE) -> list[tuple[float, float]]:
    """Stretches of 0.2 s and more between speech. Frames of 30 ms every 10 ms are speech if they are 18 dB above the 10th percentile of level (-90 dB at least).

    A run of frames counts from 25 ms on, from 5 ms before its first middle to 5 ms after its last, and is widened by 10 ms; pauses of up to a second are part of speech.
    """
    total, frame, hop = len(samples) / rate, max(1, int(0.03 * rate)), max(1, int(0.01 * rate))
    if len(samples) < frame:
        return [(0.0, total)] if total else []
    at = np.arange(0, len(samples) - frame + 1, hop)
    power = np.concatenate(([0.0], np.cumsum(np.asarray(samples, np.float64) ** 2)))
    level = 20 * np.log10(np.maximum(np.sqrt((power[at + frame] - power[at]) / frame), 3.16e-5))
    loud = level > max(float(np.percentile(level, 10)), -90.0) + 18
    edges = np.flatnonzero(np.diff(np.concatenate(([False], loud, [False])).astype(np.int8)))
    middle = (at + frame / 2) / rate
    spoken: list[list[float]] = []
    for a, b in zip(edges[::2], edges[1::2]):
        start = max(0.0, float(middle[a]) - 0.005)
        end = min(total, float(middle[b - 1]) + 0.005)
        if b == len(loud):
            end = total  # speech that goes on to the last frame goes on to the end
        elif end - start < 0.025:
            continue
        start, end = max(0.0, start - 0.01), min(total, end + 0.01)
        if spoken and start <= spoken[-1][1] + 1:
            spoken[-1][1] = max(spoken[-1][1], end)
        else:
            spoken.append([start, end])
    marks = [0.0, *(x for s in spoken for x in s), total]
    return [(a, b) for a, b in zip(marks[::2], marks[1::2]) if b - a >= 0.2]


def windows(duration_s: float, most_s: float, gaps: list[tuple[float, float]], *, fill: float = 0.98, least_s: float = 15.0) -> list[tuple[float, float]]:
    """Cuts a recording into windows of at most fill of most_s: as few as go, as equal as silences allow.

    Each cut is at the middle of the gap that is nearest to an equal share of what is left, of those at least least_s after the last cut and within
    the limit; without any, at the limit.
    """
    if most_s <= 0 or not 0 < fill <= 1:
        raise ValueError("the limit must be positive and fill a share")
    limit, cuts = most_s * fill, [0.0]
    middles = [(a + b) / 2 for a, b in gaps]
    while (left := duration_s - cuts[-1]) > limit:
        last = cuts[-1]
        share = last + left / math.ceil(left / limit)
        fit = [m for m in middles if last + least_s <= m <= last + limit]
        cuts.append(min(fit, key=lambda m: abs(m - share), default=last + limit))
    return list(zip(cuts, [*cuts[1:], duration_s]))


def stitch(parts: list[tuple[float, dict]]) -> dict:
    """One transcript from windows' (start, transcript): times moved, speakers named by window."""
    out: dict = {"text": " ".join(t["text"].strip() for _, t in parts if t.get("text", "").strip()), "segments": [], "words": []}
    for k, (start, transcript) in enumerate(parts):
        for kind in ("segments", "words"):
            for item in transcript.get(kind) or ():
                moved = {**item, **{c: item[c] + start for c in ("start_s", "end_s") if item.get(c) is not None}}
                out[kind].append(moved | ({"speaker": f"window{k}:{item['speaker']}"} if item.get("speaker") is not None else {}))
    return out
