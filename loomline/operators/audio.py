"""WAV decoding and signal measurement as Arrow-batched functions over binary rows."""

from __future__ import annotations

import io
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.pieces import by_pieces
from loomline.sources.archives import opened

FRAME_S = 0.02
#: Amplitude floors of the level and of the end gap, full scale, and frames needed for levels.
LEVEL_FLOOR, GAP_FLOOR, FULL_SCALE, LEAST_FRAMES = 1e-10, 1e-9, 0.999, 5
PITCH_RATE, PITCH_FRAME, PITCH_HOP, PITCH_LOW, PITCH_HIGH, PITCH_FRAMES = 16000, 1024, 256, 65.0, 500.0, 10
SUBTYPES = {(1, 8): "PCM_U8", (1, 16): "PCM_16", (1, 24): "PCM_24", (1, 32): "PCM_32", (3, 32): "FLOAT", (3, 64): "DOUBLE"}

MEASURE = (
    "error string, format string, subtype string, sample_rate int, channels int, header_frames bigint, decoded_frames bigint, duration_s double, "
    "nonfinite_samples bigint, peak double, clipping_fraction double, noise_floor_dbfs double, speech_level_dbfs double, snr_proxy_db double, "
    "lead_silence_s double, trail_silence_s double, active_fraction double, rms_dbfs double"
)
FIELDS = [f.split()[0] for f in MEASURE.split(", ")]


#: The longest format chunk: that of the extensible form.
FMT_BYTES = 40


@dataclass
class Header:
    subtype: str
    rate: int
    channels: int
    frames: int
    kind: tuple[int, int]
    data: slice


def header(content: bytes) -> Header:
    """The fmt and data chunks of a RIFF/WAVE file; raises ValueError on anything else."""
    return header_of(io.BytesIO(content))


def header_of(f) -> Header:
    """The same of a file that can be sought in: chunk by chunk, and of a chunk only its head and at most FMT_BYTES of its format."""
    start = f.read(12)
    if start[:4] != b"RIFF" or start[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt = 12, None
    while len(head := f.read(8)) == 8:
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            body = f.read(min(size, FMT_BYTES))
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if tag == 0xFFFE and len(body) >= 26:
                tag = struct.unpack_from("<H", body, 24)[0]
            fmt = (tag, bits, channels, rate)
        elif name == b"data":
            if fmt is None:
                raise ValueError("data before fmt")
            tag, bits, channels, rate = fmt
            if (tag, bits) not in SUBTYPES or not channels:
                raise ValueError(f"unsupported coding {tag}/{bits}")
            return Header(SUBTYPES[tag, bits], rate, channels, size // (channels * bits // 8), (tag, bits), slice(at + 8, at + 8 + size))
        at += 8 + size + (size & 1)
        f.seek(at)
    raise ValueError("no data chunk")


def samples(content: bytes, h: Header) -> np.ndarray:
    """All frames as float32, one column a channel."""
    width = h.kind[1] // 8
    raw = content[h.data]
    raw = raw[: len(raw) // (width * h.channels) * width * h.channels]
    if h.kind[0] == 3:
        x = np.frombuffer(raw, f"<f{width}").astype(np.float32)
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8).astype(np.float32) / np.float32(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float64) / float(1 << (8 * width - 1))
    return x.astype(np.float32).reshape(-1, h.channels)


def level(power: float | np.ndarray, floor: float = LEVEL_FLOOR):
    return 20 * np.log10(np.maximum(np.sqrt(power), floor))


def measure(content: bytes | None, clip_level: float = FULL_SCALE) -> dict:
    """A clip's measurements; whatever is wrong with it goes to `error`, nothing is raised."""
    out: dict = dict.fromkeys(FIELDS)
    try:
        h = header(content or b"")
        out |= {"format": "WAV", "subtype": h.subtype, "sample_rate": h.rate, "channels": h.channels, "header_frames": h.frames}
        x = samples(content, h)
    except (ValueError, struct.error) as e:
        return out | {"error": f"unreadable: {e}"}
    n = len(x)
    out |= {"decoded_frames": n, "duration_s": round(n / h.rate, 4)}
    if not n:
        return out | {"error": "empty audio"}
    if n != h.frames:
        out["error"] = f"header says {h.frames} frames, decoded {n}"
    out["nonfinite_samples"] = int((~np.isfinite(x)).sum())
    if out["nonfinite_samples"]:
        return out | {"error": out["error"] or f"{out['nonfinite_samples']} non-finite samples"}
    mono = x.mean(axis=1)
    loud = np.abs(mono)
    out |= {"peak": round(float(loud.max()), 5), "clipping_fraction": float((loud >= clip_level).mean()), "rms_dbfs": round(float(level(np.mean(mono**2))), 2)}
    size = int(FRAME_S * h.rate)
    frames = n // size if size else 0
    if frames >= LEAST_FRAMES:
        db = level((mono[: frames * size].reshape(frames, size) ** 2).mean(axis=1))
        floor, speech = (float(np.percentile(db, p)) for p in (10, 95))
        active = np.flatnonzero(db > max(floor + 10.0, speech - 35.0))
        out |= {"noise_floor_dbfs": round(floor, 2), "speech_level_dbfs": round(speech, 2), "snr_proxy_db": round(speech - floor, 2), "active_fraction": round(len(active) / frames, 4)}
        if len(active):
            out |= {"lead_silence_s": round(float(active[0]) * FRAME_S, 3), "trail_silence_s": round(float(frames - 1 - active[-1]) * FRAME_S, 3)}
    return out


def end_gap(content: bytes) -> float | None:
    """How far the last 100 ms lie below the clip's speech level, in dB."""
    m = measure(content)
    if m["speech_level_dbfs"] is None:
        return None
    h = header(content)
    tail = samples(content, h).mean(axis=1)[-int(0.1 * h.rate) :]
    return float(m["speech_level_dbfs"] - 20 * np.log10(np.sqrt(np.mean(tail**2)) + GAP_FLOOR))


@lru_cache(maxsize=16)
def sinc_filters(rate: int, to: int, half: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(reach, first sample, filter) of the output samples of one period: places repeat after to / gcd of them, `rate / gcd` input samples on."""
    p, q = rate // math.gcd(rate, to), to // math.gcd(rate, to)
    scale = min(1.0, to / rate)
    reach = math.ceil(half / scale)
    taps = np.arange(-reach + 1, reach + 1)
    whole, rest = np.divmod(np.arange(q, dtype=np.int64) * p, q)
    d = (rest / q)[:, None] - taps
    window = np.i0(10.0 * np.sqrt(np.maximum(0.0, 1 - (d / reach) ** 2))) / np.i0(10.0)
    return reach, whole, np.sinc(d * scale) * window * scale


def resampled(x: np.ndarray, rate: int, to: int, half: int = 32) -> np.ndarray:
    """Band-limited resampling by a Kaiser-windowed sinc, evaluated for each output sample."""
    if rate == to:
        return x.astype(np.float64)
    n = round(len(x) * to / rate)
    reach, whole, filters = sinc_filters(rate, to, half)
    p, q = rate // math.gcd(rate, to), len(whole)
    padded = np.concatenate([np.zeros(reach), x.astype(np.float64), np.zeros(reach + 1)])
    out = np.empty(n)
    if n:
        windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach)
    for i in range(min(q, n)):  # the output samples that share a filter
        mine, rows = out[i::q], windows[whole[i] + 1 :: p]
        for a in range(0, len(mine), 1 << 14):
            mine[a : a + (1 << 14)] = rows[a : min(len(mine), a + (1 << 14))] @ filters[i]
    return out


#: Fixed values of probabilistic YIN: thresholds and how likely each is (a beta(2, 18) density), what a frame without a trough
#: below them is worth, bins a semitone, octaves a second that a voice may move, chance that voicing changes, silence.
THRESHOLDS = np.arange(1, 101) / 100
PRIOR = THRESHOLDS * (1 - THRESHOLDS) ** 17 / np.sum(THRESHOLDS * (1 - THRESHOLDS) ** 17)
NO_TROUGH, BINS, MOST_OCTAVES_S, SWITCH, SILENT = 0.01, 5, 35.92, 0.01, 1e-4
#: A trough's height is the share of a frame's power that does not repeat. A frame of whose power less than half repeats at any pitch is unvoiced: the
#: path alone would follow NO_TROUGH's worth from hiss to hiss, as that lies in one bin and the rest is shared out over all.
APERIODIC = 0.5


#: Sums of the thresholds' shares from each one on, and up to each one.
FROM, UP_TO = np.append(np.cumsum(PRIOR[::-1])[::-1], 0.0), np.insert(np.cumsum(PRIOR), 0, 0.0)
#: Clips that are tracked together, and their frames: scores are held.
TOGETHER, TRACKED = 64, 8192


def differences(x: np.ndarray, frames: int, lags: int) -> np.ndarray:
    """A row a frame: the cumulative-mean-normalised difference of the frame and itself `lags` later at most. Products are summed by
    blocks of a hop, which the frames share."""
    per = PITCH_FRAME // PITCH_HOP
    size = 1 << (PITCH_HOP + lags).bit_length()
    padded = np.concatenate([x, np.zeros(max(0, (frames + per) * PITCH_HOP + lags - len(x)))])
    later = np.lib.stride_tricks.sliding_window_view(padded, PITCH_HOP + lags)[:: PITCH_HOP][: frames + per - 1]
    products = np.fft.irfft(np.fft.rfft(later, size) * np.fft.rfft(later[:, :PITCH_HOP], size).conj(), size)[:, : lags + 1]
    products = sum(products[b : frames + b] for b in range(per))
    squares = padded**2
    blocks = squares[: (frames + per - 1) * PITCH_HOP].reshape(-1, PITCH_HOP).sum(axis=1)
    energy = sum(blocks[b : frames + b] for b in range(per))[:, None]
    ahead = np.lib.stride_tricks.sliding_window_view(squares, lags)[:: PITCH_HOP]
    moved = np.zeros((frames, lags + 1))
    np.cumsum(ahead[per : frames + per] - ahead[:frames], axis=1, out=moved[:, 1:])
    d = 2 * energy + moved - 2 * products
    mean = np.cumsum(d[:, 1:], axis=1) / np.arange(1, lags + 1)
    out = np.concatenate([np.ones((frames, 1)), d[:, 1:] / np.maximum(mean, 1e-12)], axis=1)
    out[np.sqrt(energy[:, 0] / PITCH_FRAME) < SILENT] = 1.0  # no trough
    return out


def pitch_candidates(norm: np.ndarray, rate: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(frame, frequency, probability, height) of all frames' candidates, in order: each threshold gives its share to the frame's first trough below it."""
    value = norm[:, low:high]
    trough = (value <= norm[:, low - 1 : high - 1]) & (value < norm[:, low + 1 : high + 1])
    least = np.minimum.accumulate(np.where(trough, value, np.inf), axis=1)
    frame, at = np.nonzero(trough)
    own = value[frame, at]
    below = lambda v: np.searchsorted(THRESHOLDS, v, side="right")  # noqa: E731  thresholds that are not above v
    before = np.where(at > 0, least[frame, at - 1], np.inf)
    share = np.maximum(0.0, FROM[below(own)] - FROM[below(before)])
    lowest = np.flatnonzero((own == least[frame, -1]) & (own < before) & (own < THRESHOLDS[-1]))  # the first of the frame's least troughs
    share[lowest] += NO_TROUGH * UP_TO[below(own[lowest])]
    t = at + low
    a, b, c = norm[frame, t - 1], own, norm[frame, t + 1]
    bend = a - 2 * b + c
    return frame, rate / (t + np.where(bend > 1e-12, 0.5 * (a - c) / np.maximum(bend, 1e-12), 0.0)), share, own


def pitch_tracks(clips: list[np.ndarray], rate: int = PITCH_RATE) -> list[np.ndarray]:
    """Each clip's fundamental frequency per frame, NaN where unvoiced: probabilistic YIN, the likeliest path through pitch and voicing.
    Clips are taken together, frame by frame."""
    high = int(rate / PITCH_LOW) + 1
    frames = np.array([max(0, (len(x) - PITCH_FRAME - high - 1) // PITCH_HOP + 1) for x in clips], np.int64)
    order, out = np.argsort(-frames, kind="stable"), [np.empty(0)] * len(clips)
    a = 0
    while a < len(order):
        b = a + min(TOGETHER, max(1, TRACKED // max(1, int(frames[order[a]]))))
        for i, track in zip(order[a:b], tracked([clips[i] for i in order[a:b]], frames[order[a:b]], rate)):
            out[i] = track
        a = b
    return out


def tracked(clips: list[np.ndarray], frames: np.ndarray, rate: int) -> list[np.ndarray]:
    """The tracks of clips that hold so many frames, longer ones first."""
    low, high = int(rate / PITCH_HIGH), int(rate / PITCH_LOW) + 1
    most = int(frames.max(initial=0))
    if not most:
        return [np.empty(0) for _ in clips]
    n = int(round(12 * math.log2(PITCH_HIGH / PITCH_LOW) * BINS)) + 1
    reach = max(1, int(MOST_OCTAVES_S * 12 * BINS * PITCH_HOP / rate))
    step = np.concatenate([np.arange(1, reach + 2), np.arange(reach, 0, -1)]).astype(float)
    step = np.log(step / step.sum())
    stay, change = math.log(1 - SWITCH), math.log(SWITCH)
    found = []
    for c, x in enumerate(clips):
        for k in range(0, int(frames[c]), TRACKED):  # a long clip's spectra are not held at once
            count = min(TRACKED, int(frames[c]) - k)
            frame, freq, share, height = pitch_candidates(differences(x[k * PITCH_HOP : (k + count - 1) * PITCH_HOP + PITCH_FRAME + high + 1], count, high + 1), rate, low, high)
            found.append((np.full(len(frame), c), frame + k, freq, share, height))
    clip, frame, freq, share, height = (np.concatenate(x) for x in zip(*found))
    bins = np.clip(np.round(12 * BINS * np.log2(freq / PITCH_LOW)), 0, n - 1).astype(int)
    seen = np.zeros((most, 2, n, len(clips)))  # voiced, unvoiced
    np.add.at(seen, (frame, 0, bins, clip), share)
    seen[:, 1] = (np.maximum(0.0, 1 - np.bincount(frame * len(clips) + clip, share, most * len(clips))) / n).reshape(most, 1, len(clips))
    np.log(np.maximum(seen, 1e-12, out=seen), out=seen)

    held = seen  # a frame's row becomes what the frame before it came to
    score = np.full((2, n, len(clips)), -math.log(2 * n))
    for k in range(most):
        live = int((frames > k).sum())
        came = np.full((2, n + 2 * reach, live), -np.inf)
        (voiced, unvoiced), middle = score[:, :, :live], slice(reach, n + reach)
        np.maximum(voiced + stay, unvoiced + change, out=came[0, middle])
        np.maximum(voiced + change, unvoiced + stay, out=came[1, middle])
        best, pair = came[:, middle] + step[reach], np.empty((2, n, live))
        for o in range(reach):
            np.maximum(came[:, o : o + n], came[:, 2 * reach - o : 2 * reach - o + n], out=pair)
            np.add(pair, step[o], out=pair)
            np.maximum(best, pair, out=best)
        best += seen[k, :, :, :live]
        held[k, :, :, :live] = score[:, :, :live]
        score[:, :, :live] = best

    state = score.reshape(2 * n, -1).argmax(axis=0)
    path = np.full((len(clips), most), -1)
    around = np.arange(-reach, reach + 1)
    for k in range(most - 1, -1, -1):
        live = int((frames > k).sum())
        path[:live, k] = state[:live]
        side, at = state[:live, None] // n, state[:live, None] % n
        near = at + around
        inside = np.clip(near, 0, n - 1)
        rows = np.arange(live)[:, None]
        # from voiced and from unvoiced; of equal ones the first
        both = np.stack([held[k, 0, inside, rows] + np.where(side == 0, stay, change), held[k, 1, inside, rows] + np.where(side == 0, change, stay)])
        back = np.where((near >= 0) & (near < n), both.max(axis=0), -np.inf) + step
        best = back.argmax(axis=1)
        state[:live] = both[:, np.arange(live), best].argmax(axis=0) * n + inside[np.arange(live), best]

    repeats = np.zeros(path.shape, bool)
    repeats[clip[height < APERIODIC], frame[height < APERIODIC]] = True
    voiced = (path >= 0) & (path < n) & repeats
    track = np.where(voiced, PITCH_LOW * 2 ** (path / (12 * BINS)), np.nan)
    close = np.flatnonzero(voiced[clip, frame] & (np.abs(bins - path[clip, frame]) <= 1))
    off = np.abs(np.log(freq[close] / track[clip[close], frame[close]]))
    close = close[np.lexsort((np.arange(len(close)), off, frame[close], clip[close]))]
    place = clip[close] * most + frame[close]
    first = close[np.flatnonzero(np.diff(place, prepend=-1))]
    track[clip[first], frame[first]] = freq[first]
    return [t[:k] for t, k in zip(track, frames)]


def pitch_track(x: np.ndarray, rate: int = PITCH_RATE) -> np.ndarray:
    """The same of one clip."""
    return pitch_tracks([x], rate)[0]


def pitch_profile(content: bytes) -> dict:
    """Voiced share; with enough voiced frames also the median and the p10-p90 range in semitones."""
    return pitch_profiles([content])[0]


def pitch_profiles(contents: list[bytes]) -> list[dict]:
    """The same of several clips."""
    out, clips, of = [dict.fromkeys(("f0_median_hz", "f0_range_st", "voiced_fraction")) for _ in contents], [], []
    for found, content in zip(out, contents):
        try:
            h = header(content)
            x = resampled(samples(content, h).mean(axis=1), h.rate, PITCH_RATE)
        except (ValueError, struct.error):
            continue
        clips.append(np.clip(x, -1, 1))
        of.append(found)
    for found, f0 in zip(of, pitch_tracks(clips)):
        voiced = f0[np.isfinite(f0)]
        found["voiced_fraction"] = round(len(voiced) / len(f0), 4) if len(f0) else 0.0
        if len(voiced) >= PITCH_FRAMES:
            a, b = np.percentile(voiced, [10, 90])
            found |= {"f0_median_hz": round(float(np.median(voiced)), 2), "f0_range_st": round(12 * math.log2(b / a), 3)}
    return out


def wav_bytes(x: np.ndarray, rate: int, subtype: str = "PCM_16") -> bytes:
    """A RIFF/WAVE file of float samples (frames, or frames x channels), clipped to full scale unless it holds floats."""
    x = np.atleast_2d(np.asarray(x, np.float64).T).T
    if subtype == "FLOAT":
        tag, width, raw = 3, 4, x.astype("<f4").tobytes()
    else:
        width = {"PCM_16": 2, "PCM_24": 3, "PCM_32": 4}[subtype]
        top = (1 << (8 * width - 1)) - 1
        whole = np.clip(np.round(x * (top + 1)), -top - 1, top).astype("<i2" if width == 2 else "<i4")
        tag, raw = 1, whole.tobytes() if width != 3 else whole.reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    out = io.BytesIO()
    fmt = struct.pack("<HHIIHH", tag, x.shape[1], rate, rate * x.shape[1] * width, x.shape[1] * width, 8 * width)
    out.write(b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(raw)) + raw)
    return out.getvalue()


def prepared(content: bytes, rate: int, subtype: str = "PCM_24") -> dict:
    """Channel 0 at another rate as a new WAV file, with how far its length (frames) and level (dB) are off."""
    h = header(content)
    x = samples(content, h)[:, 0].astype(np.float64)
    y = resampled(x, h.rate, rate)
    wav = wav_bytes(y, rate, subtype)
    back = samples(wav, header(wav))[:, 0].astype(np.float64)
    return {"wav": wav, "length_error": abs(len(back) - round(len(x) * rate / h.rate)), "level_error_db": float(abs(level(np.mean(x**2)) - level(np.mean(back**2))))}


def measured(content: Column) -> Column:
    return by_pieces(lambda contents: [measure(c) for c in contents], MEASURE, "measure")(content)


def pitched(content: Column) -> Column:
    return by_pieces(pitch_profiles, "f0_median_hz double, f0_range_st double, voiced_fraction double")(content)


def end_gap_db(content: Column) -> Column:
    return by_pieces(lambda contents: [end_gap(c) for c in contents], "double", "end_gap")(content)


def resampled_wav(content: Column, rate: int) -> Column:
    return by_pieces(lambda contents: [prepared(c, rate) for c in contents], "wav binary, length_error bigint, level_error_db double", "prepared")(content)


def said_of(f, rate: int) -> str:
    """What is wrong with a WAV header: not WAV, no frames, another rate, not mono; joined by '; ', empty if nothing."""
    try:
        h = header_of(f)
    except (ValueError, struct.error) as e:
        return f"not WAV: {e}"
    found = [(h.frames <= 0, "no frames"), (h.rate != rate, f"{h.rate} Hz"), (h.channels != 1, f"{h.channels} channels")]
    return "; ".join(text for bad, text in found if bad)


def header_problems(content: Column, rate: int = 48000) -> Column:
    """What is wrong with the header of a file that is in memory."""
    return by_pieces(lambda contents: [said_of(io.BytesIO(c), rate) for c in contents], "string", "said_of")(content)


def scanned_headers(paths: DataFrame, rate: int = 48000, path: str = "path") -> DataFrame:
    """(path, problems) of WAV files of any size: each is opened where the row is and only its header is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = batch.column(0).to_pylist(), []
            for name in names:
                with opened(name) as f:
                    found.append(said_of(f, rate))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "problems"])

    return paths.select(F.col(path).alias("path")).mapInArrow(run, "path string, problems string")


def inventory(files: DataFrame, transcripts: DataFrame, pitch_sample: DataFrame | None = None) -> DataFrame:
    """Measured clips of binaryFile rows: content is read once, only scalars leave the workers."""
    from loomline.operators.gates import quality_issues

    rows = files.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.wav$", 1)).withColumn("m", measured(F.col("content")))
    rows = rows.select("path", "stem", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "m.*", *(["content"] if pitch_sample is not None else []))
    if pitch_sample is not None:
        wanted = rows.join(pitch_sample.select("stem").withColumn("want_pitch", F.lit(True)), "stem", "left")
        rows = wanted.withColumn("p", F.when(F.col("want_pitch"), pitched(F.when(F.col("want_pitch"), F.col("content")).otherwise(F.lit(b""))))).select("*", "p.*").drop("p", "content", "want_pitch")
    return rows.join(transcripts, "stem", "left").withColumn("issues", quality_issues())
