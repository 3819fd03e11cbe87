"""NumPy helpers for single clips, called on Arrow batches inside tasks."""

from __future__ import annotations

import io
import wave
from functools import lru_cache

import numpy as np

from earshot.constants import FEATURE_WIDTH, SAMPLE_RATE, WINDOW_FRAMES


def encode_wav(samples, rate: int = SAMPLE_RATE, channels: int = 1) -> bytes:
    """16-bit PCM; samples are interleaved when there are several channels."""
    pcm = (np.asarray(samples, dtype=np.float64) * 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as writer:
        writer.setnchannels(channels)
        writer.setsampwidth(2)
        writer.setframerate(rate)
        writer.writeframes(pcm.tobytes())
    return out.getvalue()


def decode_wav(content: bytes, rate: int = SAMPLE_RATE):
    """Mono float32 at ``rate``, or None for anything but readable PCM WAV."""
    try:
        with wave.open(io.BytesIO(content)) as reader:
            width, channels = reader.getsampwidth(), reader.getnchannels()
            source, raw = reader.getframerate(), reader.readframes(reader.getnframes())
    except (wave.Error, EOFError, TypeError, ValueError):
        return None
    if channels < 1 or source < 1:
        return None
    raw = raw[:len(raw) // (width * channels) * width * channels]  # a cut-off file ends inside a frame
    if width == 1:
        samples = (np.frombuffer(raw, dtype=np.uint8).astype(np.float32) - 128) / 128
    elif width in (2, 4):
        samples = np.frombuffer(raw, dtype=f"<i{width}").astype(np.float32) / 2.0 ** (8 * width - 1)
    elif width == 3:
        wide = np.zeros((len(raw) // 3, 4), dtype=np.uint8)
        wide[:, 1:] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3)
        samples = wide.view("<i4")[:, 0].astype(np.float32) / 2.0 ** 31
    else:
        return None
    mono = samples.reshape(-1, channels).mean(axis=1)
    return resample(mono, source, rate).astype(np.float32)


def resample(samples, source: int, target: int):
    """Band-limited resampling in the frequency domain."""
    if source == target or len(samples) == 0:
        return samples
    n = max(1, round(len(samples) * target / source))
    spectrum = np.fft.rfft(samples)
    kept = np.zeros(n // 2 + 1, dtype=complex)
    shared = min(len(kept), len(spectrum))
    kept[:shared] = spectrum[:shared]
    return np.fft.irfft(kept, n) * (n / len(samples))


def level(samples) -> float:
    return float(np.sqrt(np.mean(np.square(samples, dtype=np.float64)))) if len(samples) else 0.0


def reverberate(voice, response, tail: float = 0.5, longest: float = 1.0, rate: int = SAMPLE_RATE):
    """Convolve with at most ``longest`` seconds of a response; keep the voice's level."""
    voice = np.asarray(voice, dtype=np.float64)
    response = np.asarray(response, dtype=np.float64)[: int(longest * rate)]
    n = len(voice) + len(response) - 1
    wet = np.fft.irfft(np.fft.rfft(voice, n) * np.fft.rfft(response, n), n)
    wet = wet[: len(voice) + int(tail * rate)]
    return wet / (level(wet) + 1e-9) * (level(voice) + 1e-9)


def white_noise(n: int, seed: int):
    noise = np.random.default_rng(seed).standard_normal(n)
    return noise / (level(noise) + 1e-9)


def pink_noise(n: int, seed: int):
    """Noise whose amplitude falls with the square root of frequency."""
    spectrum = np.fft.rfft(np.random.default_rng(seed).standard_normal(n))
    falling = spectrum / np.sqrt(np.maximum(np.arange(len(spectrum)), 1))
    noise = np.fft.irfft(falling, n)
    return noise / (level(noise) + 1e-9)


def log_mel_features(samples, frames: int = WINDOW_FRAMES, bands: int = FEATURE_WIDTH):
    """(frames, bands) log energies; same shape as the embedding, not the same values."""
    samples = np.asarray(samples, dtype=np.float64)
    block = max(1, len(samples) // frames)
    fft = max(2 * bands, 1 << (block - 1).bit_length())
    padded = np.zeros((frames, block))
    used = samples[: frames * block]
    padded.reshape(-1)[: len(used)] = used
    taper, weights = _mel_tables(block, fft, bands)
    power = np.abs(np.fft.rfft(padded * taper, fft)) ** 2
    return np.log(power @ weights + 1e-10).astype(np.float32)


@lru_cache(maxsize=16)
def _mel_tables(block: int, fft: int, bands: int):
    """The taper and band weights of a block size, the same for every clip of it."""
    edges = np.linspace(0, 2595 * np.log10(1 + SAMPLE_RATE / 2 / 700), bands + 2)
    bins = (10 ** (edges / 2595) - 1) * 700 / (SAMPLE_RATE / 2) * (fft // 2)
    at = np.arange(fft // 2 + 1)[:, None]
    rise = (at - bins[:-2]) / np.maximum(bins[1:-1] - bins[:-2], 1e-9)
    fall = (bins[2:] - at) / np.maximum(bins[2:] - bins[1:-1], 1e-9)
    return np.hanning(block + 2)[1:-1], np.maximum(0, np.minimum(rise, fall))
