"""Column expressions shared by the operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from earshot.constants import FRAME_SAMPLES, GROUPING_SECONDS, SAMPLE_RATE


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- levels --------------------------------------------------------------------


def rms(samples: str | Column) -> Column:
    """Root mean square of an array column, summed in element order."""
    samples = _col(samples)
    power = F.aggregate(
        samples, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")
    )
    return F.sqrt(power / F.size(samples))


def rms_floored(samples: str | Column, floor: float = 1e-6) -> Column:
    return F.greatest(rms(samples), F.lit(floor))


def rms_padded(samples: str | Column, pad: float = 1e-9) -> Column:
    return rms(samples) + pad


def peak(samples: str | Column) -> Column:
    return F.array_max(F.transform(_col(samples), lambda v: F.abs(v.cast("double"))))


def scaled(samples: str | Column, divisor: Column) -> Column:
    return F.transform(_col(samples), lambda v: v.cast("double") / divisor)


def peak_guard(samples: str | Column) -> Column:
    """Leave quiet audio alone; bring anything louder than full scale down to it."""
    return scaled(samples, F.greatest(F.lit(1.0), peak(samples)))


def level_normalise(samples: str | Column) -> Column:
    """RMS 0.1, or as near as a peak of 0.99 allows."""
    return scaled(samples, F.greatest(rms_floored(samples) / 0.1, peak(samples) / 0.99))


def pcm16(samples: str | Column) -> Column:
    """16-bit samples, truncated toward zero."""
    return F.transform(_col(samples), lambda v: (v * 32767).cast("int").cast("short"))


def snr_gain(level: Column, snr_db: Column) -> Column:
    """Amplitude of unit-RMS interference that sits ``snr_db`` below ``level``."""
    return level / F.pow(F.lit(10.0), snr_db / 20)


# --- frames and durations --------------------------------------------------------


def frame_count(n_samples: str | Column) -> Column:
    """Embedding frames that a clip of ``n_samples`` yields."""
    mel = F.ceil(_col(n_samples) / 160.0 - 3)
    return F.floor((mel - 76) / 8) + 1


def frame_seconds(frame: str | Column) -> Column:
    return _col(frame) * FRAME_SAMPLES / SAMPLE_RATE


def hours(windows: str | Column, step_seconds: Column) -> Column:
    return _col(windows) * step_seconds / 3600


def grouping_width(step_seconds: str | Column) -> Column:
    """Frames in the grouping time, rounded half to even and at least one."""
    return F.greatest(F.lit(1), F.bround(F.lit(GROUPING_SECONDS) / _col(step_seconds)).cast("int"))


def clip_seconds(n_samples: str | Column, rate: str | Column) -> Column:
    """Duration; 0 for a clip that could not be read."""
    return F.coalesce(F.try_divide(_col(n_samples), _col(rate)), F.lit(0.0))


# --- statistics --------------------------------------------------------------------


def recall_standard_error(recall: Column, n: Column) -> Column:
    return F.sqrt(recall * (1 - recall) / n)


def poisson_low(events: str | Column) -> Column:
    """Lower end of the 95% Wilson-Hilferty interval of a count."""
    n = _col(events).cast("double")
    root = 1 - 1 / (9 * n) - 1.96 / (3 * F.sqrt(n))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), n * F.pow(root, F.lit(3.0))))


def poisson_high(events: str | Column) -> Column:
    n = _col(events).cast("double") + 1
    root = 1 - 1 / (9 * n) + 1.96 / (3 * F.sqrt(n))
    return F.when(n == 1, F.lit(3.69)).otherwise(n * F.pow(root, F.lit(3.0)))


# --- seeded draws ----------------------------------------------------------------------


def seeded_key(seed: int | str, *parts: str | Column) -> Column:
    """A hex key that orders rows at random, the same on every run and engine."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[_col(p).cast("string") for p in parts]), 256)


def seeded_bits(seed: int | str, *parts: str | Column) -> Column:
    """A non-negative long below 2 ** 48, uniform."""
    return F.conv(F.substring(seeded_key(seed, *parts), 1, 12), 16, 10).cast("long")


def seeded_unit(seed: int | str, *parts: str | Column) -> Column:
    """A double in [0, 1), uniform."""
    return seeded_bits(seed, *parts) / float(1 << 48)


# --- text ------------------------------------------------------------------------------


def path_name(path: str | Column) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def path_stem(path: str | Column) -> Column:
    return F.regexp_replace(path_name(path), r"(?<=.)\.[^.]+$", "")


def path_suffix(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(path_name(path), r"(?<=.)\.([^.]+)$", 1))


def indexed_name(index: str | Column, width: int = 5) -> Column:
    """Zero-padded number; longer numbers keep all digits."""
    text = _col(index).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def fixed_point(value: str | Column, digits: int = 3) -> Column:
    """Fixed-point text of the exact binary value, with ``-`` for a missing one.

    The JVM formatters round the shortest decimal form instead: 0.0005 and 0.0625
    would come out differently. Reports are small, so a batched UDF will do.
    """

    def show(values: pd.Series) -> pd.Series:
        return values.map(lambda v: "-" if pd.isna(v) else f"{v:.{digits}f}")

    return pandas_udf(show, StringType())(_col(value).cast("double"))


# --- time ------------------------------------------------------------------------------


def iso_utc(moment: str | Column) -> Column:
    """ISO text of a timestamp; the session time zone must be UTC."""
    return F.date_format(_col(moment), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def elapsed_seconds(start: str | Column, stop: str | Column, digits: int = 1) -> Column:
    at = lambda moment: F.unix_micros(_col(moment).cast("timestamp"))
    micros = at(stop) - at(start)
    return F.round(micros / 1_000_000, digits)
