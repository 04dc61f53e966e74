"""Keys as written, mixer curves, controller messages and samples as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_PI = 1.5707963267948966


def parse_key(name: Column) -> Column:
    """struct(tonic, minor) of a key as people write it: letter, sharp or flat, minor; null for anything else."""
    s = F.replace(F.replace(F.trim(name), F.lit("♯"), F.lit("#")), F.lit("♭"), F.lit("b"))
    at = r"^([A-Ga-g])([#b]?)(m|M|min|minor)?$"
    letter, accidental, minor = (F.regexp_extract(s, at, i) for i in (1, 2, 3))
    base = F.element_at(F.create_map(*[x for k, v in {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}.items() for x in (F.lit(k), F.lit(v))]), F.upper(letter))
    shift = F.when(accidental == "#", 1).when(accidental == "b", -1).otherwise(0)
    return F.when(s.rlike(at), F.struct(F.pmod(base + shift, F.lit(12)).alias("tonic"), (minor != "").alias("minor")))


def crossfader(x: Column) -> dict[str, Column]:
    """Gains at a crossfader place from -1 to 1, by curve, and a fader's gain at the same place."""
    at = (x + 1) / 2
    return {
        "linear_a": F.when(x <= 0, 1.0).otherwise(1 - x),
        "smooth_a": F.cos(at * _HALF_PI),
        "smooth_b": F.sin(at * _HALF_PI),
        "cut_a": F.when(x < 0.98, 1.0).otherwise(0.0),
        "fader": at * at,
    }


def decode(status: Column, d1: Column, d2: Column) -> dict[str, Column]:
    """Kind, channel, number and value of a three-byte controller message."""
    top = F.shiftright(status, 4)
    return {
        "kind": F.when(top == 9, "note").when(top == 11, "cc").otherwise("other"),
        "channel": status.bitwiseAND(F.lit(15)) + 1,
        "number": d1,
        "value": d2 / 127.0,
    }


def relative(raw: Column, encoding: str) -> Column:
    """Steps of an endless knob: two's complement, centred at 64, or sign in bit 6."""
    if encoding == "twos":
        return F.when(raw == 64, 0).when(raw > 64, raw - 128).otherwise(raw)
    if encoding == "centred":
        return raw - 64
    return F.when(raw > 64, -(raw - 64)).otherwise(raw)


def wheel_delta(now: Column, before: Column) -> Column:
    """The shorter way between two readings of a wheel of 128 places."""
    d = F.pmod(now - before, F.lit(128))
    return F.when(d > 64, d - 128).otherwise(d)


def samples(x: Column) -> Column:
    """16-bit samples of an array of floats; below zero the scale is one larger."""
    return F.transform(x, lambda v: F.when(v < 0, F.greatest(v.cast("double"), F.lit(-1.0)) * 32768).otherwise(F.least(v.cast("double"), F.lit(1.0)) * 32767).cast("int"))
