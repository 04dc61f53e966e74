"""Tempo, key, energy and genre as Column expressions. Unknown values (0, null, '') have scores of their own."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BAR_CHOICES = (4, 8, 16, 32, 48, 64)
PITCH_RANGES = (8, 16, 25, 50, 100)
KEY_SHIFTS = (0, 1, -1, 2, -2, 3, -3, 4, -4, 5, -5, 6)


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding with halves towards plus infinity."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def tempo_ratio(a: Column, b: Column) -> Column:
    """a / b brought next to 1 by whole octaves; 0 where a tempo is unknown."""
    r = a / F.nullif(b, F.lit(0.0))
    down = r / F.pow(F.lit(2.0), F.ceil(F.log2(r / 1.5)))
    up = r * F.pow(F.lit(2.0), F.ceil(F.log2(0.67 / r)))
    near = F.when(r > 1.5, down).when(r < 0.67, up).otherwise(r)
    return F.when((F.coalesce(a, F.lit(0.0)) == 0) | (F.coalesce(b, F.lit(0.0)) == 0), 0.0).otherwise(near)


def pitch_needed(a: Column, b: Column) -> Column:
    return F.abs(tempo_ratio(a, b) - 1) * 100


def bpm_score(a: Column, b: Column) -> Column:
    d = pitch_needed(a, b)
    return (
        F.when(tempo_ratio(a, b) == 0, 0.35)
        .when(d <= 1, 1.0)
        .when(d <= 3, 0.9 - (d - 1) * 0.05)
        .when(d <= 6, 0.8 - (d - 3) * 0.12)
        .when(d <= 10, 0.44 - (d - 6) * 0.1)
        .otherwise(0.0)
    )


def key_score(na: Column, la: Column, nb: Column, lb: Column) -> Column:
    """Two places on the Camelot wheel; the first rule that holds counts."""
    d = F.least(F.abs(na - nb), 12 - F.abs(na - nb))
    same = la == lb
    return (
        F.when(na.isNull() | nb.isNull(), 0.4)
        .when((na == nb) & same, 1.0)
        .when(na == nb, 0.9)
        .when(same & (d == 1), 0.9)
        .when(same & (d == 2), 0.55)
        .when(~same & (d == 1), 0.45)
        .when(same & (F.pmod(nb - na, F.lit(12)) == 7), 0.5)
        .otherwise(0.1)
    )


def harmonic_match(na: Column, la: Column, nb: Column, lb: Column) -> Column:
    d = F.abs(na - nb)
    return F.coalesce((na == nb) | ((la == lb) & d.isin(1, 11)), F.lit(False))


def target_energy(strategy: str, current: Column, step: Column | int) -> Column:
    step = step if isinstance(step, Column) else F.lit(step)
    cur = F.coalesce(F.nullif(current, F.lit(0)), F.lit(6)).cast("double")
    if strategy == "rise":
        return F.least(F.lit(10.0), cur + F.when(step % 2 == 0, 1.0).otherwise(0.0))
    if strategy == "wave":
        return F.greatest(F.lit(3.0), F.least(F.lit(10.0), 6.5 + F.sin(step / 6.0 * F.lit(3.141592653589793) * 2) * 3))
    if strategy == "chill":
        return F.least(cur, F.lit(5.0))
    return F.lit(9.0) if strategy == "peak" else cur


def energy_score(energy: Column, want: Column) -> Column:
    return F.when(F.coalesce(energy, F.lit(0)) == 0, 0.5).otherwise(1 - F.least(F.lit(1.0), F.abs(energy - want) / 5))


def genre_words(genre: Column) -> Column:
    return F.filter(F.split(F.lower(genre), r"[,/;&]+|\s+"), lambda w: F.length(w) > 2)


def genre_similarity(a: Column, b: Column) -> Column:
    x, y = genre_words(a), genre_words(b)
    unknown = F.coalesce(F.length(a), F.lit(0)).eqNullSafe(0) | F.coalesce(F.length(b), F.lit(0)).eqNullSafe(0)
    return F.when(unknown, 0.5).when((F.size(x) == 0) | (F.size(y) == 0), 0.5).when(F.arrays_overlap(x, y), 1.0).otherwise(0.2)


def candidate_score(cur: dict[str, Column], cand: dict[str, Column], strategy: str = "steady", step: int = 0) -> Column:
    """How well a candidate follows a track: tempo, key, energy and genre, less what speaks against it. The random
    term of a live mix is left out. Columns: bpm, camelot_n, camelot_l, energy, genre, artist; recent and plays of the candidate."""
    want = target_energy(strategy, cur["energy"], step)
    score = (
        0.34 * bpm_score(cur["bpm"], cand["bpm"])
        + 0.3 * key_score(cur["camelot_n"], cur["camelot_l"], cand["camelot_n"], cand["camelot_l"])
        + 0.22 * energy_score(cand["energy"], want)
        + 0.09 * genre_similarity(cur["genre"], cand["genre"])
    )
    score = score - F.when(F.coalesce(cur["artist"] == cand["artist"], F.lit(False)) & (F.length(cur["artist"]) > 0), 0.08).otherwise(0.0)
    if "recent" in cand:
        score = score - F.when(F.coalesce(cand["recent"], F.lit(False)), 1.0).otherwise(0.0)
    if "plays" in cand:
        score = score - F.least(F.lit(0.05), F.coalesce(cand["plays"], F.lit(0)) * 0.005)
    return score


def opener_score(energy: Column, strategy: str = "steady") -> Column:
    want = {"peak": 9, "chill": 3}.get(strategy, 5)
    return 1 - F.abs(F.coalesce(F.nullif(energy, F.lit(0)), F.lit(5)) - want) / 10


def plan_transition(from_bpm: Column, to_bpm: Column, key: Column, from_energy: Column, to_energy: Column) -> Column:
    """Type of a transition; of compatible tracks, a bass swap (the live mix draws)."""
    ratio, need = tempo_ratio(from_bpm, to_bpm), pitch_needed(from_bpm, to_bpm)
    a, b = (F.coalesce(F.nullif(e, F.lit(0)), F.lit(5)) for e in (from_energy, to_energy))
    return F.when((ratio == 0) | (need > 8), "echo").when(key < 0.5, "filter").when(b > a, "bassswap").when(b < a - 2, "fade").otherwise("bassswap")


def ease(p: Column) -> Column:
    return 0.5 - 0.5 * F.cos(F.lit(3.141592653589793) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def transition_state(kind: Column, p: Column) -> dict[str, Column]:
    """Crossfader, basses, filter, level and echo of a transition at progress p, by its type."""
    swap = F.when(p < 0.5, ease(p / 0.5) * 0.5).otherwise(0.5 + ease((p - 0.5) / 0.5) * 0.5)
    late = p >= 0.5
    return {
        "xf": F.when(kind == "bassswap", swap).when(kind == "filter", ease((p - 0.15) / 0.85)).when(kind == "echo", ease((p - 0.55) / 0.45)).when(kind == "cut", F.when(late, 1.0).otherwise(0.0)).when(kind == "rapid", F.when(p >= 0.98, 1.0).otherwise(0.0)).otherwise(ease(p)),
        "out_low": F.when(kind.isin("bassswap", "rapid") & late, -1.0).otherwise(0.0),
        "in_low": F.when((kind == "bassswap") & ~late, -1.0).otherwise(0.0),
        "out_filter": F.when(kind == "filter", ease(p / 0.9) * 0.85).when(kind == "rapid", ease(p / 0.9) * 0.6).otherwise(0.0),
        "out_level": F.when((kind == "echo") & (p >= 0.6), 0.0).otherwise(1.0),
        "echo": F.when((kind == "echo") & (p >= 0.35), 1.0).otherwise(0.0),
    }


def energy_level(db: Column, sustained: Column) -> Column:
    """Level 1 to 10 of a loudness in dB and the share of loud bars."""
    loud = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (db + 24) / 16))
    return F.floor(1 + 9 * (0.6 * loud + 0.4 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), sustained))) + 0.5).cast("int")


def bar_length(bpm: Column) -> Column:
    return 240 / F.nullif(bpm, F.lit(0.0))


def bar_number(sec: Column, offset: Column, bpm: Column) -> Column:
    return (F.floor((sec - offset) / bar_length(bpm) + 0.5) + 1).cast("int")


def step_point(sec: Column, bars: int, offset: Column, bpm: Column, duration: Column) -> Column:
    """A point moved by bars, kept on the grid and within the track."""
    bar = bar_length(bpm)
    last = F.greatest(F.lit(0), F.floor((duration - offset) / bar) - 1)
    return offset + F.greatest(F.lit(0), F.least(last, F.floor((sec - offset) / bar + 0.5) + bars)) * bar


def auto_base_start(bpm: Column, offset: Column, duration: Column, mix_out: Column, bars: int = 16, fade_bars: int = 4) -> Column:
    bar = bar_length(bpm)
    latest = duration - (bars + fade_bars) * bar - 0.5
    at = F.least(F.when(mix_out < duration - 4, mix_out).otherwise(latest - 8), latest)
    return offset + F.greatest(F.lit(0), F.floor((at - offset) / bar + 1e-6)) * bar


def snap_down(sec: Column, unit: Column, offset: Column) -> Column:
    """The grid point at or before sec, a little early counting as on it."""
    return offset + F.floor((sec - offset) / unit + 0.02) * unit


def nearest_choice(n: Column, choices: tuple[int, ...] = BAR_CHOICES) -> Column:
    """The choice nearest to n, the first on a tie."""
    return reduce(lambda best, c: F.when(F.abs(F.lit(c) - n) < F.abs(best - n), F.lit(c)).otherwise(best), choices[1:], F.lit(choices[0]))


def tempo_right(estimate: Column, truth: Column, factors: tuple[float, ...] = (1, 2, 0.5, 3, 1 / 3)) -> Column:
    """Whether a tempo is within 4 % of the truth or of one of its multiples."""
    return F.exists(F.array(*[F.lit(float(f)) for f in factors]), lambda f: F.abs(estimate - truth * f) <= 0.04 * truth * f)


def mixer_controls(gain_a: Column, gain_b: Column) -> Column:
    """Nine controls from the gains of two decks in three bands: crossfader from 0 to 1, three equalizer places of each deck
    from -1 (30 dB down) to 0, two filters at rest. The crossfader is the place, of 201, whose levels are nearest the decks' loudest
    bands, the first on a tie; an equalizer is relative to its deck, and at rest where the deck is all but silent."""
    loud = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.array_max(g))) for g in (gain_a, gain_b)]

    def missed(i: Column) -> Column:
        turn = i * (math.pi / 400)
        off = [F.least(F.lit(1.0), math.sqrt(2) * level) - x for level, x in zip((F.cos(turn), F.sin(turn)), loud)]
        return F.struct((off[0] * off[0] + off[1] * off[1]).alias("error"), (i / 200).alias("place"))

    fader = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(200)), missed))["place"]

    def equalizer(g: Column, top: Column) -> Column:
        db = lambda x: 20 * F.log10(F.least(F.lit(1.0), F.greatest(F.lit(1e-4), x / (top + 1e-6))))
        return F.transform(g, lambda x: F.when(top > 0.05, F.greatest(F.lit(-1.0), db(x) / 30)).otherwise(0.0))

    return F.concat(F.array(fader), equalizer(gain_a, loud[0]), equalizer(gain_b, loud[1]), F.array(F.lit(0.0), F.lit(0.0)))
