"""DuckDB expressions that the oracles share."""

from __future__ import annotations


def ratio(a: str, b: str) -> str:
    r = f"({a} / nullif({b}, 0e0))"
    return (
        f"(CASE WHEN coalesce({a}, 0e0) = 0 OR coalesce({b}, 0e0) = 0 THEN 0e0 "
        f"WHEN {r} > 1.5e0 THEN {r} / pow(2e0, ceil(log2({r} / 1.5e0))) "
        f"WHEN {r} < 0.67e0 THEN {r} * pow(2e0, ceil(log2(0.67e0 / {r}))) ELSE {r} END)"
    )


def bpm_score(a: str, b: str) -> str:
    d = f"(abs({ratio(a, b)} - 1e0) * 100e0)"
    return (
        f"(CASE WHEN {ratio(a, b)} = 0 THEN 0.35e0 WHEN {d} <= 1 THEN 1e0 WHEN {d} <= 3 THEN 0.9e0 - ({d} - 1) * 0.05e0 "
        f"WHEN {d} <= 6 THEN 0.8e0 - ({d} - 3) * 0.12e0 WHEN {d} <= 10 THEN 0.44e0 - ({d} - 6) * 0.1e0 ELSE 0e0 END)"
    )


def key_score(na: str, la: str, nb: str, lb: str) -> str:
    d = f"least(abs({na} - {nb}), 12 - abs({na} - {nb}))"
    return (
        f"(CASE WHEN {na} IS NULL OR {nb} IS NULL THEN 0.4e0 WHEN {na} = {nb} AND {la} = {lb} THEN 1e0 WHEN {na} = {nb} THEN 0.9e0 "
        f"WHEN {la} = {lb} AND {d} = 1 THEN 0.9e0 WHEN {la} = {lb} AND {d} = 2 THEN 0.55e0 WHEN {la} <> {lb} AND {d} = 1 THEN 0.45e0 "
        f"WHEN {la} = {lb} AND ({nb} - {na} + 12) % 12 = 7 THEN 0.5e0 ELSE 0.1e0 END)"
    )


def energy_score(e: str, want: str) -> str:
    return f"(CASE WHEN coalesce({e}, 0) = 0 THEN 0.5e0 ELSE 1e0 - least(1e0, abs({e} - {want}) / 5e0) END)"


def genre_words(g: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({g}), '[,/;&]+|\\s+'), lambda w: length(w) > 2)"


def genre_similarity(a: str, b: str) -> str:
    return (
        f"(CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.5e0 WHEN len({genre_words(a)}) = 0 OR len({genre_words(b)}) = 0 THEN 0.5e0 "
        f"WHEN list_has_any({genre_words(a)}, {genre_words(b)}) THEN 1e0 ELSE 0.2e0 END)"
    )


def score(c: str, t: str, want: str | None = None) -> str:
    want = want or f"coalesce(nullif({c}.energy, 0), 6)"
    return (
        f"(0.34e0 * {bpm_score(f'{c}.bpm', f'{t}.bpm')} + 0.3e0 * {key_score(f'{c}.camelot_n', f'{c}.camelot_l', f'{t}.camelot_n', f'{t}.camelot_l')} "
        f"+ 0.22e0 * {energy_score(f'{t}.energy', want)} + 0.09e0 * {genre_similarity(f'{c}.genre', f'{t}.genre')} "
        f"- CASE WHEN {c}.artist = {t}.artist THEN 0.08e0 ELSE 0e0 END)"
    )


def fold(s: str) -> str:
    return f"strip_accents(lower(coalesce({s}, '')))"


def normal(s: str) -> str:
    return f"trim(regexp_replace(regexp_replace(trim({fold(s)}), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def bare(s: str) -> str:
    cut = f"regexp_replace(coalesce({s}, ''), '\\s*[(\\[].*?[)\\]]', ' ', 'g')"
    return normal(f"regexp_replace({cut}, '(?i)\\s+(feat|ft|featuring)\\.?\\s+.*$', '', 'g')")


def chat_normal(s: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({fold(s)}, '[0-9]', '0', 'g'), '[^a-z0 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def fnv1a(s: str) -> str:
    # characters' codes one after another; 32 bits at each step
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({s}, ''), lambda x: ord(x)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


def ease(p: str) -> str:
    return f"(0.5e0 - 0.5e0 * cos(3.141592653589793e0 * greatest(0e0, least(1e0, {p}))))"
