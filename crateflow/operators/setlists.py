"""Set-lists and tracklists written by people: finding the JSON, reading entries, carrying headers forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateflow.functions.text import seconds_of

# The names that people give the fields.
ALIASES = {"entries": ("tracks", "brani", "songs", "scaletta", "setlist"), "artist": ("artist", "artista"), "title": ("title", "titolo", "brano", "name"), "sec": ("at", "start", "cue", "inizio")}


def embedded_json(text: Column) -> Column:
    """The JSON in a text as a variant: in a code fence, else from the first bracket to the last; comments and
    trailing commas are left out. Null where nothing parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)([{\[].*[}\]])", 1))
    body = F.regexp_replace(body, r"(?m)(^|[\s,{}\[\]])//[^\n]*", "$1")
    return F.try_parse_json(F.regexp_replace(body, r",(\s*[}\]])", "$1"))


def _alias(e: Column, field: str) -> Column:
    return F.coalesce(*[F.nullif(e[name], F.lit("")) for name in ALIASES[field]])


def entries(texts: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pos, artist, title, sec, warning) of every entry of the set-lists in a text column. All names of an entry's
    fields are read from the variant at once, as strings; an entry that is no object has none of them."""
    v = texts.select(*keys, embedded_json(F.col(column)).alias("v"))
    kind = ", ".join(f"{name}: string" for field in ("artist", "title", "sec") for name in ALIASES[field])
    lists = F.coalesce(*[F.try_variant_get("v", f"$.{name}", f"array<struct<{kind}>>") for name in ALIASES["entries"]])
    e = v.select(*keys, F.posexplode(lists).alias("pos", "e"))
    title = _alias(F.col("e"), "title")
    return e.select(*keys, "pos", _alias(F.col("e"), "artist").alias("artist"), title.alias("title"), seconds_of(_alias(F.col("e"), "sec")).alias("sec"), F.when(title.isNull(), "no title").otherwise("").alias("warning"))


def cue_minutes(s: Column) -> Column:
    """Minutes of [MM], [MM:SS] or [H:MM:SS]; null for anything else."""
    at = r"^\[(\d+)(?::(\d{2}))?(?::(\d{2}))?\]$"
    a, b, c = (F.nullif(F.regexp_extract(F.trim(s), at, i), F.lit("")).cast("double") for i in (1, 2, 3))
    return F.when(c.isNotNull(), a * 60 + b + c / 60).when(b.isNotNull(), a + b / 60).otherwise(a)


def tracklist(lines: DataFrame) -> DataFrame:
    """Rows (file, n, line) of tracklist files as (file, n, key, cue, label): each takes the last header above it."""
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.startswith("line", F.lit("@")), F.trim(F.split_part(F.substring("line", 2, 1 << 30), F.lit("|"), F.lit(1))))
    marked = lines.withColumn("key", F.last(header, ignorenulls=True).over(w))
    rows = marked.where(~F.col("line").rlike(r"^\s*(#|@|$)"))
    return rows.select("file", "n", "key", cue_minutes(F.split_part("line", F.lit("|"), F.lit(1))).alias("cue"), F.trim(F.split_part("line", F.lit("|"), F.lit(2))).alias("label"))


def site_title(s: Column) -> Column:
    """A page's title without what sites add: bracketed format notes, the part behind a bar, copy numbers."""
    junk = r"\s*[(\[](official|lyrics?|audio|video)[^)\]]*[)\]]|\s*\|.*$|\s+\(\d\)$"
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), junk, ""), r"\s+", " "))


def summary_lines(s: Column, least: int, most: int, width: int) -> Column:
    """The first `most` lines longer than `least`, cut to `width`."""
    return F.transform(F.slice(F.filter(F.split(s, "\n"), lambda x: F.length(x) > least), 1, most), lambda x: F.substring(x, 1, width))


# fixed values: lines of release notes that tell how to install
INSTALL = r"(?i)Installazione|scarica|xattr|chmod|clic destro|\.dmg|\.msi|AppImage"


def release_notes(body: Column, most: int = 8) -> Column:
    """The first `most` bullets of release notes, as an array: without lines on installing, authors' links, stars and ticks.
    Null gives null, a text without bullets an empty array."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    bullets = F.filter(lines, lambda x: (x.startswith("* ") | x.startswith("- ")) & ~x.rlike(INSTALL))
    plain = F.transform(bullets, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^[*-]\s+", ""), r"\s+by @\S+ in https://\S+$", ""), r"\*\*|`", ""))
    return F.slice(plain, 1, most)
