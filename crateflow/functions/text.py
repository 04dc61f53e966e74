"""Text normalization, parsing and hashing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks, and the letters without.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśšťūůűźżžș"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorsstuuuzzzs"
# Stroked letters are letters of their own and keep their stroke.
_FROM = MARKED.replace("ł", "")
_TO = "".join(p for m, p in zip(MARKED, PLAIN) if m != "ł")


def fold(s: Column) -> Column:
    """Lower case without marks; combining marks that stand alone go as well."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(s, F.lit(""))), _FROM, _TO), "[̀-ͯ]", "")


def normal(s: Column) -> Column:
    """Letters and digits of a title, single spaces between, & read as and."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(fold(s)), "&", " and "), "[^a-z0-9]+", " "))


def bare(s: Column) -> Column:
    """normal() without bracketed additions and guests."""
    s = F.regexp_replace(F.coalesce(s, F.lit("")), r"\s*[(\[].*?[)\]]", " ")
    return normal(F.regexp_replace(s, r"(?i)\s+(feat|ft|featuring)\.?\s+.*$", ""))


def base_name(path: Column) -> Column:
    """normal() of a path's last part without its extension."""
    return normal(F.regexp_replace(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^\\/]*)$", 1), r"\.[^.]+$", ""))


def clean(s: Column) -> Column:
    """Folded words with & and apostrophes kept."""
    s = F.regexp_replace(fold(s), "[’`]", "'")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9&' ]+", " "), r"\s+", " "))


def chat_normal(s: Column) -> Column:
    """Folded letters, every digit a 0, single spaces."""
    s = F.regexp_replace(F.regexp_replace(fold(s), "[0-9]", "0"), "[^a-z0 ]+", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def clauses(s: Column) -> Column:
    """Parts of a message, cut at punctuation and conjunctions."""
    parts = F.split(F.lower(F.coalesce(s, F.lit(""))), r"[,;.!?]+|\s+(?:e poi|e anche|poi|ma|e)\s+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def chat_features(s: Column, most: int = 512) -> Column:
    """Words, pieces of three to five letters with the words' edges, and pairs of words, the first `most` of them."""
    words = F.filter(F.split(chat_normal(s), " "), lambda w: w != "")

    def of_word(w: Column) -> Column:
        g = F.concat(F.lit("<"), w, F.lit(">"))

        def pieces(n: int) -> Column:
            each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(g) - n + 1)), lambda i: F.concat(F.lit("c:"), F.substring(g, i, F.lit(n))))
            return F.when(F.length(g) >= n, each).otherwise(F.array().cast("array<string>"))

        return F.concat(F.array(F.concat(F.lit("w:"), w)), pieces(3), pieces(4), pieces(5))

    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(F.lit("b:"), a, F.lit("_"), b))
    return F.slice(F.concat(F.flatten(F.transform(words, of_word)), pairs), 1, most)


def fnv1a(s: Column) -> Column:
    """FNV-1a over the characters' codes, 32 bits."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: h.bitwiseXOR(F.ascii(c)) * F.lit(16777619).cast("long") % F.lit(4294967296).cast("long"))


def seconds_of(s: Column) -> Column:
    """Seconds of m:ss, h:mm:ss or a number, with a comma or a point; null for anything else."""
    s = F.replace(F.trim(s), F.lit(","), F.lit("."))
    at = r"^(\d+):(\d{1,2}(?:\.\d+)?)(?::(\d{1,2}(?:\.\d+)?))?$"
    a, b, c = (F.expr("0") + F.nullif(F.regexp_extract(s, at, i), F.lit("")).cast("double") for i in (1, 2, 3))
    plain = F.when(s.rlike(r"^\d+(\.\d+)?$"), F.regexp_extract(s, r"^(\d+(\.\d+)?)$", 1))
    return F.when(plain.isNotNull(), plain.cast("double")).when(c.isNotNull(), a * 3600 + b * 60 + c).otherwise(a * 60 + b)


def clock(sec: Column) -> Column:
    """mm:ss of seconds, rounded down."""
    whole = F.floor(F.greatest(sec, F.lit(0.0))).cast("long")
    return F.concat(F.lpad(F.floor(whole / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def truth(s: Column) -> Column:
    """Yes and no in the words people use; null for anything else."""
    s = F.trim(fold(s))
    return F.when(s.isin("si", "true", "on", "1", "vero", "yes"), True).when(s.isin("no", "false", "off", "0", "falso"), False)


def label_parts(s: Column) -> tuple[Column, Column]:
    """Artist and title of 'artist - title' with any dash between spaces; without one, all is title."""
    at = r"^(.+?)\s+[-–—]\s+(.+)$"
    has = s.rlike(at)
    return F.when(has, F.trim(F.regexp_extract(s, at, 1))), F.when(has, F.trim(F.regexp_extract(s, at, 2))).otherwise(F.trim(s))


def version_key(s: Column, parts: int = 4) -> Column:
    """A version as numbers that compare: 1.10 after 1.9, missing parts are zero."""
    numbers = F.transform(F.split(F.coalesce(s, F.lit("")), r"[.\-]"), lambda p: F.coalesce(F.expr("0") + F.nullif(F.regexp_extract(p, r"^(\d{1,9})", 1), F.lit("")).cast("long"), F.lit(0).cast("long")))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), parts)), 1, parts)


def natural_key(s: Column) -> Column:
    """A key under which 'Track 2' sorts before 'Track 10': every run of digits padded."""
    padded = F.regexp_replace(fold(s), r"(\d+)", "000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{12})(?!\d)", "$1")
