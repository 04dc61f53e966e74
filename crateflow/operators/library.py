"""Searching, filtering, ranking and keeping a track library."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateflow.functions import music
from crateflow.functions.text import fold


@dataclass(frozen=True)
class Filters:
    """What a listener asks for; 0 and empty mean unset."""

    genres: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    bpm_min: float = 0
    bpm_max: float = 0

    def merged(self, genres=(), exclude=(), bpm_min=None, bpm_max=None, add=False, clear=False) -> Filters:
        """These filters changed: an exclusion takes a genre out, a wish takes an exclusion out, bounds are ordered."""
        if clear:
            return Filters()
        g, x = list(self.genres), list(self.exclude)
        if genres:
            g = list(dict.fromkeys([*g, *genres])) if add else list(genres)
            x = [e for e in x if e not in genres]
        if exclude:
            x = list(dict.fromkeys([*x, *exclude]))
            g = [e for e in g if e not in exclude]
        low = self.bpm_min if bpm_min is None else bpm_min
        high = self.bpm_max if bpm_max is None else bpm_max
        if low and high and low > high:
            low, high = high, low
        return Filters(tuple(g), tuple(x), low, high)

    def column(self, genre: Column, bpm: Column) -> Column:
        folded = fold(genre)

        def any_of(names: tuple[str, ...]) -> Column:
            return F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(folded, fold(n)))

        ok = F.lit(True)
        if self.genres:
            ok = ok & any_of(self.genres)
        if self.exclude:
            ok = ok & ~any_of(self.exclude)
        if self.bpm_min:
            ok = ok & F.coalesce(bpm >= self.bpm_min, F.lit(False))
        if self.bpm_max:
            ok = ok & F.coalesce(bpm <= self.bpm_max, F.lit(False))
        return ok


def search(tracks: DataFrame, text: str) -> DataFrame:
    """Rows that hold every word of the text in title, artist, genre, key, code or rounded tempo."""
    bpm = F.when(F.coalesce("bpm", F.lit(0.0)) > 0, F.floor(F.col("bpm") + 0.5).cast("string")).otherwise("")
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "artist", "genre", "key", "code")], bpm))
    words = [w for w in text.lower().split() if w]
    return tracks.where(F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(hay, w))) if words else tracks


def rank_candidates(tracks: DataFrame, current: DataFrame, limit: int, strategy: str = "steady", step: int = 0, filters: Filters = Filters()) -> DataFrame:
    """The best followers of the one track in `current`, with the reasons, which are made for these only."""
    cur = current.limit(1).select(*[F.col(c).alias(f"cur_{c}") for c in ("id", "bpm", "camelot_n", "camelot_l", "code", "energy", "genre", "artist")])
    names = ("bpm", "camelot_n", "camelot_l", "energy", "genre", "artist")
    # one row by the limit above
    pool = tracks.where(filters.column(F.col("genre"), F.col("bpm"))).crossJoin(F.broadcast(cur)).where("id <> cur_id")
    score = music.candidate_score({n: F.col(f"cur_{n}") for n in names}, {n: F.col(n) for n in names}, strategy, step)
    best = pool.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "id").limit(limit)
    ratio = music.tempo_ratio(F.col("cur_bpm"), F.col("bpm"))
    percent = F.round((ratio - 1) * 100, 1)
    reasons = F.concat_ws(
        "; ",
        F.when(ratio != 0, F.concat(F.lit("tempo "), F.floor(F.col("bpm") + 0.5).cast("string"), F.lit(" by "), percent.cast("decimal(6,1)").cast("string"), F.lit(" %"))),
        F.when(F.col("code").isNotNull(), F.concat(F.lit("key "), F.coalesce("cur_code", F.lit("?")), F.lit(" to "), F.col("code"))),
        F.when(F.coalesce("energy", F.lit(0)) > 0, F.concat(F.lit("energy "), F.coalesce(F.col("cur_energy").cast("string"), F.lit("?")), F.lit(" to "), F.col("energy").cast("string"))),
    )
    return best.select("id", "title", "artist", "score", reasons.alias("reasons"))


def widening_pool(tracks: DataFrame, ok: Column, recent: DataFrame, last_played: Column) -> DataFrame:
    """Rows of the first tier that has any: wanted and not recent, wanted and among the longer unplayed half, then all."""
    marked = tracks.join(recent.select(F.col("id").alias("_r")).distinct(), F.col("id") == F.col("_r"), "left").withColumn("_ok", ok)
    # the half is a rank among the wanted rows: a threshold of their order, not a sort of all rows in one task
    wanted = marked.where("_ok").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 2)).alias("_half"), F.sum(F.when(F.col("_r").isNull(), 1).otherwise(0)).alias("_fresh"), F.count("*").alias("_n"))
    oldest = Window.partitionBy("_ok").orderBy(F.asc_nulls_first(last_played), "id")
    # only where no wanted row is fresh does the rank matter; the wanted rows are then all recent ones, a bounded list
    ranked = marked.where(F.col("_ok") & F.col("_r").isNotNull()).withColumn("_rank", F.row_number().over(oldest)).select(F.col("id").alias("_i"), "_rank")
    joined = marked.crossJoin(F.broadcast(wanted)).join(ranked, F.col("id") == F.col("_i"), "left")
    tier = F.when(F.col("_n") == 0, 3).when(F.col("_fresh") > 0, F.when(F.col("_ok") & F.col("_r").isNull(), 1)).otherwise(F.when(F.col("_rank") <= F.col("_half"), 2))
    return joined.withColumn("tier", tier).where("tier IS NOT NULL").drop("_r", "_ok", "_half", "_fresh", "_n", "_i", "_rank")


def plays(history: DataFrame) -> DataFrame:
    """How often and when last each track was played."""
    return history.groupBy("id").agg(F.count("*").alias("play_count"), F.max("played_at").alias("last_played"))


def most_played(history: DataFrame, limit: int = 200) -> DataFrame:
    return plays(history).orderBy(F.desc("play_count"), "id").limit(limit)


def remove_tracks(playlists: DataFrame, mashups: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Playlists (rows playlist, pos, track) and mashups without the tracks of `gone`; positions close up."""
    dead = gone.select(F.col("id").alias("_gone")).distinct()
    left = playlists.join(dead, F.col("track") == F.col("_gone"), "left_anti")
    left = left.withColumn("pos", F.row_number().over(Window.partitionBy("playlist").orderBy("pos")))
    edges = mashups.join(dead, F.col("base") == F.col("_gone"), "left_anti").join(dead, F.col("vocal") == F.col("_gone"), "left_anti")
    return left, edges


def move_item(items: Column, source: int, target: int) -> Column:
    """An array with the item at `source` (from 0) moved to `target`; out of range, nothing moves."""
    n = F.size(items)
    item = F.slice(items, source + 1, 1)
    rest = F.concat(F.slice(items, 1, source), F.slice(items, source + 2, n))
    moved = F.concat(F.slice(rest, 1, target), item, F.slice(rest, target + 1, n))
    return F.when((n > source) & (n > target), moved).otherwise(items)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changes in place of rows of the same keys."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def insert_new(base: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """base and those rows of more whose key is new, the first of each."""
    first = more.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in more.columns if c != key]))).where("_n = 1").drop("_n")
    return base.unionByName(first.join(base.select(key), key, "left_anti"))


def patch(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the listed columns overwritten where a map `patch` of changes has them (a null value counts)."""
    joined = base.join(changes.select(F.col(key).alias("_k"), "patch"), F.col(key) == F.col("_k"), "left")
    out = [F.when(F.coalesce(F.map_contains_key("patch", F.lit(c)), F.lit(False)), F.try_element_at("patch", F.lit(c)).try_cast(t)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c, t in base.dtypes]
    return joined.select(*out)


def first_folder(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """Each path's folder: the first in order that is a parent of it. Joined on every parent of the path, not by pairs."""
    parts = F.split("path", "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = paths.select("id", "path", F.explode(parents).alias("folder"))
    hit = up.join(folders, "folder").groupBy("id").agg(F.min(F.struct("pos", "folder")).alias("f"))
    return paths.join(hit, "id", "left").select("id", "path", F.col("f.folder").alias("folder"))


def reconcile(store: DataFrame, found: DataFrame, offline: DataFrame) -> DataFrame:
    """A library after a rescan: rows of vanished files go unless their folder is offline; new files come in. A column
    `change` says which: kept, offline, removed or added."""
    both = store.select("id", "folder", F.lit(True).alias("_s")).join(found.select("id", F.col("folder").alias("_f"), F.lit(True).alias("_d")), "id", "full_outer")
    both = both.join(offline.select(F.col("folder").alias("_off")).distinct(), F.col("folder") == F.col("_off"), "left")
    change = F.when(F.col("_s").isNull(), "added").when(F.col("_d").isNotNull(), "kept").when(F.col("_off").isNotNull(), "offline").otherwise("removed")
    return both.select("id", F.coalesce("folder", "_f").alias("folder"), change.alias("change"))


@dataclass(frozen=True)
class Missing:
    """Which tracks need work: all of it, a better tempo, or nothing."""

    needed: tuple[str, ...] = field(default=("bpm", "key", "energy"))

    def column(self) -> Column:
        lacks = [F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "0.0") for c in self.needed]
        count = sum((F.when(x, 1).otherwise(0) for x in lacks), F.lit(0))
        return F.when(count == 0, "complete").when(count == len(lacks), "pending").otherwise("partial")
