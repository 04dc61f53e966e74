"""Requests read with the library: genres from its vocabulary, tracks found by their words.

The vocabulary and the titles are tables. A message's runs of words are joined with them, so a message meets the phrases it holds
and no others; the longest are taken first, and what one has used is not found again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateflow.functions.text import clean
from crateflow.operators import interpreter as I
from crateflow.operators.matching import query_score

# Words that are no genre by themselves, and how listeners name tracks, in their language without marks.
NO_GENRE = ("and", "the", "mix", "music", "musica", "edit", "remix", "version", "original", "club", "radio", "various", "other", "altro")
NEXT = (
    r"(?:metti|suona|fai partire|voglio sentire|mettimi|mettici)? ?(.+?) (?:come prossimo|come prossima|subito dopo|per prossimo|dopo questo|dopo questa)\b",
    r"(?:dopo (?:questo|questa)|come prossimo|il prossimo)[, ]+(?:metti|suona|fai partire|voglio)?(?: sentire)? ?(.+)",
)
NEXT_VERB = r"^(metti|suona|fai partire|mettimi|mettici) "
ADD = r"\b(?:metti|mettimi|mettici|aggiungi|accoda|suona|suonami|voglio sentire|fammi sentire|fai sentire)\s+(?:anche\s+)?(.+?)(?= in coda| alla coda| e poi |,|;|$)"
LEADING = r"^(qualcosa|un pezzo|un brano|una canzone|un po') (di|dei|degli) "
ARTICLE, POLITE = r"^(il|lo|la|i|gli|le|l') ", r" (per favore|grazie|pls)$"
MOST_NOTED = 6


def genre_vocabulary(tracks: DataFrame) -> DataFrame:
    """(phrase): the usual genres, the library's, and the words of those, of three letters or more."""
    own = tracks.where("genre IS NOT NULL").select(F.explode(F.split("genre", "[,/;]+")).alias("g")).select(clean(F.col("g")).alias("phrase")).distinct()
    words = own.select(F.explode(F.split("phrase", " ")).alias("phrase")).where(~F.col("phrase").isin(*NO_GENRE))
    usual = tracks.sparkSession.createDataFrame([(g,) for g in I.GENRES], "phrase string")
    return usual.unionByName(own.unionByName(words).where("length(phrase) >= 3")).distinct()


def runs(words: Column, sizes: Column) -> Column:
    """All runs of words that are as long as one of the sizes."""
    some = F.filter(sizes, lambda n: n <= F.size(words))
    each = F.transform(some, lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")))
    return F.array_distinct(F.flatten(each))


def _sizes(phrases: DataFrame, name: str) -> DataFrame:
    """How many words the phrases have: one row, a number for each length that occurs."""
    return phrases.agg(F.collect_set(F.size(F.split(name, " "))).alias("sizes"))


def with_phrases(messages: DataFrame, keys: list[str], column: str, vocabulary: DataFrame, name: str) -> DataFrame:
    """messages with the vocabulary's phrases (phrase) that a text holds as whole words, as an array."""
    words = messages.select(*keys, F.split(clean(F.col(column)), " ").alias("_w")).crossJoin(F.broadcast(_sizes(vocabulary, "phrase")))
    held = words.select(*keys, F.explode(runs(F.col("_w"), F.col("sizes"))).alias("phrase")).join(vocabulary, "phrase")
    held = held.groupBy(*keys).agg(F.array_sort(F.collect_set("phrase")).alias(name))
    return messages.join(held, keys, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def tracks_meant(phrases: DataFrame, tracks: DataFrame) -> DataFrame:
    """(q, id): the track that each distinct phrase means, by the ladder of matching.query_score: the best score, then the shorter
    title, then the smaller id. Only tracks whose title or artist is in the phrase, or in whose title the phrase is, as whole
    words, are looked at: they are joined by those words. Phrases that mean none are left out."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(clean(F.col("q")), LEADING, ""), ARTICLE, ""), POLITE, "")
    q = phrases.select("q", F.trim(bare).alias("t")).where("length(t) >= 2").withColumn("w", F.split("t", " "))
    # tracks of one title and artist are one, by the smallest id, whatever the size of the library
    t = tracks.select("id", clean(F.col("title")).alias("title"), clean(F.col("artist")).alias("artist")).groupBy("title", "artist").agg(F.min("id").alias("id"))
    t = t.withColumn("w", F.split("title", " "))
    names = t.select("id", F.explode(F.array("title", "artist")).alias("key"))
    both = t.select("id", F.explode(F.array(F.concat_ws(" ", "artist", "title"), F.concat_ws(" ", "title", "artist"))).alias("key"))
    inside = t.crossJoin(F.broadcast(_sizes(q, "t"))).select("id", F.explode(runs(F.col("w"), F.col("sizes"))).alias("key"))
    spans = q.crossJoin(F.broadcast(_sizes(names.where("key <> ''"), "key"))).select("q", F.explode(runs(F.col("w"), F.col("sizes"))).alias("key"))
    met = q.select("q", F.col("t").alias("key")).join(both.unionByName(inside), "key").select("q", "id")
    met = met.unionByName(spans.join(names.where("key <> ''"), "key").select("q", "id")).distinct()
    scored = met.join(q.select("q", "t"), "q").join(t.select("id", "title", "artist"), "id")
    scored = scored.withColumn("score", query_score(F.col("t"), F.col("title"), F.col("artist"))).where("score > 0")
    best = F.min(F.struct((-F.col("score")).alias("s"), F.length("title").alias("l"), "id"))
    return scored.groupBy("q").agg(best.alias("b")).select("q", "b.id")


def library_actions(messages: DataFrame, keys: list[str], column: str, tracks: DataFrame) -> DataFrame:
    """(keys, n, kind, value) of what each message asks for, in order, with genres and tracks of the library.

    As interpreter.actions, but genres are those of genre_vocabulary, and tracks (id, title, artist, genre) are named by id: queue
    add=, next= and remove=, mashup voice=;base=. What follows a verb is added if it means a track; a track that comes next is not
    added too. note tells words that mean none: of a removal or a mashup, and of an addition in a message that asks nothing
    else, if they are six at most and name no genre. keys name a message.
    """
    m = with_phrases(messages, keys, column, genre_vocabulary(tracks), "_voc")
    told = I.actions(m, column, F.col("_voc")).select(*keys, "n", "kind", "value")
    of_words = ((F.col("kind") == "queue") & F.col("value").rlike("^(add|next|remove)=")) | ((F.col("kind") == "mashup") & (F.col("value") != "auto"))
    done = told.where(~of_words)
    t = m.select(*keys, "_voc", I.read(F.col(column)).alias("t"))
    closed = told.where("kind IN ('info', 'buildSet')").groupBy(*keys).agg(F.bool_or(F.col("kind") == "buildSet").alias("a_set"))
    t = t.join(closed, keys, "left").where((F.col("t") != "") & (F.col("a_set").isNull() | (~F.col("a_set") & ~F.col("t").rlike(I.QUESTION)))).drop("a_set")
    first = [F.nullif(F.regexp_extract("t", p, 1), F.lit("")) for p in NEXT]
    follows = F.regexp_replace(F.coalesce(*first), NEXT_VERB, "")
    is_option = lambda x: F.regexp_like(x, F.lit(I.NOT_A_GENRE))
    removed = F.nullif(F.regexp_extract("t", I.QUEUE_REMOVE, 1), F.lit(""))
    added = F.when(removed.isNull(), F.filter(F.regexp_extract_all(F.col("t"), F.lit(ADD), F.lit(1)), lambda x: ~is_option(x)))
    voice, base = (F.coalesce(*[F.nullif(F.regexp_extract("t", p, k), F.lit("")) for p, k in pairs]) for pairs in (((I.VOICE_ON_BASE, 1), (I.BASE_WITH_VOICE, 2)), ((I.VOICE_ON_BASE, 2), (I.BASE_WITH_VOICE, 1))))
    wish = lambda slot, x: F.when(x.isNotNull(), F.struct(F.lit(slot).alias("slot"), x.alias("q")))
    one = F.array_compact(F.array(wish("voice", voice), wish("base", base), wish("remove", removed), wish("next", F.when(~is_option(follows), follows))))
    every = F.concat(one, F.transform(F.coalesce(added, F.array().cast("array<string>")), lambda x: F.struct(F.lit("add").alias("slot"), x.alias("q"))))
    wishes = t.select(*keys, "_voc", F.posexplode(every).alias("at", "w")).select(*keys, "_voc", "at", "w.slot", "w.q")
    meant = tracks_meant(wishes.select("q").distinct(), tracks)
    found = wishes.join(meant, "q", "left")
    here = Window.partitionBy(*keys)
    next_found = F.max(F.when(F.col("slot") == "next", F.col("id")).isNotNull()).over(here)
    ids = {s: F.max(F.when(F.col("slot") == s, F.col("id"))).over(here) for s in ("voice", "base")}
    asked = done.where("kind <> 'talk'").select(*keys).distinct().withColumn("_asked", F.lit(True))
    found = found.withColumn("next_found", next_found).withColumn("voice_id", ids["voice"]).withColumn("base_id", ids["base"]).join(asked, keys, "left")
    ok, slot = F.col("id").isNotNull(), F.col("slot")
    pair = F.col("voice_id").isNotNull() & F.col("base_id").isNotNull() & (F.col("voice_id") != F.col("base_id"))
    names_genre = F.exists("_voc", lambda g: F.contains(F.concat(F.lit(" "), clean(F.col("q")), F.lit(" ")), F.concat(F.lit(" "), g, F.lit(" "))))
    noted = F.col("_asked").isNull() & (F.size(F.split("q", " ")) <= MOST_NOTED) & ~names_genre
    act = lambda kind, *parts: F.struct(F.lit(kind).alias("kind"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("value"))
    own, words = F.col("id").cast("string"), act("note", F.col("q"))
    action = (
        F.when((slot == "voice") & pair, act("mashup", "voice=", F.col("voice_id").cast("string"), ";base=", F.col("base_id").cast("string")))
        .when(slot.isin("voice", "base") & ~ok, words)
        .when(slot == "remove", F.when(ok, act("queue", "remove=", own)).otherwise(words))
        .when((slot == "next") & ok, act("queue", "next=", own))
        .when((slot == "add") & ~F.col("next_found"), F.when(ok, act("queue", "add=", own)).when(noted, words))
    )
    named = found.select(*keys, "at", action.alias("a")).where("a IS NOT NULL").select(*keys, (F.col("at") + 1000).alias("n"), "a.kind", "a.value").dropDuplicates([*keys, "kind", "value"])
    acts = named.where("kind <> 'note'").select(*keys).distinct()
    silent = done.where("kind = 'talk'").join(acts, keys, "left_anti")
    whole = done.where("kind <> 'talk'").unionByName(silent).unionByName(named)
    return whole.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("n", "kind", "value")) - 1)
