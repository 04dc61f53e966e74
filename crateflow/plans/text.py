"""Queries: text normalization, parsing, features, and what messages ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow import adapters as A
from crateflow.functions import text as X
from crateflow.operators import requests as N
from crateflow.operators import setlists as L
from crateflow.plans import sqlparts as S
from crateflow.plans.core import query


@query("str_f01_fold", f"SELECT doc_id, md5({S.fold('text')}) AS folded FROM documents")
def str_f01(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents").select("doc_id", F.md5(X.fold(F.col("text")).cast("binary")).alias("folded"))


_TITLE = "p_name || CASE p_partkey % 5 WHEN 0 THEN ' (feat. ' || p_brand || ')' WHEN 1 THEN ' - Radio Edit' WHEN 2 THEN ' [Remastered 2011]' WHEN 3 THEN ' ft. ' || p_brand ELSE ' & Señorita -- Città_01 ' END"


@query("str_f02_normal_titles", f"SELECT id, {S.normal('t')} AS n, {S.bare('t')} AS b FROM (SELECT p_partkey AS id, {_TITLE} AS t FROM part)")
def str_f02(spark: SparkSession, sf: str) -> DataFrame:
    t = A.table(spark, sf, "part").selectExpr("p_partkey AS id", f"{_TITLE} AS t")
    return t.select("id", X.normal(F.col("t")).alias("n"), X.bare(F.col("t")).alias("b"))


@query("str_f03_page_titles", """SELECT page_id, trim(regexp_replace(regexp_replace(lower(regexp_extract(html, '<title>(.*?)</title>', 1)), '\\s*[(\\[](official|lyrics?|audio|video)[^)\\]]*[)\\]]|\\s*\\|.*$|\\s+\\(\\d\\)$', '', 'g'), '\\s+', ' ', 'g')) AS title FROM pages""")
def str_f03(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "pages").select("page_id", L.site_title(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"))


@query("str_f04_chat_normal", f"SELECT conv_id, turn, {S.chat_normal('text')} AS n FROM conversations WHERE role = 'user'")
def str_f04(spark: SparkSession, sf: str) -> DataFrame:
    return A.messages(spark, sf).select("conv_id", "turn", X.chat_normal(F.col("text")).alias("n"))


@query("str_f05_clauses", """SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(text), '[,;.!?]+|\\s+(?:e poi|e anche|poi|ma|e)\\s+'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> ''), '|') AS parts FROM conversations WHERE role = 'user'""")
def str_f05(spark: SparkSession, sf: str) -> DataFrame:
    return A.messages(spark, sf).select("conv_id", "turn", F.array_join(X.clauses(F.col("text")), "|").alias("parts"))


_G = "('<' || w || '>')"
_FEATURES = f"""m AS (SELECT conv_id, turn, string_split({S.chat_normal('text')}, ' ') AS ws FROM conversations WHERE role = 'user'),
f AS (SELECT conv_id, turn, list_concat(flatten(list_transform(list_filter(ws, lambda w: w <> ''), lambda w: list_concat(['w:' || w],
 list_transform(range(1, greatest(length(w) + 1, 1)), lambda i: 'c:' || substr({_G}, i, 3)), list_transform(range(1, greatest(length(w), 1)), lambda i: 'c:' || substr({_G}, i, 4)), list_transform(range(1, greatest(length(w) - 1, 1)), lambda i: 'c:' || substr({_G}, i, 5))))),
 list_transform(range(1, len(ws)), lambda i: 'b:' || ws[i] || '_' || ws[i + 1]))[1:512] AS fs FROM m)"""


@query("str_f06_features", f"WITH {_FEATURES} SELECT conv_id, turn, CAST(len(fs) AS INT) AS n, md5(array_to_string(fs, ' ')) AS digest FROM f")
def str_f06(spark: SparkSession, sf: str) -> DataFrame:
    f = A.messages(spark, sf).select("conv_id", "turn", F.explode(F.array(X.chat_features(F.col("text")))).alias("fs"))
    return f.select("conv_id", "turn", F.size("fs").alias("n"), F.md5(F.array_join("fs", " ").cast("binary")).alias("digest"))


@query("str_f07_hashed_features", f"WITH {_FEATURES}, x AS (SELECT conv_id, turn, unnest(fs) AS g FROM f) SELECT conv_id, turn, sum({S.fnv1a('g')} % 32768 + 1)::BIGINT AS total, max({S.fnv1a('g')} % 32768 + 1) AS top FROM x GROUP BY conv_id, turn")
def str_f07(spark: SparkSession, sf: str) -> DataFrame:
    g = A.messages(spark, sf).select("conv_id", "turn", F.explode(X.chat_features(F.col("text"))).alias("g"))
    bucket = X.fnv1a(F.col("g")) % 32768 + 1
    return g.groupBy("conv_id", "turn").agg(F.sum(bucket).alias("total"), F.max(bucket).alias("top"))


@query("str_f08_nearest_bars", "SELECT event_id, CAST(arg_min(c, abs(c - n) * 100 + o) AS INT) AS bars FROM (SELECT event_id, 1 + CAST(floor(value) AS BIGINT) % 99 AS n FROM events), (SELECT * FROM (VALUES (4, 0), (8, 1), (16, 2), (32, 3), (48, 4), (64, 5)) AS v(c, o)) GROUP BY event_id, n")
def str_f08(spark: SparkSession, sf: str) -> DataFrame:
    from crateflow.functions.music import nearest_choice

    n = (1 + F.floor("value") % 99).cast("int")
    return A.table(spark, sf, "events").select("event_id", nearest_choice(n).alias("bars"))


#: Phrases of types of part, longest first; a text is a type and another's words around them.
_VOCAB = ["economy anodized", "standard polished", "anodized steel", "polished brass", "plated copper", "burnished tin", "anodized", "polished", "economy", "copper", "steel", "brass"]
_PHRASE = "lower(p_type) || ', poi ' || CASE p_partkey % 3 WHEN 0 THEN 'Steel e copper' WHEN 1 THEN 'anodized steel!' ELSE 'niente' END"
_WORDS = "' ' || trim(regexp_replace(lower(t), '[^a-z]+', ' ', 'g')) || ' '"


@query("str_f09_genres_in_phrase", f"""SELECT id, ltrim(split_part(list_reduce(list_prepend({_WORDS} || '|', {_VOCAB}), lambda a, v: CASE WHEN contains(split_part(a, '|', 1), ' ' || v || ' ') THEN replace(split_part(a, '|', 1), ' ' || v || ' ', ' ') || '|' || split_part(a, '|', 2) || ',' || v ELSE a END), '|', 2), ',') AS found
FROM (SELECT p_partkey AS id, {_PHRASE} AS t FROM part)""")
def str_f09(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "part").selectExpr("p_partkey AS id", f"{_PHRASE} AS t")
    return p.select("id", F.array_join(N.phrases_found(F.col("t"), _VOCAB), ",").alias("found"))


#: A time as people write it, from an event's value: with minutes, with hours, plain, with a fraction, and words.
_S = "CAST(floor(value) AS BIGINT)"
_TIME = f"CASE event_id % 7 WHEN 0 THEN {_S} // 60 || ':' || lpad(CAST({_S} % 60 AS VARCHAR), 2, '0') WHEN 1 THEN '1:' || lpad(CAST({_S} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({_S} % 60 AS VARCHAR), 2, '0') WHEN 2 THEN ' ' || {_S} WHEN 3 THEN '0:' || lpad(CAST({_S} % 60 AS VARCHAR), 2, '0') || ',5' WHEN 4 THEN {_S} || '.25' WHEN 5 THEN 'fine' ELSE '1:2:3:' || {_S} END"


@query("str_f10_times", f"SELECT event_id, CASE event_id % 7 WHEN 0 THEN {_S} WHEN 1 THEN 3600 + {_S} WHEN 2 THEN {_S} WHEN 3 THEN {_S} % 60 + 0.5e0 WHEN 4 THEN {_S} + 0.25e0 END::DOUBLE AS s FROM events")
def str_f10(spark: SparkSession, sf: str) -> DataFrame:
    t = A.table(spark, sf, "events").selectExpr("event_id", f"{_TIME.replace('//', 'DIV').replace('VARCHAR', 'STRING')} AS t")
    return t.select("event_id", X.seconds_of(F.col("t")).alias("s"))


_CUE = f"CASE event_id % 5 WHEN 0 THEN '[' || lpad(CAST({_S} % 100 AS VARCHAR), 2, '0') || ']' WHEN 1 THEN '[' || lpad(CAST({_S} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({_S} % 60 AS VARCHAR), 2, '0') || ']' WHEN 2 THEN '[1:' || lpad(CAST({_S} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({_S} % 60 AS VARCHAR), 2, '0') || '] ' WHEN 3 THEN '[??]' ELSE CAST({_S} AS VARCHAR) END"


@query("str_f11_cue_stamps", f"SELECT event_id, round(CASE event_id % 5 WHEN 0 THEN {_S} % 100 WHEN 1 THEN {_S} / 60e0 WHEN 2 THEN 60 + {_S} / 60e0 END::DOUBLE, 9) AS m FROM events")
def str_f11(spark: SparkSession, sf: str) -> DataFrame:
    t = A.table(spark, sf, "events").selectExpr("event_id", f"{_CUE.replace('//', 'DIV').replace('VARCHAR', 'STRING')} AS t")
    return t.select("event_id", F.round(L.cue_minutes(F.col("t")), 9).alias("m"))


@query("str_f12_label_split", f"WITH {A.TRACKS_SQL} SELECT id, artist, title FROM tracks")
def str_f12(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tracks(spark, sf).select("id", F.concat("artist", F.when(F.col("id") % 2 == 0, " - ").otherwise(" – "), "title").alias("label"))
    artist, title = X.label_parts(F.col("label"))
    return t.select("id", artist.alias("artist"), title.alias("title"))


@query("str_f13_truth", "SELECT event_id, [true, true, false, NULL, true, false, NULL, true, false][event_id % 9 + 1] AS b FROM events")
def str_f13(spark: SparkSession, sf: str) -> DataFrame:
    """Settings as people write them; each event sets one."""
    words = F.array(*[F.lit(x) for x in ("Sì", "on", "NO", "forse", "1", " falso ", None, "VERO", "off")])
    return A.table(spark, sf, "events").select("event_id", X.truth(F.element_at(words, (F.col("event_id") % 9 + 1).cast("int"))).alias("b"))


_VERSIONS = "p_size % 3 || '.' || p_partkey % 13 AS a, (p_partkey % 7) % 3 || CASE WHEN p_size % 2 = 0 THEN '.' ELSE '-' END || p_size % 13 || '.' || p_partkey % 2 AS b"


@query("str_f14_versions", "SELECT p_partkey AS id, (p_size % 3, p_partkey % 13, 0) > ((p_partkey % 7) % 3, p_size % 13, p_partkey % 2) AS newer FROM part")
def str_f14(spark: SparkSession, sf: str) -> DataFrame:
    v = A.table(spark, sf, "part").selectExpr("p_partkey AS id", *_VERSIONS.split(", "))
    return v.select("id", (X.version_key(F.col("a")) > X.version_key(F.col("b"))).alias("newer"))


@query("str_f15_summary_lines", "SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda l: length(l) > 60)[1:8], lambda l: substr(l, 1, 20)), '|') AS lines FROM documents")
def str_f15(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents").select("doc_id", F.array_join(L.summary_lines(F.col("text"), 60, 8, 20), "|").alias("lines"))


@query("str_f15_release_notes", r"""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split('* **Fix** `' || doc_id || '` by @someone in https://example.org/1' || chr(10) || ' - Scarica il file .dmg' || chr(10) || replace(text, '. ', '.' || chr(10) || '* '), chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')),
lambda l: (starts_with(l, '* ') OR starts_with(l, '- ')) AND NOT regexp_matches(l, 'Installazione|scarica|xattr|chmod|clic destro|\.dmg|\.msi|AppImage', 'i'))[1:8], lambda l: regexp_replace(regexp_replace(regexp_replace(l, '^[*-]\s+', ''), '\s+by @\S+ in https://\S+$', ''), '\*\*|`', '', 'g')), '|') AS lines FROM documents""")
def str_f15_notes(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit("* **Fix** `"), "doc_id", F.lit("` by @someone in https://example.org/1\n - Scarica il file .dmg\n"), F.replace("text", F.lit(". "), F.lit(".\n* ")))
    return A.table(spark, sf, "documents").select("doc_id", F.array_join(L.release_notes(body), "|").alias("lines"))


_BEFORE, _BEHIND = ["", "", "please ", "ok, "], ["", "!", " thanks"]


def _draw_sql(k: int) -> str:
    return f"(('0x' || substr(md5(coalesce(text, '') || ':11:{k}'), 1, 7))::INT / 268435456e0)"


def _typo_sql(k: int, chance: float) -> str:
    """A step of noise as SQL: `noisy` of the relation before, changed where the draw says so."""
    return f"""(SELECT * EXCLUDE (noisy, words, long, place, word, j), CASE WHEN {_draw_sql(k)} < {chance} AND len(long) > 0 THEN array_to_string(list_transform(words, lambda w, i: CASE WHEN i <> place THEN w
 WHEN {_draw_sql(k + 3)} < 0.4e0 THEN word[:j] || word[j + 2] || word[j + 1] || word[j + 3:] WHEN {_draw_sql(k + 3)} < 0.7e0 THEN word[:j] || word[j + 2:] ELSE word[:j + 1] || word[j + 1:] END), ' ') ELSE noisy END AS noisy
 FROM (SELECT *, CAST(1 + floor({_draw_sql(k + 2)} * (length(word) - 2)) AS INT) AS j FROM (SELECT *, words[place] AS word FROM (SELECT *, long[CAST(floor({_draw_sql(k + 1)} * len(long)) AS INT) + 1] AS place FROM
 (SELECT *, list_filter(range(1, len(words) + 1), lambda i: length(words[i]) >= 5) AS long FROM (SELECT *, string_split(noisy, ' ') AS words FROM {{}}))))))"""


def _phrase_sql(options: list[str], k: int) -> str:
    return f"{options}[CAST(floor({_draw_sql(k)} * {len(options)}) AS INT) + 1]"


_NOISY_SQL = f"WITH {A.MESSAGES_SQL} SELECT conv_id, turn, noisy FROM " + _typo_sql(6, 0.05).format(_typo_sql(2, 0.15).format(f"(SELECT *, {_phrase_sql(_BEFORE, 0)} || text || {_phrase_sql(_BEHIND, 1)} AS noisy FROM messages)"))


@query("str_f16_noisy_messages", _NOISY_SQL)
def str_f16_noisy(spark: SparkSession, sf: str) -> DataFrame:
    return N.noisy(A.messages(spark, sf), "text", 11, _BEFORE, _BEHIND).select("conv_id", "turn", "noisy")


@query("str_f17_identifiers", f"WITH {A.TRACKS_SQL} SELECT id, sha256(title) AS sha, substr(sha1(title), 1, 8) AS short FROM tracks")
def str_f17(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("title").cast("binary")
    return A.tracks(spark, sf).select("id", F.sha2(t, 256).alias("sha"), F.substring(F.sha1(t), 1, 8).alias("short"))


#: A set-list of each playlist as people send them: prose around JSON with comments and commas too many, names of fields in two tongues.
_ENTRY = ["'{\"artista\": \"A' || track || '\", \"brano\": \"T' || pos || '\", \"at\": \"' || pos || ':30\", }'", "'{\"artist\": \"B' || track || '\", \"title\": \"\"}'", "'{\"title\": \"T' || pos || '\"}'"]
_ENTRY = f"CASE pos % 3 WHEN 0 THEN {_ENTRY[0]} WHEN 1 THEN {_ENTRY[1]} ELSE {_ENTRY[2]} END"


def _setlists(spark: SparkSession, sf: str) -> DataFrame:
    each = A.playlists(spark, sf).selectExpr("playlist", "pos", f"{_ENTRY} AS e").groupBy("playlist").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "e"))).getField("e"), ", // next\n ").alias("l"))
    fence = F.when(F.col("playlist") % 2 == 0, F.lit("```json\n")).otherwise(F.lit(""))
    end = F.when(F.col("playlist") % 2 == 0, F.lit("\n```\nEnjoy [it]")).otherwise(F.lit("\nEnjoy"))
    key = F.when(F.col("playlist") % 3 == 0, "brani").otherwise("tracks")
    return each.select("playlist", F.concat(F.lit("Here you go:\n"), fence, F.lit('{"titolo": "Set '), F.col("playlist").cast("string"), F.lit('", "'), key, F.lit('": ['), "l", F.lit("],}"), end).alias("t"))


@query("src19_extract_json", f"WITH {A.PLAYLISTS_SQL} SELECT playlist, 'Set ' || playlist AS title, CAST(count(*) AS INT) AS entries FROM playlists GROUP BY playlist")
def src19(spark: SparkSession, sf: str) -> DataFrame:
    v = _setlists(spark, sf).select("playlist", L.embedded_json(F.col("t")).alias("v"))
    lists = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "array<variant>") for k in ("brani", "tracks")])
    return v.select("playlist", F.try_variant_get("v", "$.titolo", "string").alias("title"), F.size(lists).alias("entries"))


@query("src20_parse_setlist", f"""WITH {A.PLAYLISTS_SQL} SELECT playlist, CAST(pos - 1 AS INT) AS pos, CASE pos % 3 WHEN 0 THEN 'A' || track WHEN 1 THEN 'B' || track END AS artist, CASE WHEN pos % 3 <> 1 THEN 'T' || pos END AS title,
CASE WHEN pos % 3 = 0 THEN pos * 60 + 30e0 END AS sec, CASE WHEN pos % 3 = 1 THEN 'no title' ELSE '' END AS warning FROM playlists""")
def src20(spark: SparkSession, sf: str) -> DataFrame:
    return L.entries(_setlists(spark, sf), "t", ("playlist",))


@query("src21_library_lines", f"WITH {A.KEYED_SQL} SELECT id, concat_ws(' | ', artist, title, genre, CASE WHEN bpm > 0 THEN CAST(CAST(bpm AS BIGINT) AS VARCHAR) END, code) AS line FROM keyed")
def src21(spark: SparkSession, sf: str) -> DataFrame:
    return A.keyed(spark, sf).select("id", F.concat_ws(" | ", "artist", "title", "genre", F.when(F.col("bpm") > 0, F.col("bpm").cast("bigint").cast("string")), "code").alias("line"))




@query("src22_tracklist", f"WITH {A.PLAYLISTS_SQL} SELECT 'f' || playlist % 50 AS file, 'k' || playlist AS key, CASE pos % 3 WHEN 0 THEN pos::DOUBLE WHEN 1 THEN pos + 0.5e0 END AS cue, 'A' || track || ' - T' || pos AS label FROM playlists")
def src22(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty files of tracklists, each with the headers and entries of its playlists in turn."""
    p = A.playlists(spark, sf).withColumn("file", F.concat(F.lit("f"), (F.col("playlist") % 50).cast("string")))
    stamp = F.when(F.col("pos") % 3 == 0, F.format_string("[%02d]", "pos")).when(F.col("pos") % 3 == 1, F.format_string("[%02d:30]", "pos")).otherwise("[??]")
    entry = p.select("file", (F.col("playlist") * 1000 + F.col("pos")).alias("n"), F.concat(stamp, F.lit(" | A"), F.col("track").cast("string"), F.lit(" - T"), F.col("pos").cast("string"), F.lit(" | 300 | u")).alias("line"))
    head = p.where("pos = 1").select("file", (F.col("playlist") * 1000).alias("n"), F.concat(F.lit("@ k"), F.col("playlist").cast("string"), F.lit("|Mix|p|src")).alias("line"))
    notes = p.where("pos = 2").select("file", (F.col("playlist") * 1000 + 500).alias("n"), F.lit("# comment").alias("line"))
    return L.tracklist(head.unionByName(entry).unionByName(notes)).select("file", "key", "cue", "label")


@query("src23_tag_prefixes", f"WITH {A.TRACKS_SQL} SELECT id, array_to_string(list_filter(['genre---' || lower(genre), 'mood---' || (id % 3), 'genre---all'], lambda t: starts_with(t, 'genre---')), ',') AS genres FROM tracks")
def src23(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.array(F.concat(F.lit("genre---"), F.lower("genre")), F.concat(F.lit("mood---"), (F.col("id") % 3).cast("string")), F.lit("genre---all"))
    return A.tracks(spark, sf).select("id", F.array_join(F.filter(tags, lambda t: F.startswith(t, F.lit("genre---"))), ",").alias("genres"))


@query("src24_last_wins", "SELECT user_id, event_type, arg_max(value, ts) AS value FROM events GROUP BY user_id, event_type")
def src24(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "ts").alias("value"))


_P = "(xor(conv_id * 7 + turn * 3 + h * 5 + c * 11 + i * 13, 42) % 100) / 100e0"


@query("nlu03_decide", f"""WITH g AS (SELECT conv_id, turn, h, c, i, {_P} AS p FROM (SELECT conv_id, turn FROM conversations WHERE role = 'user'), (SELECT range AS h FROM range(4)), (SELECT range AS c FROM range(3)), (SELECT range AS i FROM range(5))),
b AS (SELECT conv_id, turn, h, c, arg_max(i, p * 1000 - i) AS i, max(p) AS p FROM g GROUP BY 1, 2, 3, 4), k AS (SELECT conv_id, turn, h, arg_max(i, p * 1000 - c) AS ci, max(p) AS cp FROM b WHERE c > 0 AND i > 0 GROUP BY 1, 2, 3),
f AS (SELECT conv_id, turn, h, i AS fi, p AS fp FROM b WHERE c = 0)
SELECT f.conv_id, f.turn, CAST(f.h AS INT) AS head, CAST(CASE WHEN k.cp >= 0.9e0 THEN ci WHEN fi > 0 AND fp >= 0.8e0 THEN fi ELSE 0 END AS INT) AS label FROM f LEFT JOIN k ON f.conv_id = k.conv_id AND f.turn = k.turn AND f.h = k.h""")
def nlu03(spark: SparkSession, sf: str) -> DataFrame:
    grid = spark.range(4 * 3 * 5).selectExpr("CAST(id DIV 15 AS INT) AS head", "CAST(id DIV 5 % 3 AS INT) AS clause", "CAST(id % 5 AS INT) AS label")
    p = F.expr("((conv_id * 7 + turn * 3 + head * 5 + clause * 11 + label * 13) ^ 42) % 100 / 100D")
    scores = A.messages(spark, sf).select("conv_id", "turn").crossJoin(F.broadcast(grid)).withColumn("p", p)
    return N.decide(scores, ["conv_id", "turn"], 0.9, 0.8).select("conv_id", "turn", "head", "label")


@query("nlu04_linear_scores")
def nlu04(spark: SparkSession, sf: str) -> DataFrame:
    return N.linear_scores(A.messages(spark, sf), "text", heads=4, labels=5, seed=3)


@query("nlu07_corpus", f"""WITH c AS (SELECT conv_id, turn, {S.chat_normal('text')} AS k, (conv_id + turn) % 9 = 0 AS bad FROM conversations WHERE role = 'user') SELECT conv_id, turn FROM c WHERE NOT bad AND k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY conv_id, turn) = 1""")
def nlu07(spark: SparkSession, sf: str) -> DataFrame:
    c = A.messages(spark, sf).withColumn("k", X.chat_normal(F.col("text"))).where("(conv_id + turn) % 9 <> 0 AND k <> ''")
    return c.groupBy("k").agg(F.min(F.struct("conv_id", "turn")).alias("m")).select("m.conv_id", "m.turn")
