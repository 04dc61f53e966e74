"""Queries: what messages ask for, how rules and model go together, the state that actions lead to, answers about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow import adapters as A
from crateflow.operators import interpreter as I
from crateflow.operators import listener as Y
from crateflow.operators import requests as N
from crateflow.plans import sqlparts as S
from crateflow.plans.core import query

#: Requests that stand before the messages' own texts, one for each message in turn.
_ASKS = (
    "metti techno tra 120 e 128 bpm", "niente house per favore", "transizioni di 16 battute", "cambia il prossimo", "energia crescente, anzi rilassata", "Ciao!", "più di 130 bpm",
    "attiva il mashup", "crea una scaletta di 20 brani deep house in crescendo", "fammi un set di mezz'ora", "voce di Nova Reyes sulla base di Golden Hour", "fai un mashup", "fai dei mashup ogni tanto",
    "cosa sta suonando?", "perché questo?", "svuota la coda", "metti golden hour in coda", "per i prossimi tre brani solo trance", "togli tutti i filtri", "usa la playlist Sabato sera", "dissolvenze lunghe",
    "anche disco", "quindici battute", "fermati dopo questo", "mostrami la vista ai", "transizioni techno", "tech house e techno", "solo afro house e funk ma senza trance", "qualsiasi bpm", "intorno a 124 bpm",
    "da 140 a 90 bpm", "spegni il remix", "torna al bpm originale", "suona la coda", "togli Città di Vetro dalla coda", "per il prossimo brano tagli netti", "Grazie", "parte soft e poi esplode", "", "vista console",
)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _has(p: str, t: str = "t") -> str:
    return f"regexp_matches({t}, {_lit(p)})"


def _part(p: str, k: int = 1, t: str = "t") -> str:
    return f"nullif(trim(regexp_extract({t}, {_lit(p)}, {k})), '')"


def _first(table: tuple, t: str = "t") -> str:
    return "(CASE " + " ".join(f"WHEN {_has(p, t)} THEN {_lit(v)}" for v, p in table) + " END)"


def _last(table: tuple, t: str = "t") -> str:
    rows = ", ".join(f"{{'at': CASE WHEN {_has(p, t)} THEN length(regexp_extract({t}, {_lit(f'^(.*)(?:{p})')}, 1)) ELSE -1 END, 'i': -{i}, 'v': {_lit(v)}}}" for i, (v, p) in enumerate(table))
    return f"(list_sort(list_filter([{rows}], lambda x: x.at >= 0), 'DESC')[1].v)"


def _number(w: str) -> str:
    return f"(CASE WHEN regexp_matches({w}, '^\\d{{1,6}}$') THEN CAST({w} AS INT) " + " ".join(f"WHEN {w} = {_lit(k)} THEN {v}" for k, v in I.NUMBERS.items()) + " END)"


_G = "[" + ", ".join(map(_lit, I.GENRES)) + "]"


def _named(x: str) -> str:
    within = f"' ' || trim({x}) || ' '"
    return f"list_filter({_G}, lambda g: contains({within}, ' ' || g || ' ') AND len(list_filter({_G}, lambda h: length(h) > length(g) AND contains(' ' || h || ' ', ' ' || g || ' ') AND contains({within}, ' ' || h || ' '))) = 0)"


def _genres(p: str, end: str, t: str) -> str:
    spoken = f"list_filter(regexp_extract_all({t}, {_lit(p)}, 1), lambda x: NOT regexp_matches(x, {_lit(I.NOT_A_GENRE)}))"
    return f"list_sort(list_distinct(flatten(list_transform({spoken}, lambda x: {_named(f'regexp_split_to_array(x, {_lit(end)})[1]')}))))"


def _strategy(t: str) -> str:
    return f"(CASE WHEN {_has(I.SOFT_THEN_RISE, t)} THEN 'rise' ELSE {_last(I.STRATEGIES, t)} END)"


def _filters(t: str, before: str, name: str, named: bool) -> str:
    """CTEs that add the filters of a text to the rows of `before`."""
    low, high = (f"coalesce({_part(I.BPM_RANGE, k, t)}, {_part(I.BPM_FROM_TO, k, t)})::INT" for k in (1, 2))
    around = f"{_part(I.BPM_AROUND, 1, t)}::INT"
    inc = "list_filter(_in, lambda g: NOT list_contains(_ex, g))"
    if named:
        inc = f"CASE WHEN len({inc}) > 0 THEN {inc} ELSE list_sort(list_filter({_named(t)}, lambda g: NOT list_contains(_ex, g))) END"
    valid = "CASE WHEN {any} THEN 0 WHEN {x} BETWEEN 50 AND 220 THEN {x} END"
    return f"""{name}1 AS (SELECT *, coalesce({around} - 3, {_part(I.BPM_ABOVE, 1, t)}::INT, {low}) AS _lo, coalesce({around} + 3, {_part(I.BPM_BELOW, 1, t)}::INT, {high}) AS _hi, {_genres(I.EXCLUDE, I.EXCLUDE_END, t)} AS _ex, {_genres(I.INCLUDE, I.INCLUDE_END, t)} AS _in, {_genres(I.INCLUDE_MORE, I.INCLUDE_END, t)} AS _mo FROM {before}),
{name}2 AS (SELECT *, {valid.format(any=_has(I.BPM_ANY, t), x='_lo')} AS _f, {valid.format(any=_has(I.BPM_ANY, t), x='_hi')} AS _t, {inc} AS _inc FROM {name}1),
{name} AS (SELECT * EXCLUDE (_lo, _hi, _ex, _in, _mo, _f, _t, _inc), nullif(concat_ws(';', CASE WHEN len(_inc) > 0 AND NOT ({_has(I.TECHNO_STYLE, t)} AND _inc = ['techno']) THEN CASE WHEN len(list_filter(_mo, lambda g: NOT list_contains(_ex, g))) > 0 THEN 'add=' ELSE 'genres=' END || array_to_string(_inc, ',') END,
 CASE WHEN len(_ex) > 0 THEN 'exclude=' || array_to_string(_ex, ',') END, CASE WHEN _f IS NOT NULL OR _t IS NOT NULL THEN 'bpm=' || coalesce(CAST(CASE WHEN _f > _t AND _t > 0 THEN _t ELSE _f END AS VARCHAR), '') || '-' || coalesce(CAST(CASE WHEN _f > _t AND _t > 0 THEN _f ELSE _t END AS VARCHAR), '') END), '') AS {name}_v FROM {name}2)"""


def _one(kind: str, value: str) -> str:
    return f"{{'kind': '{kind}', 'value': {value}}}"


def _toggle(name: str, word: str) -> str:
    return f"(CASE WHEN {_has(I.TOGGLE_OFF + word)} THEN '{name}=off' WHEN {_has(f'{I.TOGGLE_ON}{word}|{word}{I.TOGGLE_SET}')} THEN '{name}=on' END)"


def _sql() -> str:
    asks = "[" + ", ".join(map(_lit, _ASKS)) + "]"
    text = f"{asks}[1 + (conv_id * 7 + turn) % {len(_ASKS)}] || CASE WHEN turn % 4 = 2 THEN ' ' || text ELSE '' END"
    start = f"WITH m AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace({S.fold(text)}, '[’`]', '''', 'g'), '\\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user'), s AS (SELECT *, regexp_extract(t, {_lit(I.SET)}, 1) AS rest FROM m)"
    told = f"~{_has(I.INFO_HELP)}".replace("~", "NOT ") + f" AND ({_has(I.QUESTION)} OR len(string_split(t, ' ')) <= 4)"
    infos = [f"CASE WHEN {_has(I.INFO_HELP)} THEN 'help' END"] + [f"CASE WHEN NOT ({told}) THEN NULL {x} END" for x in (
        f"WHEN {_has(I.INFO_NOW)} THEN 'now'", f"WHEN {_has(I.INFO_WHY)} THEN 'why' WHEN {_has(I.INFO_NEXT)} THEN 'next'", f"WHEN {_has(I.INFO_QUEUE)} THEN 'queue'", f"WHEN {_has(I.INFO_SETTINGS)} THEN 'settings'",
    )]
    pair = f"(CASE WHEN {_has(I.VOICE_ON_BASE)} THEN concat_ws(';', 'voice=' || {_part(I.VOICE_ON_BASE, 1)}, 'base=' || {_part(I.VOICE_ON_BASE, 2)}) WHEN {_has(I.BASE_WITH_VOICE)} THEN concat_ws(';', 'voice=' || {_part(I.BASE_WITH_VOICE, 2)}, 'base=' || {_part(I.BASE_WITH_VOICE, 1)}) END)"
    any_mashup = f"({pair} IS NULL AND {_has(I.ANY_MASHUP)})"
    often = f"({any_mashup} AND {_has(I.NOW_AND_THEN)})"
    bars = _number(f"regexp_extract(t, {_lit(I.BARS_ASKED)}, 1)")
    near = f"CAST(list_sort(list_transform([{', '.join(map(str, I.BARS))}], lambda b: {{'d': abs(b - {bars}), 'b': b}}))[1].b AS VARCHAR)"
    length = f"CASE WHEN {bars} IS NOT NULL AND NOT {_has(I.BARS_FOR_TRACKS)} THEN {near} ELSE {_first(I.MIX_LENGTHS)} END"
    style = f"CASE WHEN NOT {_has(I.CLEAR)} OR {_has(I.STYLE_AFTER_CLEAR)} THEN coalesce({_first(I.STYLES)}, CASE WHEN {_has(I.FILTER_STYLE, f"regexp_replace(t, {_lit(I.FILTER_OF_TRACKS)}, ' ', 'g')")} THEN 'filter' WHEN {_has(I.AUTO_STYLE)} THEN 'auto' END) END"
    options = [f"'strategy=' || {_strategy('t')}", f"'style=' || ({style})", f"'bars=' || ({length})", _toggle(*I.TOGGLES[0]), f"CASE WHEN {often} THEN 'mashup=on' WHEN {pair} IS NULL AND NOT {any_mashup} THEN {_toggle(*I.TOGGLES[1])} END"]
    options += [f"'returnTempo=' || {_first(I.RETURN_TEMPO)}", f"'mode=' || {_first(I.MODES)}", f"'source=' || coalesce({_part(I.PLAYLIST)}, CASE WHEN {_has(I.WHOLE_LIBRARY)} THEN 'library' END)"]
    queue = [f"CASE WHEN {_has(I.QUEUE_CLEAR)} THEN 'clear' END", f"CASE WHEN {_has(I.QUEUE_SHUFFLE)} THEN 'shuffle' END", f"'remove=' || {_part(I.QUEUE_REMOVE)}", f"'next=' || {_part(I.QUEUE_NEXT)}"]
    queue += [f"CASE WHEN {_part(I.QUEUE_REMOVE)} IS NULL AND {_part(I.QUEUE_NEXT)} IS NULL THEN 'add=' || {_part(I.QUEUE_ADD)} END"]
    rest = [_one("mashup", pair), _one("mashup", f"CASE WHEN {any_mashup} AND NOT {often} THEN 'auto' END"), _one("control", _first(I.CONTROLS)), _one("control", f"CASE WHEN {_has(I.MIX_NOW)} THEN 'mixNow' END"), _one("control", f"CASE WHEN {_has(I.SKIP)} THEN 'skip' END")]
    rest += [_one("view", _first(I.VIEWS)), _one("filters", f"CASE WHEN {_has(I.CLEAR)} THEN 'clear' END")]
    minutes = f"(CASE WHEN {_has(I.SET_HALF, 'rest')} THEN 30 WHEN {_has(I.SET_HOUR, 'rest')} THEN 60 ELSE coalesce({_number(f'regexp_extract(rest, {_lit(I.SET_HOURS)}, 1)')} * 60, {_number(f'regexp_extract(rest, {_lit(I.SET_MINUTES)}, 1)')}) END)"
    tracks = f"nullif({_number(f'regexp_extract(rest, {_lit(I.SET_TRACKS)}, 1)')}, 0)"
    asked = f"CASE WHEN {_has(I.SET)} THEN concat_ws(';', 'length=' || least(60, coalesce(CAST(CASE WHEN {minutes} IS NOT NULL THEN greatest(3, floor({minutes} / 3.5e0 + 0.5e0)) END AS INT), {tracks}, 15)), 'strategy=' || {_strategy('rest')}, wanted_v) END"
    count = f"CASE WHEN {_has(I.FOR_TRACKS)} THEN coalesce({_number(f'regexp_extract(t, {_lit(I.FOR_TRACKS)}, 1)')}, 1) WHEN {_has(I.FOR_ONE)} THEN 1 END"
    full = lambda xs: f"list_filter([{', '.join(xs)}], lambda a: a.value IS NOT NULL)"
    return f"""{start}, {_filters('t', 's', 'asks', False)}, {_filters('rest', 'asks', 'wanted', True)},
p AS (SELECT conv_id, turn, t, {full([_one('info', x) for x in infos])} AS told, {asked} AS a_set, {full([_one('option', x) for x in options] + [_one('filters', 'asks_v')])} AS lasting, {full(rest)} AS rest, {full([_one('queue', x) for x in queue])} AS q, {count} AS n_for, {_has(I.QUESTION)} AS asking, {full([_one('talk', f"CASE WHEN len(string_split(t, ' ')) <= 4 THEN {_first(I.SMALL_TALK)} END")])} AS talk FROM wanted),
a AS (SELECT *, CASE WHEN len(told) > 0 AND asking THEN told WHEN a_set IS NOT NULL THEN list_concat(told, [{_one('buildSet', 'a_set')}]) ELSE list_concat(told, list_concat(rest, list_concat(CASE WHEN n_for IS NULL THEN lasting ELSE list_transform(lasting, lambda x: {{'kind': 'temporary', 'value': least(20, n_for) || ':' || x.kind || ':' || x.value}}) END, q))) END AS al FROM p WHERE t <> ''),
acts AS (SELECT conv_id, turn, unnest(range(len(al))) AS n, unnest(al) AS x FROM (SELECT conv_id, turn, CASE WHEN len(al) > 0 THEN al ELSE talk END AS al FROM a))"""


_ACTIONS = _sql()


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    asks = F.array(*[F.lit(x) for x in _ASKS])
    text = F.concat(F.element_at(asks, ((F.col("conv_id") * 7 + F.col("turn")) % len(_ASKS) + 1).cast("int")), F.when(F.col("turn") % 4 == 2, F.concat(F.lit(" "), "text")).otherwise(""))
    return I.actions(A.messages(spark, sf).select("conv_id", "turn", text.alias("text")), "text").drop("text")


@query("nlu01_parse_messages", f"{_ACTIONS} SELECT conv_id, turn, CAST(n AS INT) AS n, x.kind AS kind, x.value AS value FROM acts")
def nlu01(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(spark, sf).select("conv_id", "turn", "n", "kind", "value")


@query("nlu01_library_actions")
def nlu01_library(spark: SparkSession, sf: str) -> DataFrame:
    """The listeners' messages, each before a request for a track of the library by its words, read with the library's genres
    and tracks: titles, artists and genres of `part`."""
    n = F.count("*").alias("_n")
    tracks = A.tracks(spark, sf).select("id", "title", "artist", "genre")
    verbs = ("metti", "suona", "aggiungi", "dopo questo metti", "solo")
    m = A.messages(spark, sf).crossJoin(F.broadcast(tracks.agg(n))).withColumn("_id", F.pmod(F.xxhash64("conv_id", "turn"), "_n") + 1)
    named = tracks.select(F.col("id").alias("_id"), "title", F.lower("genre").alias("_genre"))
    verb = F.element_at(F.array(*map(F.lit, verbs)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(verbs))) + 1).cast("int"))
    request = F.concat(verb, F.lit(" "), F.when(verb == "solo", F.col("_genre")).otherwise(F.col("title")), F.lit(", "), F.coalesce("text", F.lit("")))
    m = m.join(named, "_id").select("conv_id", "turn", request.alias("text"))
    return Y.library_actions(m, ["conv_id", "turn"], "text", tracks)


@query("nlu02_rules_over_model", f"""{_ACTIONS}, r AS (SELECT DISTINCT conv_id, turn, x.kind AS head FROM acts), g AS (SELECT conv_id, turn, h AS head FROM conversations, (SELECT unnest(['filters', 'option', 'control', 'talk']) AS h) WHERE role = 'user' AND (conv_id + turn + length(h)) % 3 = 0)
SELECT conv_id, turn, head, 'rule' AS label FROM r UNION ALL SELECT conv_id, turn, head, 'model' FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = g.conv_id AND r.turn = g.turn AND (r.head = g.head OR g.head = 'talk'))""")
def nlu02(spark: SparkSession, sf: str) -> DataFrame:
    """Rules first; a model's label counts for heads that no rule covers, and its small talk only if no rule says anything."""
    rules = _asked(spark, sf).select("conv_id", "turn", F.col("kind").alias("head")).distinct().withColumn("label", F.lit("rule"))
    heads = F.explode(F.array(*[F.lit(h) for h in ("filters", "option", "control", "talk")]))
    model = A.messages(spark, sf).select("conv_id", "turn", heads.alias("head"), F.lit("model").alias("label")).where("(conv_id + turn + length(head)) % 3 = 0")
    return N.with_precedence(rules, model, ["conv_id", "turn"], "talk")


@query("nlu09_apply_actions", """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE event_type WHEN 'view' THEN 'volume' WHEN 'purchase' THEN 'bars' WHEN 'click' THEN 'undo' ELSE 'style' END AS key, CASE WHEN event_id % 11 <> 0 THEN CAST(CAST(floor(value) AS INT) AS VARCHAR) END AS value FROM events),
s AS (SELECT user_id, n, CASE WHEN key <> 'undo' AND value IS NOT NULL THEN [{'k': key, 'v': value}] ELSE [] END AS st, CASE WHEN key <> 'undo' AND value IS NULL THEN 1 ELSE 0 END AS failed FROM e WHERE n = 1 UNION ALL
 SELECT e.user_id, e.n, CASE WHEN e.key = 'undo' THEN s.st[1 : greatest(len(s.st) - 1, 0)] WHEN e.value IS NULL THEN s.st ELSE list_append(s.st, {'k': e.key, 'v': e.value}) END, s.failed + CASE WHEN e.key <> 'undo' AND e.value IS NULL THEN 1 ELSE 0 END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1),
l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)
SELECT user_id, list_reverse(list_filter(st, lambda x: x.k = 'volume'))[1].v AS volume, list_reverse(list_filter(st, lambda x: x.k = 'bars'))[1].v AS bars, list_reverse(list_filter(st, lambda x: x.k = 'style'))[1].v AS style, CAST(len(st) AS INT) AS applied, CAST(failed AS INT) AS failed FROM l""")
def nlu09(spark: SparkSession, sf: str) -> DataFrame:
    key = "CASE event_type WHEN 'view' THEN 'volume' WHEN 'purchase' THEN 'bars' WHEN 'click' THEN 'undo' ELSE 'style' END AS key"
    e = A.table(spark, sf, "events").selectExpr("user_id", "event_id", key, "if(event_id % 11 <> 0, CAST(CAST(floor(value) AS INT) AS STRING), NULL) AS value")
    state = N.applied(e, "user_id", "event_id")
    return state.select("user_id", *[F.try_element_at("state", F.lit(k)).alias(k) for k in ("volume", "bars", "style")], "applied", "failed")


@query("nlu10_state_answers", f"""WITH {A.KEYED_SQL}, {A.PLAYLISTS_SQL}, c AS (SELECT playlist, max(pos) AS n, 1 + playlist % max(pos) AS at FROM playlists GROUP BY playlist),
q AS (SELECT c.playlist, c.n - c.at AS left_over, t.title AS now, u.title AS nxt, t.code AS c1, u.code AS c2, t.bpm AS b1, u.bpm AS b2 FROM c JOIN playlists p ON p.playlist = c.playlist AND p.pos = c.at JOIN keyed t ON t.id = p.track LEFT JOIN playlists o ON o.playlist = c.playlist AND o.pos = c.at + 1 LEFT JOIN keyed u ON u.id = o.track)
SELECT playlist, what, CASE what WHEN 'now' THEN 'now ' || now WHEN 'next' THEN coalesce('next ' || nxt, 'the queue is empty') WHEN 'queue' THEN left_over || ' in the queue' ELSE coalesce('because ' || nullif(concat_ws(' and ', CASE WHEN c1 = c2 THEN 'key ' || c2 END, CASE WHEN b1 > 0 AND b2 > 0 AND abs(b1 - b2) / b1 < 0.06e0 THEN 'tempo' END), ''), 'no reason') END AS answer FROM q, (SELECT unnest(['now', 'next', 'queue', 'why']) AS what)""")
def nlu10(spark: SparkSession, sf: str) -> DataFrame:
    """What is on, what is next, how much is queued and why the next was chosen, for every playlist at a place of it."""
    p, t = A.playlists(spark, sf), A.keyed(spark, sf).select("id", "title", "code", "bpm")
    n = F.max("pos")
    c = p.groupBy("playlist").agg(n.alias("n")).withColumn("at", F.col("playlist") % F.col("n") + 1)
    j = p.join(c, "playlist").where("pos = at OR pos = at + 1").join(t, F.col("track") == F.col("id"))
    one = [F.max(F.when(F.col("pos") == F.col("at") + k, F.struct("title", "code", "bpm"))).alias(x) for k, x in ((0, "a"), (1, "b"))]
    q = j.groupBy("playlist", "n", "at").agg(*one)
    fits = F.concat_ws(" and ", F.when(F.col("a.code") == F.col("b.code"), F.concat(F.lit("key "), "b.code")), F.when((F.col("a.bpm") > 0) & (F.col("b.bpm") > 0) & (F.abs(F.col("a.bpm") - F.col("b.bpm")) / F.nullif("a.bpm", F.lit(0.0)) < 0.06), "tempo"))
    answers = {
        "now": F.concat(F.lit("now "), "a.title"), "next": F.coalesce(F.concat(F.lit("next "), "b.title"), F.lit("the queue is empty")),
        "queue": F.concat((F.col("n") - F.col("at")).cast("string"), F.lit(" in the queue")), "why": F.coalesce(F.concat(F.lit("because "), F.nullif(fits, F.lit(""))), F.lit("no reason")),
    }
    return q.select("playlist", F.explode(F.map_from_arrays(F.array(*map(F.lit, answers)), F.array(*answers.values()))).alias("what", "answer"))
