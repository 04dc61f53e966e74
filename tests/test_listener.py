from crateflow.operators import listener

TRACKS = [
    ("gh", "Nova Reyes", "Golden Hour", "Nu Disco"), ("gc", "Kaito Mori", "Glass City", "Tech House"), ("nd", "Jonah Wilde", "Night Drive", "Melodic Techno"),
    ("nl", "Aurelia Vance", "Northern Lights", "Deep House"), ("pa", "Silas Hart", "Parallel", "Progressive House"), ("wh", "DJ Test", "Warehouse", "Techno"), ("ps", "Band", "Psychedelic Song", "Psytrance/Goa Trance"),
]

#: What listeners say and what that asks for, written by hand.
SAID = {
    "metti Golden Hour come prossimo": [("queue", "next=gh")],
    "golden hour come prossimo": [("queue", "next=gh")],
    "dopo questo metti glass city": [("queue", "next=gc")],
    "aggiungi Night Drive": [("queue", "add=nd")],
    "metti golden hour": [("queue", "add=gh")],
    "suona nova reyes": [("queue", "add=gh")],
    "suona qualcosa di Nova Reyes": [("queue", "add=gh")],
    "metti golden hour di nova reyes, e poi suona glass city in coda": [("queue", "add=gh"), ("queue", "add=gc")],
    "togli parallel dalla coda": [("queue", "remove=pa")],
    "togli zzz dalla coda": [("note", "zzz")],
    "svuota la coda": [("queue", "clear")],
    "metti Pippo Baudo": [("note", "pippo baudo")],
    "suona trap e dubstep": [("filters", "genres=dubstep,trap")],
    "solo minimal": [("filters", "genres=minimal")],
    "solo psytrance": [("filters", "genres=psytrance")],
    "niente rock": [("filters", "exclude=rock")],
    "basta techno, voglio deep house": [("filters", "genres=deep house;exclude=techno")],
    "suona techno tra 124 e 130 bpm": [("filters", "genres=techno;bpm=124-130")],
    "filtro dei generi": [],
    "transizioni con il filtro": [("option", "style=filter")],
    "mettilo con filtro adesso ora": [("option", "style=filter")],
    "crea una scaletta di 20 brani hardstyle": [("buildSet", "length=20;genres=hardstyle")],
    "voce di golden hour sulla base di glass city": [("mashup", "voice=gh;base=gc")],
    "voce di golden hour sulla base di zzz": [("note", "zzz")],
    "grazie": [("talk", "thanks")],
    "": [],
    None: [],
}


def test_messages_with_a_library(spark):
    rows = list(enumerate(SAID))
    got = {i: [] for i, _ in rows}
    df = listener.library_actions(spark.createDataFrame(rows, "i int, text string"), ["i"], "text", spark.createDataFrame(TRACKS, "id string, artist string, title string, genre string"))
    for r in df.orderBy("i", "n").collect():
        got[r.i].append((r.kind, r.value))
    assert {t: got[i] for i, t in rows} == SAID


def test_the_ladder_of_tracks(spark):
    """Joined by words, the best is the one that comparing with all tracks gives."""
    from crateflow.operators import matching

    words = "golden hour night drive glass city nova reyes lights song".split()
    import random

    r = random.Random(2)
    tracks = spark.createDataFrame([(i, " ".join(r.sample(words, r.randint(1, 3))), " ".join(r.sample(words, r.randint(0, 2)))) for i in range(60)], "id long, title string, artist string")
    asked = spark.createDataFrame([(i, " ".join(r.sample(words, r.randint(1, 4)))) for i in range(80)], "qid long, q string")
    got = {r.q: r.id for r in listener.tracks_meant(asked.select("q").distinct(), tracks).collect()}
    want = {r.q: r.id for r in matching.match_queries(asked, tracks, 1).join(asked, "qid").collect()}
    assert got == want and len(want) > 40
