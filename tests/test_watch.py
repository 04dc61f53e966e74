import os
import time

import pytest

from crateflow.sources.watch import NewFiles, _Looks, unfinished


def put(folder, name, data, at=None):
    p = os.path.join(folder, name)
    with open(p, "w") as f:
        f.write(data)
    if at is not None:
        os.utime(p, (at, at))


def test_looks(tmp_path):
    d = str(tmp_path)
    put(d, "old.mp3", "x", 100)
    put(d, "again.mp3", "x", 100)
    os.mkdir(f"{d}/folder.mp3")
    looks = _Looks(d, ("mp3",))
    o = looks.initialOffset()
    assert set(o) == {"old.mp3", "again.mp3"}

    def look():
        nonlocal o
        rows, o = looks.read(o)
        return [(r[0], r[2], r[3]) for r in rows]

    assert look() == []
    put(d, "new.mp3", "abc")
    put(d, "empty.mp3", "")
    put(d, "list.zip", "zz")
    for name in ("a.mp3.crdownload", ".hidden.mp3", "~$x.mp3", "b.TMP", "c.temp"):
        put(d, name, "x")
    put(d, "again.mp3", "xyz", 200)
    assert look() == []
    put(d, "new.mp3", "abcdef")
    assert look() == [("again.mp3", 3, True), ("list.zip", 2, False)]
    assert look() == [("new.mp3", 6, True)]
    os.rename(f"{d}/a.mp3.crdownload", f"{d}/a.mp3")
    put(d, "gone.mp3", "x")
    assert look() == []
    os.remove(f"{d}/gone.mp3")
    put(d, "again.mp3", "longer", 300)
    assert look() == [("a.mp3", 1, True)]
    same = o
    assert look() == [] and o == same
    put(d, "empty.mp3", "now")
    assert look() == [] and look() == [("empty.mp3", 3, True)]
    assert not unfinished("x.mp3") and not unfinished("part")


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    d, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    os.mkdir(d)
    put(d, "before.mp3", "x", 100)
    spark.dataSource.register(NewFiles)

    def run(then):
        q = spark.readStream.format("new_files").option("path", d).load().writeStream.option("checkpointLocation", marks).trigger(processingTime="200 milliseconds").format("parquet").option("path", out).start()
        try:
            q.processAllAvailable()
            for name, data in then:
                put(d, name, data)
            deadline = time.time() + 60
            while time.time() < deadline and {n for n, _ in then} - {r.name for r in given()}:
                q.processAllAvailable()
                time.sleep(0.3)
        finally:
            q.stop()

    def given():
        return spark.read.parquet(out).collect() if os.path.isdir(f"{out}/_spark_metadata") and any(x.endswith(".parquet") for x in os.listdir(out)) else []

    run([("one.mp3", "abc"), ("two.zip", "z")])
    assert sorted((r.name, r.size, r.wanted) for r in given()) == [("one.mp3", 3, True), ("two.zip", 1, False)]
    put(d, "meanwhile.wav", "while stopped")
    run([("three.mp3", "abcd")])
    run([])
    assert sorted(r.name for r in given()) == ["meanwhile.wav", "one.mp3", "three.mp3", "two.zip"]


def test_a_folder_that_is_not_there(tmp_path):
    with pytest.raises(OSError):
        _Looks(str(tmp_path / "no"), ("mp3",)).initialOffset()
