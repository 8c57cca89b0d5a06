import pytest
from pyspark.sql import functions as F

from skein.sources import readers as rd
from skein.streaming import logs


def test_prose(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfone\r\ntwo\rthree")
    (tmp_path / "b.txt").write_bytes("ﬁne café".encode("cp1252", "ignore"))
    (tmp_path / "c.txt").write_bytes(b"x" * 50)
    got = {r["title"]: r for r in rd.prose(spark, str(tmp_path), limit=40).collect()}
    assert got["a.txt"]["text"] == "one\ntwo\nthree" and got["b.txt"]["text"] == "ne café"
    assert got["c.txt"]["error"] == "too large" and got["c.txt"]["text"] is None


def test_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,body\n1,"x, y"\n2,z\n')
    (tmp_path / "a.tsv").write_text("id\tbody\n1\tx\n")
    (tmp_path / "a.jsonl").write_text('{"id": "1", "body": "p"}\n\nnot json\n{"id": "2", "body": "ﬁ"}\n')
    (tmp_path / "a.json").write_text('[{"id": "1", "body": "p"}, {"id": "2", "body": "q"}]')
    (tmp_path / "b.json").write_text('{"id": "1", "body": "only"}')
    texts = lambda df: sorted(r["text"] for r in df.where("error is null").collect())
    assert texts(rd.csv(spark, str(tmp_path / "a.csv"))) == ["x, y", "z"]
    assert texts(rd.csv(spark, str(tmp_path / "a.tsv"))) == ["x"]
    lines = rd.jsonl(spark, str(tmp_path / "a.jsonl"), "id string, body string")
    assert texts(lines) == ["fi", "p"] and [r["error"] for r in lines.where("error is not null").collect()] == ["malformed record"]
    assert texts(rd.json_array(spark, str(tmp_path / "a.json"), "id string, body string")) == ["p", "q"]
    assert texts(rd.json_array(spark, str(tmp_path / "b.json"), "id string, body string")) == ["only"]
    good, bad = rd.settle(lines, "quarantine")
    assert good.count() == 2 and bad.count() == 1 and rd.settle(lines, "skip")[1].count() == 0
    with pytest.raises(Exception, match="malformed"):
        rd.settle(lines, "raise")[0].collect()


def test_choices():
    assert rd.kind_of("/x/a.MD") == "text" and rd.kind_of("b.ndjson") == "jsonl"
    with pytest.raises(ValueError):
        rd.kind_of("c.exe")
    assert rd.text_column(["id", "Content", "z"]) == "Content" and rd.text_column(["id", "z"]) == "z"


def test_markup(spark):
    one = spark.createDataFrame([("<html><title> T </title><style>p{}</style><p>a&nbsp;&lt;b</p><!-- c --></html>", "# A\ntext\n### B c\n#no", "<?xml?><r><a>x</a> <b>y</b></r>", "2.3.1 Scope")], "h string, m string, x string, n string")
    got = one.select(rd.html_text(F.col("h")), rd.html_title(F.col("h")), rd.headings(F.col("m")), rd.xml_text(F.col("x")), rd.numbered_depth(F.col("n"))).first()
    assert got[0] == "T a <b" and got[1] == "T" and [tuple(r) for r in got[2]] == [(1, "A"), (3, "B c")] and got[3] == "x y" and got[4] == 3


def test_chat(spark):
    turns = spark.createDataFrame([(1, 2, "bot", "yo"), (1, 1, "me", "hi"), (2, 1, "me", "x")], "c int, t int, r string, x string")
    docs = {r["conversation"]: r["text"] for r in rd.chat(turns, "c", "t", "r", "x").collect()}
    assert docs == {1: "[me] hi\n\n[bot] yo", 2: "[me] x"}
    for r in rd.chat_offsets(turns, "c", "t", "r", "x").collect():
        assert docs[r["conversation"]][r["char_start"] : r["char_end"]].startswith("[")


def events(spark, tmp_path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, task string, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(len(batches)):
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            f.rename(folder / f"{k:03d}.parquet")
    return logs.file_stream(spark, str(folder), "id long, task string, ts timestamp, v double")


def run(df, spark, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_streams(spark, tmp_path):
    from datetime import datetime, timedelta

    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    batches = [[(1, "a", t(0), 1.0), (2, "b", t(1), 1.0)], [(3, "a", t(5), 2.0), (1, "a", t(5), 9.0)], [(4, "b", t(200), 1.0)], [(5, "b", t(400), 1.0)]]
    stream = events(spark, tmp_path, batches)
    seqs = run(logs.numbered(stream, "task", "id"), spark, "numbered")
    by = {}
    for r in seqs:
        by.setdefault(r["task"], []).append(r["seq"])
    assert {k: sorted(v) for k, v in by.items()} == {"a": [1, 2, 3], "b": [1, 2, 3]}
    assert sorted(r["id"] for r in run(logs.once(stream, ["id"], "ts", "1 hour"), spark, "once")) == [1, 2, 3, 4, 5]
    windows = {(r["start"], r["task"]): (r["n"], r["total"]) for r in run(logs.windowed(stream, "ts", "1 hour", "10 minutes", "task", "v"), spark, "windowed")}
    assert windows[(t(0), "a")] == (3, 12.0) and windows[(t(0), "b")] == (1, 1.0)
    assert {(r["task"], r["n"]) for r in run(logs.sessions(stream, "ts", "30 minutes", "10 minutes", "task"), spark, "sessions")} >= {("a", 3), ("b", 1)}
    q = logs.publish(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
