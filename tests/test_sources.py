import json

from pyspark.sql import functions as F

from ricepaper.sources import readers, writers
from ricepaper.streaming import queries as streams


def test_documents(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(b"plain \xff text")
    (tmp_path / "in" / "sub" / "b.html").write_text("<h1>Hi</h1><p>a &amp; b</p>")
    (tmp_path / "in" / "c.md").write_text("# Title\n* item")
    (tmp_path / "in" / ".hidden").write_text("no")
    (tmp_path / "in" / "d.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "in" / "e.txt").write_text("  ")
    got = {(r.source, r.page): r.text for r in readers.load_documents(spark, str(tmp_path / "in"), lambda b: b.decode().split("\f")).collect()}
    assert got[("a.txt", None)] == "plain  text" and got[("sub/b.html", None)] == "Hi\na & b" and got[("c.md", None)] == "Title\nitem"
    assert got[("d.pdf", 1)] == "one" and got[("d.pdf", 2)] == "two" and ("e.txt", None) not in got and len(got) == 5
    joined = readers.load_documents(spark, str(tmp_path / "in"), lambda b: b.decode().split("\f"), (".pdf",), join_pages=True).first()
    assert joined.text == "one\ntwo" and joined.page == 2


def test_csv_questions_graph_aliases(spark, tmp_path):
    (tmp_path / "x.csv").write_text("k,v\n1,\n2,b\n")
    assert {r.text for r in readers.read_csv(spark, str(tmp_path / "x.csv")).collect()} == {"k: 1\nv: None", "k: 2\nv: b"}
    (tmp_path / "q.jsonl").write_text('{"query": "a"}\n\n{"query": " "}\n{"query": "b"}\n')
    assert [r["query"] for r in readers.read_questions(spark, str(tmp_path / "q.jsonl")).collect()] == ["a", "b"]
    assert [r["query"] for r in readers.read_questions(spark, str(tmp_path / "q.jsonl"), 3).collect()] == ["a"]
    doc = {"nodes": [{"id": "A", "semester": [1, 2], "credits": {"total": 3, "theory": 2, "lab": 1}}, 5], "edges": [{"from": "A", "to": "B", "type": "prerequisite"}]}
    for k, shape in enumerate((doc, {"data": doc}, doc["nodes"])):
        (tmp_path / f"g{k}.json").write_text(json.dumps(shape))
        nodes, edges = readers.read_graph(spark, str(tmp_path / f"g{k}.json"))
        assert [(r.id, r.semester.replace(" ", ""), r.credits.total) for r in nodes.collect()] == [("A", "[1,2]", 3)]
        assert edges.count() == (0 if k == 2 else 1)
    (tmp_path / "a.json").write_text('{"z": ["1", "2"], "b": []}')
    assert [(r.canon_pos, r.canonical) for r in readers.read_aliases(spark, str(tmp_path / "a.json")).orderBy("canon_pos").collect()] == [(0, "z"), (1, "b")]


def test_index_and_upsert(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "alpha beta " * 400), ("d2", None), ("d3", "")], "doc_id string, text string")
    path = str(tmp_path / "index")
    r = writers.build_index(spark, docs, path, questions=1).first()
    assert (r.n_chunks, r.n_points, r.needs_reindex) == (2, 4, False)
    assert writers.index_status(spark, str(tmp_path / "none")).first().needs_reindex
    new = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    for _ in range(2):
        writers.upsert(spark, str(tmp_path / "t"), new, "id")
    writers.upsert(spark, str(tmp_path / "t"), spark.createDataFrame([("b", 3)], "id string, v int"), "id")
    assert {(x.id, x.v) for x in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 1), ("b", 3)}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 5.0, "2024-01-01 00:10:00"), (2, "a", 1.0, "2024-01-01 00:50:00"), (3, "b", 2.0, "2024-01-01 01:10:00")], "user_id int, event_type string, value double, t string")
    rows.withColumn("ts", F.to_timestamp("t")).drop("t").write.parquet(str(tmp_path / "events"))
    stream = streams.read_table_stream(spark, str(tmp_path / "events"))
    got = streams.run_to_table(streams.windowed_counts(stream), "complete").collect()
    assert {(r.w.start.hour, r.event_type, r.n, r.total) for r in got} == {(0, "a", 2, 6.0), (1, "b", 1, 2.0)}
