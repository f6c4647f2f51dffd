import unicodedata

from hypothesis import given
from hypothesis import strategies as st

from ricepaper.llm import lookalike

NODE = "id string, name map<string,string>, version string, canonical string"
ALIAS = "canonical string, aliases array<string>, form string"


def test_look():
    same = ["Toán học A", "Ｔｏáｎ　ｈọｃ　Ａ", "Tоán​ họс Α", " Toán  học A", "Toán­ học A"]
    assert {lookalike.look(s) for s in same} == {"Toán học A"}
    for other in ("toán học A", "Toan học A", "Tóan học A", "Toán-học A", "Toán họcA", "Toán học 4"):
        assert lookalike.look(other) != "Toán học A"
    assert lookalike.look("ể") == lookalike.look("ẻ̂") == lookalike.look("ẻ̂") == "ể"
    assert lookalike.look("l1I") == "l1I" and lookalike.look(None) is None and lookalike.look("​ ") == ""


@given(st.text(max_size=40))
def test_look_is_stable(text):
    once = lookalike.look(text)
    assert lookalike.look(once) == once
    assert lookalike.look(unicodedata.normalize("NFD", text)) == lookalike.look(unicodedata.normalize("NFC", text))


def test_pairs(spark):
    graph = spark.createDataFrame([("A", {"vi": "Toán"}, "1", "x"), ("A", {"vi": "Toán"}, "2", "x"), ("B", {"vi": "Ｔｏáｎ"}, None, "x"), ("C", {"en": "Toán"}, None, "x"), ("D", None, None, "x"), ("E", {"vi": "​"}, None, "x"), ("F", {"vi": None}, None, "x")], NODE)
    aliases = spark.createDataFrame([("A", [None, "Tоán", "toán"], "x"), ("A", [None, "Tоán", "toán"], "x"), ("Z", ["Toán", "", "‍"], "x"), (None, ["Toán"], "x"), ("Y", None, "x")], ALIAS)
    got = {tuple(r) for r in lookalike.same_look_pairs(graph, aliases).collect()}
    assert got == {("A", "A", 1), ("B", "A", 1), ("B", "Z", 0)}
    assert lookalike.same_look_pairs(graph.where("false"), aliases.where("false")).count() == 0


def test_canonical(spark):
    rows = spark.createDataFrame([(1, "Ｔｏáｎ", "k"), (2, "Toán", "k"), (3, "toán", "k"), (4, None, "k"), (5, "Ｔｏáｎ", "k")], "k int, name string, canonical string")
    got = {r.k: r.form for r in lookalike.with_canonical(rows, "name", "form").collect()}
    assert got == {1: "Toán", 2: "Toán", 3: "toán", 4: None, 5: "Toán"}
