from hypothesis import given, settings
from hypothesis import strategies as st

from ricepaper.llm import noise

META = "source string, path string, pages int, doc_id string, chunk_index int, course_ids array<string>, questions array<string>"


def chunks(spark, texts, doc="d", extra=False):
    rows = [(f"{doc}#chunk_{k}", t, (None, None, None, doc, k, None, None), "clash") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"id string, text string, metadata struct<{META.replace(' string', ':string').replace(' int', ':int').replace(' array', ':array')}>, token string")
    return df if extra else df.drop("token")


def filler(k):
    return f"the student council of section {k} publishes the credit rules and the peer-reviewed course starts every week. the student council publishes the credit rules for course IT135BVM."


def cases(spark, texts, **kw):
    rows = [filler(k) for k in range(12)] + texts
    got = noise.noise_cases(chunks(spark, rows, **kw)).collect()
    return {(int(r.chunk_id.rsplit("_", 1)[1]) - 12, r.line_no, r.noise, r.repaired) for r in got}


def test_divided_misread_headers_numbers(spark):
    page = "Study Guide 2018\nthe stu-\n{n}\nStudy Guide 2018    {n}\ndent council publishcs the cred1t rules and the peer-\nreviewed course lT135BVM (redit\nCredits:\n3\n- {n} -\nTrang l2"
    texts = [page.format(n=n) for n in (11, 12, 13)] + [page.format(n=11)]
    got = cases(spark, texts, extra=True)
    own = {c[1:] for c in got if c[0] == 0}
    assert (2, "hyphen", "student") in own and (5, "hyphen", "peer-reviewed") in own
    assert {(5, "misread", "publishes"), (5, "misread", "credit"), (6, "misread", "it135bvm"), (6, "misread", "credit")} <= own
    assert {(1, "header", ""), (4, "header", ""), (3, "page_number", ""), (9, "page_number", ""), (10, "page_number", "")} <= own
    # a value after a label is no page number
    assert (8, "page_number", "") not in own and len(own) == 11


def test_defined_results(spark):
    assert cases(spark, [None, "", "  ", "\n\n", "one line"]) == set()
    assert noise.noise_cases(chunks(spark, [])).count() == 0
    assert noise.noise_cases(chunks(spark, [None])).count() == 0
    # repeated rows give a case once
    df = chunks(spark, [filler(k) for k in range(6)] + ["the stu-\ndent council\n" + "word " * 50_000])
    assert noise.noise_cases(df.unionByName(df)).where("noise = 'hyphen'").count() == 1


def test_rebuilt_text(spark):
    text = "Study Guide 2018\nThe stu-\n~ 4 ~\ndent council publishes\nthe rules.\n\n1) first entry\n2) second entry\n\nSection 1.2 Rules\nThe course starts."
    cases_ = [(1, "header", "", ""), (2, "hyphen", "student", "student"), (3, "page_number", "", "")]
    assert noise.rebuild(text, cases_) == "The student council publishes the rules.\n\n1) first entry\n\n2) second entry\n\nSection 1.2 Rules\n\nThe course starts."


def test_cost_knows_only_confusions():
    assert noise.cost("exarnination", "examination") == 0.4
    assert noise.cost("cred1t", "credit") == 0.3
    assert noise.cost("cat", "cut") is None and noise.cost("abc", "abc") == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="studeniclrmhgwoab", min_size=3, max_size=12), st.data())
def test_every_single_confusion_meets_its_word(word, data):
    places = [(k, o, t) for o, t, _ in noise.CONFUSIONS for k in range(len(word)) if word.startswith(t, k)]
    if not places:
        return
    k, seen, true = data.draw(st.sampled_from(places))
    token = word[:k] + seen + word[k + len(true) :]
    assert noise.cost(token, word) is not None
    if sum(c.isalpha() for c in token) * 2 >= len(token):
        assert noise.unknown_keys(token) & noise.lexicon_keys(word)


def test_one_line_texts_and_every_occurrence_are_repaired(spark):
    texts = [filler(k) for k in range(12)] + ["students read the cred1t rules", "the cred1t rules and\nthe cred1t rules and the cred1t rules"]
    got = {r.chunk_id: r.text for r in noise.repaired_texts(chunks(spark, texts)).collect()}
    assert got["d#chunk_12"] == "students read the credit rules"
    assert got["d#chunk_13"] == "the credit rules and the credit rules and the credit rules"
    assert got["d#chunk_0"] == filler(0)


def test_rebuilt_words_are_whole_and_keep_their_neighbours():
    assert noise.rebuild("cred1ts cred1t, Cred1t", [(1, "misread", "cred1t", "credit")]) == "cred1ts credit, Credit"
    assert noise.rebuild("the (redit wi!! no", [(1, "misread", "(redit", "credit"), (1, "misread", "redit", "edit"), (1, "misread", "wi!", "will")]) == "the credit will! no"
    near = [(1, "misread", "1n", "in", "a", "b"), (1, "misread", "1n", "ln", "b", "c")]
    assert noise.rebuild("a 1n b 1n c", near) == "a in b ln c"


def test_the_broadcast_words_change_no_result(spark, monkeypatch):
    """Two close repairs that the context decides, a compound, and words beyond the broadcast ones."""
    more = ["the old form and the old farm"] * 3 + ["a green bam and a green barn"] * 3 + ["the peer-reviewed course"] * 3
    texts = [filler(k) for k in range(12)] + more + ["the o1d form and the peer-\nreviewed course publishcs the cred1t rules", "a grecn bam", "the exarnlnation of the rnodern clty"] + ["the examination of the modern city"] * 4
    df = chunks(spark, texts)
    whole = sorted(map(tuple, noise.noise_cases(df).collect()))
    monkeypatch.setattr(noise, "TRUSTED", 5)
    assert sorted(map(tuple, noise.noise_cases(df).collect())) == whole
    # two letters for letters in one word
    assert {("misread", "examination"), ("misread", "modern"), ("misread", "city"), ("hyphen", "peer-reviewed")} <= {(n, r) for _, _, n, r in whole}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="studeniclrmhgwoab", min_size=4, max_size=12), st.data())
def test_two_confusions_and_many_marks_meet_their_word(word, data):
    token, at = "", 0
    for _ in range(2):
        places = [(k, o, t) for o, t, _ in noise.CONFUSIONS for k in range(at, len(word)) if word.startswith(t, k)]
        if places:
            k, seen, true = data.draw(st.sampled_from(places))
            token, at = token + word[at:k] + seen, k + len(true)
    token += word[at:]
    if token != word and sum(c.isalpha() for c in token) * 2 >= len(token):
        assert noise.unknown_keys(token) & noise.lexicon_keys(word)


def test_tokens_of_many_marks():
    token, word = "prel!m!naryl!ab!l!tyrncred!tlist", "preliminaryliabilitymcreditlist"
    assert noise.unknown_keys(token) & noise.lexicon_keys(word) and noise.cost(token, word) is not None
    assert len(noise.unknown_keys("abcdefghijkl" * 2 + "!" * 16)) < 1000
