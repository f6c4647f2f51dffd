import itertools
import os
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ricepaper.llm import encoding, packing

needs_files = pytest.mark.skipif(not os.path.exists(f"{encoding.TOKENIZERS}/byte_bpe_50k.json"), reason="no vocabulary files")


@pytest.fixture(scope="module")
def made():
    return encoding.Transducer(*encoding.read_vocabulary())


@pytest.fixture(scope="module")
def known():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@needs_files
@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="abcdeilnorst ", max_size=900), st.text(alphabet="ếạo \n'sl0", max_size=200)))
def test_same_ids_and_back(made, known, text):
    made.words.clear()
    ids = made.encode(text)
    assert ids == known(text) == made.encode(text)
    assert made.count(text) == len(ids)
    assert "".join(made.decode(ids)) == text


@needs_files
def test_whole_table_like_the_public_tokenizer(made, known):
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    import pyarrow.parquet as pq

    for text in pq.read_table(path, columns=["text"]).column(0).to_pylist():
        assert made.encode(text) == (known(text) if text else [])


@needs_files
@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "ab", "é", "12", "7", " ", "  ", "\n", "\t ", "'", "'re", "'s", "-=", "…", "don't", " x"]), max_size=60), st.integers(6, 12), st.integers(1, 7))
def test_blocks_change_nothing(made, known, words, block, piece):
    text = "".join(words)
    whole, encoding.BLOCK = encoding.BLOCK, block
    try:
        assert list(made.encode_stream(text[k : k + piece] for k in range(0, len(text), piece))) == known(text)
    finally:
        encoding.BLOCK = whole


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=12), st.lists(st.integers(0, 2), max_size=60))
def test_tokens_are_stable_after_the_lookahead(pairs, data):
    """Any merge list whose tokens differ: like the merge loop, and no emitted token changes later."""
    tokens, merges = [bytes([b]) for b in range(256)], []
    for a, b in pairs:
        a, b = (x if x < 3 else 256 + x - 3 for x in (a, b))
        if max(a, b) < len(tokens) and (new := tokens[a] + tokens[b]) not in tokens:
            merges.append((a, b, len(tokens)))
            tokens.append(new)

    def loop(ids):
        for a, b, c in merges:
            out = []
            for x in ids:
                if out and (out[-1], x) == (a, b):
                    out[-1] = c
                else:
                    out.append(x)
            ids = out
        return ids

    made = encoding.Transducer(tokens, merges)
    whole = loop(data)
    if all(loop(list(t)) == [k] for k, t in enumerate(tokens)):
        assert list(made.stream([bytes(data)])) == whole
        assert list(made.stream(bytes([b]) for b in data)) == whole
    ends = set(np.cumsum([len(tokens[t]) for t in whole]).tolist())
    for k in range(len(data)):
        own = np.cumsum([len(tokens[t]) for t in loop(data[:k])]).tolist()
        assert {e for e in own if e <= k - made.reach} <= ends


@needs_files
def test_long_words_need_constant_memory(made, known):
    for word in ("a" * 50_000, "ab" * 30_000, "-=" * 20_000, "ế" * 15_000, " " * 70_000 + "x", "<|endoftext|>" * 50):
        assert made.encode(word) == known(word)

    def peak(size):
        tracemalloc.start()
        pieces = (("ab" * 5000 if k % 20 else " \n words") for k in range(size // 10_000))
        assert sum(1 for _ in made.encode_stream(pieces)) > size // 20
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    first = peak(300_000)
    assert peak(1_200_000) < 1.2 * first


@needs_files
def test_columns(spark):
    df = spark.createDataFrame([(1, None, [9]), (2, "", [9]), (3, "hello wörld", [9]), (3, "hello wörld", [9])], "doc_id long, text string, ids array<int>")
    rows = encoding.decode(encoding.count_tokens(encoding.encode(df))).collect()
    assert [list(r.ids) for r in rows[:2]] == [[], []] and rows[0].n_tokens == 0 and rows[0].decoded == ""
    assert rows[2].decoded == "hello wörld" and rows[2].n_tokens == len(rows[2].ids) and rows[2].ids == rows[3].ids
    assert encoding.encode(df.where("false")).count() == 0


def padding(counts, bounds):
    return sum(c * (min(b for b in bounds if b >= k) - k) for k, c in enumerate(counts) if c and k)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=2, max_size=11), st.integers(1, 4))
def test_bounds_are_optimal(counts, buckets):
    counts = np.array([0, *counts])
    lengths = [k for k in np.flatnonzero(counts)]
    got = packing.bucket_bounds(counts, buckets)
    if not lengths:
        assert got == []
        return
    best = min(padding(counts, [*c, lengths[-1]]) for n in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], n))
    assert len(got) <= buckets and padding(counts, got) == best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=8), st.integers(8, 40))
def test_batches_place_everything_once(counts, capacity):
    bounds = list(range(1, len(counts) + 1))
    plan = packing.plan_batches(bounds, counts, capacity)
    assert [sum(r * p.get(k, 0) for r, p in plan) for k in range(len(counts))] == counts
    assert all(r >= 1 and sum(bounds[k] * q for k, q in p.items()) <= capacity for r, p in plan)


def test_pack(spark):
    rng = np.random.default_rng(0)
    rows = [(k, int(n)) for k, n in enumerate(rng.integers(0, 700, 400))] + [(1000 + k, 300) for k in range(200)] + [(2000, None), (2001, 0), (2002, 256), (2003, 512)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens int").withColumn("rank", F.lit("clash"))
    windows = spark.createDataFrame([(1, 256), (2, 1024), (2, 1024), (3, None), (4, 0)], "window_id int, capacity_tokens int")
    got = packing.pack(items, windows).collect()
    size = dict(rows)
    for w, cap in ((1, 256), (2, 1024)):
        own = [r for r in got if r.window_id == w]
        total, fill = {}, {}
        for r in own:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
            if r.prompt_id is not None:
                fill[r.prompt_id] = fill.get(r.prompt_id, 0) + r.n_tokens
            assert (r.prompt_id is None) == (r.n_tokens == 0)
        assert total == {k: n or 0 for k, n in size.items()}
        assert max(fill.values()) <= cap and len(fill) <= 1.08 * sum(fill.values()) / cap + 1
        split = {d for d in size if sum(r.doc_id == d for r in own) > 1}
        assert split == {d for d, n in size.items() if (n or 0) > cap}
    assert {r.window_id for r in got} == {1, 2}
    assert packing.pack(items.where("false"), windows).count() == 0 and packing.pack(items, windows.where("false")).count() == 0
