import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

bpe = pytest.importorskip("loomspark.llm.bpe")
tokenizers = pytest.importorskip("tokenizers")
PATH = f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def both():
    ref = tokenizers.Tokenizer.from_file(PATH)
    ref.encode_special_tokens = True
    return bpe.encoder(PATH), lambda t: ref.encode(t, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abe 's\n\t0한국어교육的中文😀<|>endoftext", max_size=80))
def test_equals_the_merge_rules(both, text):
    mine, ref = both
    assert mine.encode(text) == ref(text)


def test_special_names_are_text_and_empty_is_empty(both):
    mine, ref = both
    assert 50256 not in mine.encode("a<|endoftext|>b") and mine.encode("a<|endoftext|>b") == ref("a<|endoftext|>b")
    assert mine.encode(None) == mine.encode("") == []


def test_whole_small_table(spark, data, both):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(docs, "doc_id", "text").collect()}
    want = {r["doc_id"]: both[1](r["text"]) if r["text"] else [] for r in docs.select("doc_id", "text").collect()}
    assert got == want
    assert {r[0]: r[1] for r in docs.select("doc_id", bpe.token_counter()("text")).collect()} == {k: len(v) for k, v in want.items()}


def test_long_pieces_take_linear_time(both):
    mine, ref = both
    for unit in ("a", " ", "가", "abcdefg", "의x"):
        text = unit * (300_000 // len(unit))
        start = time.time()
        ids = mine.encode(text)
        assert time.time() - start < 10 and ids == ref(text)


def test_odd_rows(spark, both):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "a b", "x"), (2, " ", "x"), (2, " ", "x")], "doc_id bigint, text string, ids string")
    rows = sorted(((r["doc_id"], r["ids"]) for r in bpe.encode_corpus(df, "doc_id", "text").collect()), key=repr)
    assert rows == sorted([(1, []), (1, []), (None, both[1]("a b")), (2, both[1](" ")), (2, both[1](" "))], key=repr)
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
