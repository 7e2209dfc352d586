import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dialoom.llm.token_count import TokenCounter, count_tokens

from .fixtures import empty_documents, odd_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, COUNTER = Tokenizer.from_file(PATH), TokenCounter(PATH, bound=1000)


def library_count(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_rows(spark):
    docs, rows = odd_documents(spark)
    got = sorted(map(tuple, count_tokens(docs, PATH).collect()), key=repr)
    want = [(r[0], len((r[1] or "").encode()), n := library_count(r[1]), n > 1024) for r in rows]
    assert got == sorted(want, key=repr)
    assert count_tokens(empty_documents(spark), PATH).collect() == []


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: library_count(r.text) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, PATH).collect()} == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'stde<|>of"), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])), max_size=60))
def test_any_text(text):
    assert COUNTER(text) == library_count(text)


def test_spaces():
    draw = random.Random(3)
    for _ in range(2000):
        text = "".join(draw.choice("ab  \n\t.1é") for _ in range(draw.randrange(20)))
        assert COUNTER(text) == library_count(text), repr(text)


def test_pieces_of_over_a_million_bytes():
    draw = random.Random(5)
    letters = "".join(draw.choices("etaoin shrdlu".replace(" ", ""), k=1_100_000))
    for text in ("a" * 1_100_000, letters, "中文字" * 120_000, " " * 1_100_000, "\n" * 1_100_000, "-" * 1_100_000):
        assert len(text.encode()) > 1 << 20
        assert COUNTER(text) == library_count(text), text[:9]
        assert COUNTER(f"before {text} after") == library_count(f"before {text} after"), text[:9]
