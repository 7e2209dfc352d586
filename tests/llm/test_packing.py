import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from dialoom.llm.packing import WordTokenizer, pack

from .fixtures import ODD_TEXTS, empty_documents, odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, docs, window):
    """rows against the documents: whole, gapless, and each piece's ids are the library's."""
    want = Counter((i, tuple(library_ids(t))) for i, t in docs)
    rows = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    at = (0, 0)
    got, open_ = Counter(), {}
    for r in rows:
        assert (r.sequence_id, r.offset) == at
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        end = r.offset + r.length
        assert end <= window
        at = (r.sequence_id, end) if end < window else (r.sequence_id + 1, 0)
        before = open_.pop(r.doc_id, [])
        assert r.start == len(before)
        ids = before + r.ids
        if len(ids) == r.doc_tokens:
            got[r.doc_id, tuple(ids)] += 1
        else:
            open_[r.doc_id] = ids
    assert not open_ and got == want


def test_round_trip(spark):
    docs, rows = odd_documents(spark)
    check(pack(docs, PATH, window=64, with_ids=True).collect(), [(r[0], r[1]) for r in rows], 64)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = pack(docs.repartition(5), PATH, with_ids=True).collect()
    check(got, [(r.doc_id, r.text) for r in docs.collect()], 4096)
    # no padding but in the last sequence
    total = sum(r.length for r in got)
    assert max(r.sequence_id for r in got) == (total - 1) // 4096


def test_empty(spark):
    assert pack(empty_documents(spark), PATH).collect() == []


def test_bounded_cache_changes_nothing():
    small, large = WordTokenizer(PATH, bound=4), WordTokenizer(PATH)
    assert small(ODD_TEXTS) == large(ODD_TEXTS)


def test_every_route_gives_the_library_s_ids():
    """Odd short texts: Latin-1 and not, letter runs, marks, special strings, combining and folded characters, all spaces."""
    import random

    draw = random.Random(8)
    bits = [*"aZé ßµ.,!?'-_0129\t\n", "  ", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "İ", "ſ", "ﬁ", "e\u0301", "Å", "中文", "Ωμέγα", "😀", "don't", "We'll", "...", "p.q", "<|endoftext|>", "</w>", "WORD", "word"]
    tokenizer = WordTokenizer(PATH, bound=200)  # caches that turn over often
    for _ in range(60):
        texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(14))) for _ in range(100)]
        got = [np.frombuffer(x, tokenizer.kind).tolist() for x in tokenizer(texts)]
        assert got == [library_ids(t)[:-1] for t in texts]
