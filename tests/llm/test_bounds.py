"""What a worker keeps is bounded in bytes, also where there are no spaces between words."""

import random
import tracemalloc
from sys import getsizeof

import public_tokenizers

from dialoom.llm.decontaminate import Searcher
from dialoom.llm.packing import WordTokenizer
from dialoom.llm.token_count import TokenCounter
from dialoom.llm.words import ENTRY, LONGEST, WordCache


def held_bytes(cache):
    return sum(getsizeof(k) + getsizeof(v) for d in (cache, cache.old) for k, v in d.items())


def unspaced(n, size, seed):
    draw = random.Random(seed)
    return ["".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(size)) for _ in range(n)]


def test_cache_is_bounded_in_bytes():
    cache = WordCache(lambda w: w.encode() * 4, 1000)
    for word in unspaced(5000, 200, 1):  # far fewer than a thousand of these fit
        assert cache[word] == word.encode() * 4
    assert held_bytes(cache) <= 1000 * ENTRY + 10_000
    cache.put_all({w: b"" for w in unspaced(400, 100, 2)})
    assert cache["x" * (LONGEST + 1)] == b"x" * 4 * (LONGEST + 1) and "x" * (LONGEST + 1) not in cache
    assert cache.missing({"a", "b" * (LONGEST + 1)}) == {"a"}


def test_frequent_words_stay():
    made = []
    cache = WordCache(lambda w: made.append(w) or len(w), 100)
    for k in range(2000):
        assert cache["often"] == 5 and cache[f"rare{k}"] == len(f"rare{k}")
    assert made.count("often") == 1


def test_texts_without_spaces(monkeypatch):
    texts = unspaced(300, 5000 // 3, 3) + unspaced(300, 150, 4)
    packing = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), bound=2000)
    counts = TokenCounter(public_tokenizers.path("byte_bpe_50k.json"), bound=2000)
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        want = [packing.library.encode(t, add_special_tokens=False).ids for t in some]
        assert [len(x) // packing.kind.itemsize for x in packing(some)] == [len(x) for x in want]
        assert all(counts(t) > 0 for t in some)
        # a batch's own words may pass the bound until the next one comes
        assert held_bytes(packing.word) < 2 * 2000 * ENTRY + 50 * 3000
        assert held_bytes(counts.piece) + held_bytes(counts.chunk) < 2 * 2000 * ENTRY
    assert all(len(w) <= LONGEST for c in (packing.word, packing.piece, counts.piece, counts.chunk) for w in [*c, *c.old])


def test_search_tables_are_a_few_times_the_text():
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(20_000)]
    items = [(str(k), " ".join(draw.choice(words) for _ in range(150)).encode()) for k in range(2000)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    find = Searcher(items, 13)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 12 * size + (4 << 20)
    assert find(items[7][1])[2] == {"7"} and len(find(items[7][1])[1]) == 138
