"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark's items: each run of ``window``
words, or the whole of an item that has fewer (but some). Patterns are grouped by
length; each group has a shift table over blocks of two words, which says how far
the search may jump, and buckets by the hash of the pattern's last block, whose
members are confirmed by direct comparison.

Null and empty texts have no words: documents of that kind are clean, items of
that kind are no pattern. Repeated items count once for each distinct id; an item
without an id hits words but is not listed. Rows that share an id are judged each on
its own; exactly the limit's share of words is contaminated. Very long texts are read
whole; other columns are not read, or kept as they are. The patterns travel to each worker,
once their bytes have been summed and found below a bound; a larger benchmark is
searched in several parts, each below the bound, whose hits are united.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, held, slices

#: Bytes of benchmark text that one pass searches for; its tables take some twelve times as many in a worker.
PASS_BYTES = 16 << 20
#: Spreads the words' numbers over the shift table.
FACTOR = 0x9E3779B1

#: Lower-cases A-Z and turns all that is neither ASCII letter or digit nor beyond ASCII into a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WordSearch:
    """Wu-Manber tables for the patterns of one length: pieces of the items' words, which are numbers.

    The shift table has a byte for each hash of a block of two words: how far the search
    may jump where that block ends, at least; it is so wide that few blocks of other texts
    meet one of the patterns there. Patterns lie in the order of their last block; they are
    the places in ``words`` where they begin, so nothing is held twice.
    """

    def __init__(self, length: int, words: np.ndarray, begins: np.ndarray) -> None:
        self.length, self.pairs = length, length > 1
        self.default = min(255, length - 1 if self.pairs else 1)
        self.mask = (1 << max(10, (16 * len(begins)).bit_length())) - 1
        self.table = bytearray(bytes([self.default])) * (self.mask + 1)
        table = np.frombuffer(self.table, np.uint8)
        keys = np.empty(len(begins), np.int64)
        for at in range(0, len(begins), 1 << 18):  # the numbers of a part at a time
            some = begins[at : at + (1 << 18)]
            for end in range(2 if self.pairs else 1, length + 1):
                last = words[some + (end - 1)].astype(np.int64)
                before = words[some + (end - 2)].astype(np.int64) if self.pairs else np.int64(0)
                np.minimum.at(table, (before * FACTOR + last) & self.mask, min(255, length - end))
            keys[at : at + len(some)] = last + (before << 32)
        order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys, self.begins, self.words = array("q", keys[order].tobytes()), array("i", begins[order].tobytes()), words.tobytes()

    def search(self, words: list, number: Callable, hit: list, places: list) -> None:
        """Adds the (begin, end) of each occurrence to ``hit`` and where its patterns begin to ``places``."""
        n, length, table, mask, pairs, default = len(words), self.length, self.table, self.mask, self.pairs, self.default
        keys, begins, own = self.keys, self.begins, self.words
        at, before = length - 1, 0
        while at < n:
            # a word that no item has ends no block of a pattern
            if (last := number(words[at])) is None or (pairs and (before := number(words[at - 1])) is None):
                at += default
                continue
            if step := table[(before * FACTOR + last) & mask]:
                at += step
                continue
            key = last + (before << 32)
            k = bisect_left(keys, key)
            if k < len(keys) and keys[k] == key:
                here = [number(w) for w in words[at + 1 - length : at + 1]]
                if None not in here:
                    said, before_this = array("i", here).tobytes(), len(places)
                    while k < len(keys) and keys[k] == key:
                        begin = begins[k]
                        if own[4 * begin : 4 * (begin + length)] == said:
                            places.append(begin)
                        k += 1
                    if len(places) > before_this:
                        hit.append((at + 1 - length, at + 1))
            at += 1


class Searcher:
    """The items' words as numbers, once, one item after the other, and the tables of each length of pattern."""

    def __init__(self, items: list[tuple], window: int) -> None:
        numbers: dict[bytes, int] = {}
        parts, sizes = [], []
        for _, text in items:
            words = words_of(text or b"")
            parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
            sizes.append(len(words))
        self.number, self.items = numbers.get, [item for item, _ in items]
        words, sizes = np.concatenate([*parts, np.zeros(0, np.int32)]), np.array(sizes, np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.searches = []
        for length in np.unique(np.minimum(sizes[sizes > 0], window)).tolist():
            of = np.flatnonzero(sizes >= window if length == window else sizes == length)
            counts = sizes[of] - length + 1
            begins = np.repeat(self.starts[of] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            begins = begins.astype(np.int32)
            self.searches.append(WordSearch(length, words, begins))

    def __call__(self, text: bytes) -> tuple[int, list, set]:
        """The number of words, the (begin, end) of occurrences, and the items that occur."""
        words, hit, places = words_of(text), [], []
        for s in self.searches:
            s.search(words, self.number, hit, places)
        found = set(np.searchsorted(self.starts, np.array(places), "right").tolist()) if places else ()
        # items without words begin where the next one does: the last one that begins there has the words
        return len(words), hit, {self.items[k - 1] for k in found} - {None}


def covered(spans: list[tuple]) -> int:
    """How many places any of the spans covers."""
    total = last = 0
    for begin, end in sorted(spans):
        total += max(0, end - max(begin, last))
        last = max(last, end)
    return total


class _Passes:
    """The benchmark, cut into passes whose bytes have been summed, and what its workers run."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int, item_col: str, item_text_col: str, pass_bytes: int) -> None:
        self.spark, self.window = docs.sparkSession, window
        self.items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
        size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
        total = self.items.agg(F.sum(size.cast("long"))).first()[0] or 0
        self.number = max(1, -(-total // pass_bytes))

    def finder(self, part: int = 0) -> Callable[[], Searcher]:
        """For the workers: the tables of one pass, built once a worker."""
        chosen = self.items if self.number == 1 else self.items.where(F.pmod(F.xxhash64("text"), F.lit(self.number)) == part)
        listed = sorted({(r[0], bytes(r[1] or "", "utf-8")) for r in chosen.collect()}, key=lambda x: (x[0] or "", x[1]))
        shipped, window = self.spark.sparkContext.broadcast(listed), self.window
        key = ("search", hashlib.sha256(repr((window, listed)).encode()).hexdigest())
        return lambda: held(key, lambda: Searcher(shipped.value, window))

    def united(self, numbered: DataFrame, text_col: str, percent: int) -> DataFrame:
        """Verdicts by ``_row``: one search a pass, whose hits a row unites by a shuffle."""
        partial = None
        for part in range(self.number):
            one = numbered.select("_row", text_col).mapInArrow(_spans(self.finder(part)), "_row long, n_words long, _spans array<long>, _items array<string>")
            partial = one if partial is None else partial.union(one)
        rows = partial.groupBy("_row").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items")
        )
        judge = _Judge(percent)

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                n, flat, found = (batch.column(k).to_pylist() for k in (1, 2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *judge(n, [list(zip(f[::2], f[1::2])) for f in flat], found)], names=["_row", *NAMES])

        return rows.mapInArrow(finish, f"_row long, {KINDS}")


class _Judge:
    """n_hit, n_items, items_sha256 and contaminated, of word counts, spans and items."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def __call__(self, n: list, spans: list, found: list) -> list[pa.Array]:
        hit = np.array([covered(s) for s in spans], np.int64)
        shas = [hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in found]
        bad = (hit > 0) & (100 * hit >= self.percent * np.array(n, np.int64))
        return [pa.array(hit), pa.array([len(f) for f in found], pa.int64()), pa.array(shas, pa.string()), pa.array(bad)]


def _spans(finder: Callable[[], Searcher]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in slices(batches):
            got = [find(t or b"") for t in as_bytes(batch.column(1))]
            flat = pa.array([[v for s in x[1] for v in s] for x in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in got], pa.int64()), flat, pa.array([sorted(x[2]) for x in got], pa.list_(pa.string()))],
                names=["_row", "n_words", "_spans", "_items"],
            )

    return run


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    percent: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``.

    ``contaminated``: words are hit, and they are at least ``percent`` of all. The
    documents are read once, without a shuffle, if the benchmark fits one pass; else
    once for each pass, and the hits of a document's row are united by a shuffle.
    """
    passes = _Passes(docs, benchmark, window, item_col, item_text_col, pass_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    if passes.number == 1:
        finder, judge = passes.finder(), _Judge(percent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = finder()
            for batch in slices(batches):
                n, spans, found = zip(*[find(t or b"") for t in as_bytes(batch.column(1))])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *judge(n, spans, found)], names=[id_col, *NAMES])

        return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {KINDS}")
    # each row gets a number that a written table keeps
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    numbered = Scratch(docs.sparkSession, "decontaminate").write(rows, "rows")
    return numbered.select("_row", F.col("_id").alias(id_col)).join(passes.united(numbered, "_text", percent), "_row").drop("_row")


NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
KINDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns. Only the text goes to Python; a flag comes back."""
    passes = _Passes(docs, benchmark, window, item_col, item_text_col, pass_bytes)
    if passes.number == 1:
        finder, judge = passes.finder(), _Judge(percent)

        @F.arrow_udf("boolean")
        def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            find = finder()
            for column in columns:
                got = [find(t or b"") for t in as_bytes(column)]
                yield pc.invert(judge(*zip(*got))[-1]) if got else pa.array([], pa.bool_())

        return docs.where(clean(F.col(text_col).cast("string")))
    columns = docs.columns
    inner = docs.toDF(*[f"_c{k}" for k in range(len(columns))]).withColumn("_row", F.monotonically_increasing_id())
    numbered = Scratch(docs.sparkSession, "decontaminate").write(inner, "rows")
    bad = passes.united(numbered, f"_c{columns.index(text_col)}", percent).where("contaminated").select("_row")
    return numbered.join(bad, "_row", "left_anti").select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(columns)])
