"""Token counts by heap-and-linked-list byte-pair merging, for byte-level vocabularies in tokenizers' JSON form.

The count of a piece is its initial symbols less its merges; no identifier is made.
Null and empty texts count 0 tokens and 0 bytes. Repeated rows are counted each on
its own. Whole texts are counted, however long: a text is cut at spaces into chunks
whose counts do not depend on their neighbours, so memory follows the text, not its merges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import as_bytes, held, slices
from .words import WordCache

#: Fixed value: the pattern by which byte-level vocabularies of this kind split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def merge_count(symbols: list, merges: dict) -> int:
    """How many symbols are left after merging; ``merges``: pair -> rank * 2**20 + merged symbol.

    The heap holds rank * 2**40 + place of adjacent pairs, so no piece that fits into
    memory is too long. A popped entry counts only if the pair that is now at its place
    has its rank. Right and left neighbours form a linked list, so a merge costs
    O(log n). ``symbols`` is used up.
    """
    n = last = len(symbols)
    find = merges.get
    if n < 3:
        return n - (n == 2 and (symbols[0], symbols[1]) in merges)
    heap = [m >> 20 << 40 | i for i, pair in enumerate(zip(symbols, symbols[1:])) if (m := find(pair))]
    heapify(heap)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFFFF
        j = right[i]
        if j >= last or not (m := find((symbols[i], symbols[j]))) or m >> 20 != top >> 40:
            continue
        symbols[i] = new = m & 0xFFFFF
        symbols[j] = -1
        n -= 1
        right[i] = k = right[j]
        if k < last:
            left[k] = i
            if m := find((new, symbols[k])):
                heappush(heap, m >> 20 << 40 | i)
        if (h := left[i]) >= 0 and (m := find((symbols[h], new))):
            heappush(heap, m >> 20 << 40 | h)
    return n


class TokenCounter:
    """Counts the tokens of whole texts as the vocabulary's library would.

    Strings of the vocabulary's special tokens inside a text are one token each.
    ``bound`` limits the pieces that are kept; half as many chunks are.
    """

    def __init__(self, path: str, bound: int = 1_000_000) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only byte-level pair merging without normalisation is supported")
        to_byte = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        raw = lambda s: b"".join(map(to_byte.__getitem__, s))
        ids: dict[bytes, int] = {}
        self.merges: dict = {}
        for b in range(256):
            ids[bytes([b])] = b
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            self.merges[ids[a], ids[b]] = (rank + 1) << 20 | ids.setdefault(a + b, 256 + rank)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(SPLIT).findall
        self.piece = WordCache(lambda p: merge_count(list(p.encode()), self.merges), bound)
        self.chunk = WordCache(lambda c: sum(map(self.piece.__getitem__, self.pieces(c))), bound // 2)

    def __call__(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        if "  " in text:  # only runs of spaces depend on more than one chunk
            return sum(map(self.piece.__getitem__, self.pieces(text)))
        first, *rest = text.split(" ")
        chunk = self.chunk
        return chunk[first] * bool(first) + sum([chunk[" " + c] for c in rest])


def counter(path: str) -> TokenCounter:
    """One counter for each vocabulary and Python worker."""
    return held(("pieces", path), lambda: TokenCounter(path))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of ``docs``; no shuffle.

    Null text: 0 bytes, 0 tokens. Other columns of ``docs`` are not read, so their
    names cannot clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in slices(batches):
            texts = batch.column(1)
            sizes = [len(b or b"") for b in as_bytes(texts)]
            n = [count(t) if t else 0 for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
