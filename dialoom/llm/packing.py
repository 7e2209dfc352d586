"""Packing by concatenate and cut.

Pass one tokenizes each partition and writes its documents' ids with their offset
inside the partition. Prefix sums over the partitions' token totals give every
partition its global offset. Pass two cuts the one long stream into windows of
fixed length; a document that crosses a window's end gives a boundary record on
either side. Only the very last sequence is short. No row is shuffled: what moves
is one total per partition.

Null text counts as empty: such a document is its end id alone. Empty tables give
no rows. Repeated rows are separate documents. Very long texts give many pieces. Only
the id and the text are read, so the names of other columns cannot clash.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held, prefix_offsets, slices, small_side
from .token_count import byte_symbols
from .words import WordCache

#: Latin-1 bytes by kind: white space, letter or digit (a), full stop or comma (p), other (q).
KINDS = bytes(ord(" " if c.isspace() else "a" if c.isalnum() else "p" if c in ".," else "q") for c in map(chr, range(256)))


class WordTokenizer:
    """Ids of whole texts by a ``tokenizers`` vocabulary whose tokens never cross white space.

    Words are looked up in a bounded cache; what is missing is tokenized by the
    library, the letter runs of many words at once: each of them is one word to the
    merging model, so the end mark of its last token tells where it ends. Texts with
    special strings or odd white space go to the library whole.
    """

    def __init__(self, path: str, bound: int = 900_000) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        split, mark = parts[0] if parts else {}, spec["model"].get("end_of_word_suffix")
        usual = (
            [p["type"] for p in parts] == ["Split", "ByteLevel"]
            and (split["behavior"], split["invert"]) == ("Removed", True)
            and not parts[1]["use_regex"]
            and not parts[1]["add_prefix_space"]
            and [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and mark
        )
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall if usual else None
        #: A text with one of these goes to the library whole: special strings, and characters that
        #: str.split() takes for white space and the tokenizer does not, or may not.
        self.odd = [*"\x1c\x1d\x1e\x1f\x85", *(t["content"] for t in spec["added_tokens"])]
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.symbols = byte_symbols()
        self.simple = regex.compile(r"[\x21-\x7e\xa1-\u012f\u0131-\u017e]+").fullmatch
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if usual:
            self.ends[[i for s, i in vocabulary.items() if s.endswith(mark)]] = True
            #: The same merging model for lower-case letter runs between spaces, which need no pattern.
            self.letters = Tokenizer.from_file(path)
            self.letters.normalizer = None
            self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.piece = WordCache(self._piece, bound // 4)
        self.word = WordCache(self._word, bound)

    def _library(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _piece(self, piece: str) -> bytes:
        s = piece if piece.isascii() else "".join([self.symbols[b] for b in piece.encode()])
        return np.array([t.id for t in self.library.model.tokenize(s)], self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.pieces(word.lower()))) if self.simple(word) else self._library(word)

    def _words(self, text: str) -> list[str]:
        """Words whose ids, one after the other, are the text's. Latin-1 texts are put in lower
        case first and their full stops and commas, where alone, become words: fewer words to learn."""
        try:
            kinds = text.encode("latin-1").translate(KINDS)
        except UnicodeEncodeError:
            return text.split()
        text = text.lower()
        if not (b"pp" in kinds or b"pq" in kinds or b"qp" in kinds):
            text = text.replace(".", " . ").replace(",", " , ")
        return text.split()

    def learn(self, texts: list[list[str]]) -> None:
        """Fills the caches with the words of many texts, calling the library once."""
        known = self.word.missing(set().union(*texts))
        runs = [w for w in known if w.isalpha() and self.simple(w)]
        if runs:
            ids = np.asarray(self.letters.encode_batch_fast([" ".join(runs).lower()], add_special_tokens=False)[0].ids, self.kind)
            data, wide = ids.tobytes(), self.kind.itemsize
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * wide).tolist()
            if len(ends) != len(runs):
                raise AssertionError("letter runs and end marks differ")
            self.word.put_all(dict(zip(runs, map(data.__getitem__, map(slice, [0, *ends], ends)))))
        known.difference_update(runs)
        self.word.put_all({w: self._word(w) for w in known})

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian, each ``kind`` wide; null: none."""
        whole = [self.pieces is None or bool(t and any(o in t for o in self.odd)) for t in texts]
        words = [[] if w or not t else self._words(t) for t, w in zip(texts, whole)]
        if not self.pieces:
            return [self._library(t or "") for t in texts]
        self.learn(words)
        ids = self.word.__getitem__
        return [self._library(t) if w else b"".join(map(ids, each)) for t, w, each in zip(texts, whole, words)]


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each vocabulary and Python worker."""
    return held(("words", path), lambda: WordTokenizer(path))


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pass one: (part, start, tokens, wide, id, ids); start counts from the partition's begin."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, at = word_tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        end, wide = np.array([end_id], tokenizer.kind).tobytes(), tokenizer.kind.itemsize
        for batch in slices(batches):
            ids = [x + end for x in tokenizer(batch.column(1).to_pylist())]
            n = np.array([len(x) // wide for x in ids], np.int64)
            ends = at + np.cumsum(n)
            rows = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(rows, part)), pa.array(ends - n), pa.array(n), pa.array(np.full(rows, wide)), batch.column(0), pa.array(ids, pa.binary())],
                names=["_part", "_start", "_tokens", "_wide", "_id", "_ids"],
            )
            at = int(ends[-1])

    return docs.select(id_col, text_col).mapInArrow(run, f"_part long, _start long, _tokens long, _wide long, _id {kind}, _ids binary")


def pack(
    docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    Runs pass one at once and writes it to the shared folder. The partitions'
    offsets are joined by broadcast while there are few of them, else by shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    scratch = Scratch(docs.sparkSession, "packing")
    first = scratch.write(tokenized(docs, vocabulary, end_id, id_col, text_col), "ids")
    totals = scratch.write(first.groupBy("_part").agg(F.sum("_tokens").alias("_n")), "totals")
    offsets = prefix_offsets(totals, "_part", "_n", "_base").select("_part", "_base")
    placed = first.join(small_side(offsets, totals.count()), "_part")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, raw, wides = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            whose, rows, each = [], [], []
            for k, (g, data, wide) in enumerate(zip(base.tolist(), raw, wides)):
                ids = np.frombuffer(data, f"<u{wide}").astype("<u4")
                n = len(ids)
                cuts = [0, *range(window - g % window, n, window), n]
                for lo, hi in zip(cuts, cuts[1:]):
                    whose.append(k)
                    rows.append((lo, hi - lo, zlib.crc32(ids[lo:hi]), n, (g + lo) // window, (g + lo) % window))
                    if with_ids:
                        each.append(ids[lo:hi])
            columns = [pa.array(np.array(c, np.int64)) for c in zip(*rows)]
            if with_ids:
                columns.append(pa.array(each, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(whose)), *columns], names=names)

    schema = f"`{id_col}` {kind}, " + ", ".join(f"`{n}` long" for n in names[1:7]) + ", ids array<long>" * with_ids
    return placed.select((F.col("_base") + F.col("_start")).alias("at"), "_ids", "_wide", "_id").mapInArrow(run, schema)
