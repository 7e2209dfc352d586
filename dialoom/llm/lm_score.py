"""Language-model scores by deleted interpolation of word bigrams.

P(w | v) = x2 * c(v, w) / c(v) + x1 * c(w) / N + x0 / (V + 1), where the mixture
x depends on the frequency of the context v (buckets by powers of two). The weights
are learned by expectation-maximisation on held-out counts: for the tokens of one
fold of the training documents, with that fold's counts deleted from all counts.

Counts cover all training documents and are exact 64-bit numbers; none is cut off.
Consecutive documents of a partition make blocks of bounded size. A block sends the
sorted distinct hashes of its words and bigrams with its counts to nodes, one for
each part of the hash range; there they are added, and the sums go back the same way,
each list in the order in which it came. While few parts are needed, one step does
it. Beyond ``FAN`` parts the exchange takes several steps, each of which gathers a
group of senders and cuts their merged list into finer parts, so that no sender ever
sends more than ``FAN`` lists: records grow in proportion to the input (times the
number of steps, its logarithm). Memory holds one block or one node. Held-out tokens
reach the driver as a histogram of rounded log-probabilities whose cells are bounded.

The input is scanned four times: for its size, for the counts, for held-out tokens and
for the scores, which are written. Blocks are the same in each scan as long as the
input has the same rows in the same partitions, as files do; a difference fails the
query, never its result.

Null text: empty, which is one end token. Repeated rows count each; rows that share an
id are in blocks by their place, not their id. A null id counts as empty text in the
folds. Without training documents c, N and V are 0 and the model is uniform; with
training documents but none in the held-out fold the weights are the fixed ones that
learning begins with. Very long texts are read whole; one that is larger than a block
is a block of its own. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, id_crc, slices
from .words import M1, M2, word_hashes

#: UTF-8 bytes of text of a block, and of a node's share of the counts.
BLOCK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 16 << 20, 32
#: Parts into which a sender cuts its list at most.
FAN = 256
#: Contexts are put in buckets by the power of two of their frequency, from unseen (0) to this one.
CONTEXTS = 24
#: Steps an octave of the held-out histogram, and the octaves it reaches down.
STEPS, OCTAVES = 4, 60
END, START = np.uint64(0xE4D0000000000001), np.uint64(0x57A27000000000B1)


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, where each text begins, and the end): words between ASCII white space, A-Z in lower case, then an end."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts + 1)
    out = np.empty(len(hashes) + len(texts), np.uint64)
    last = np.zeros(len(out), bool)
    last[ends - 1] = True
    out[last], out[~last] = END, hashes
    return out, np.append(0, ends)


def bigrams(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[begin[:-1]] = START
    x = before * M1 + h
    x = (x ^ (x >> np.uint64(30))) * M2
    return x ^ (x >> np.uint64(27))


def pack_counts(counts: np.ndarray) -> bytes:
    """Numbers below 2**64, byte by byte: as many bytes each as the largest needs; equal bytes stand together and compress."""
    counts = counts.astype("<u8")
    width = max(1, (int(counts.max()).bit_length() + 7) // 8) if len(counts) else 1
    return bytes([width]) + counts.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, not none: the first, then the differences."""
    return keys[:1].astype("<u8").tobytes() + pack_counts(np.diff(keys))


def unpack_keys(data: bytes) -> np.ndarray:
    out = np.concatenate([np.frombuffer(data[:8], "<u8"), unpack_counts(data[8:]).astype(np.uint64)])
    return np.cumsum(out, dtype=np.uint64)


class Exchange:
    """How lists travel: ``steps`` steps, in each of which a sender cuts its list into ``fan`` parts.

    A node of step k is a part of the hash range (one of fan ** k) and a group of
    senders (one of fan ** (steps - k)); the last step's nodes have one group."""

    def __init__(self, text_bytes: int, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN) -> None:
        buckets = max(LEAST_BUCKETS, -(-text_bytes // bucket_bytes))
        self.steps = 1
        while fan**self.steps < buckets:
            self.steps += 1
        self.fan = math.ceil(buckets ** (1 / self.steps) - 1e-9)
        self.groups = self.fan ** (self.steps - 1)

    def begins(self, part: int, step: int) -> np.ndarray:
        """Where the parts of a list begin that a node of part ``part`` of step ``step`` (0: a block) cuts."""
        at, width, digits = 0, 1 << 64, []
        for _ in range(step):
            digits.append(part % self.fan)
            part //= self.fan
        for digit in reversed(digits):
            width //= self.fan
            at += digit * width
        width //= self.fan
        return np.array([at + k * width for k in range(self.fan)], np.uint64)

    def cut(self, keys: np.ndarray, part: int, step: int) -> Iterator[tuple[int, slice]]:
        """(part of the next step, its keys) of a sorted list."""
        cuts = np.append(np.searchsorted(keys, self.begins(part, step)), len(keys))
        cuts[0] = 0
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            yield part * self.fan + k, slice(int(cuts[k]), int(cuts[k + 1]))


def merged(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted lists: the distinct keys, the order of all keys, where each distinct one begins in it, and each key's place."""
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")  # runs that are sorted already merge fast
    in_order = flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = in_order[1:] != in_order[:-1]
    place = np.empty(len(flat), np.int64)
    place[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    return in_order[begin], order, begin, place


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(count.astype(np.float64))[1], CONTEXTS)


def learn_weights(cells: dict[tuple[int, int, int], int], rounds: int = 60) -> np.ndarray:
    """Weights [context bucket, (uniform, unigram, bigram)] by expectation-maximisation.

    ``cells``: (bucket, steps of p1 / p0 in octaves or -1 for 0, the same of p2) -> tokens.
    Each bucket begins with all cells' weights, so one that was never seen has those of all.
    Without cells the fixed weights that learning begins with are kept."""

    def fit(keys: np.ndarray, n: np.ndarray, begin: np.ndarray) -> np.ndarray:
        ratio = np.where(keys < 0, 0.0, 2.0 ** (keys / STEPS - OCTAVES // 2))
        p = np.column_stack([np.ones(len(keys)), ratio])
        x = begin
        for _ in range(rounds):
            share = p * x
            share /= share.sum(1, keepdims=True)
            x = (share * n[:, None]).sum(0) + 0.1 * begin
            x /= x.sum()
        return x

    every = np.array([[b, i, j] for b, i, j in cells], int).reshape(-1, 3)
    n = np.array(list(cells.values()), float)
    out = np.zeros((CONTEXTS + 1, 3))
    begin = np.array([0.1, 0.5, 0.4])
    general = fit(every[:, 1:], n, begin) if cells else begin
    for b in range(CONTEXTS + 1):
        mine = every[:, 0] == b
        out[b] = fit(every[mine, 1:], n[mine], general) if mine.any() else general
    # an unseen context has no bigram estimate
    out[0, :2] /= max(out[0, :2].sum(), 1e-12)
    out[0, 2] = 0
    return out


def _check(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(keys.view(np.int64))) if len(keys) else 0


class Node:
    """What the senders of a node have sent: ``lists`` by sender, and the sums over all of them."""

    def __init__(self, sent: pa.Table) -> None:
        self.senders = sent["sender"].to_pylist()
        self.lists = [unpack_keys(d) for d in sent["keys"].to_pylist()]
        self.ends = np.cumsum([0, *map(len, self.lists)])
        self.keys, self.order, self.begin, self.place = merged(self.lists)
        self.sent = sent

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """(total, that of the fold) of each distinct key."""
        total = np.concatenate([unpack_counts(d) for d in self.sent["counts"].to_pylist()])
        fold = [unpack_counts(d) if d else np.zeros(len(k), np.int64) for d, k in zip(self.sent["fold"].to_pylist(), self.lists)]
        return np.add.reduceat(total[self.order], self.begin), np.add.reduceat(np.concatenate(fold)[self.order], self.begin)

    def replies(self, total: np.ndarray, fold: np.ndarray, blocks: bool) -> Iterator[tuple]:
        """(sender, check, total, fold): the sums of each sender's keys in its order. Of ``blocks``, those with held-out rows need the fold's."""
        for k, (sender, own) in enumerate(zip(self.senders, self.lists)):
            some = self.place[self.ends[k] : self.ends[k + 1]]
            yield sender, _check(own), pack_counts(total[some]), b"" if blocks and sender % 2 == 0 else pack_counts(fold[some])


def _answers(rows: list[tuple], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, fold) for a sender's keys, from its replies (part, check, total, fold)."""
    rows = sorted(rows)
    none = [np.zeros(0, np.int64)]
    total = np.concatenate(none + [unpack_counts(r[2]) for r in rows])
    fold = np.concatenate(none + [unpack_counts(r[3]) for r in rows if r[3]]) if any(r[3] for r in rows) else np.zeros_like(total)
    if len(total) != len(keys) or functools.reduce(int.__xor__, [r[1] for r in rows], 0) != _check(keys):
        raise RuntimeError("the documents of a block differ between two reads of the input")
    return total, fold


class _Counts:
    """One block's answers: totals (and the fold's counts) of its words and bigrams in its own sorted order."""

    def __init__(self, replies: pa.Table, h: np.ndarray, begin: np.ndarray) -> None:
        rows = list(zip(*(replies[c].to_pylist() for c in ("kind", "part", "check", "total", "fold"))))
        self.values = []
        for kind, tokens_ in ((0, h), (1, bigrams(h, begin))):
            keys, at = np.unique(tokens_, return_inverse=True)
            total, fold = _answers([r[1:] for r in rows if r[0] == kind], keys)
            self.values.append((total[at], fold[at]))


class _Numbering:
    """Blocks of consecutive rows of a partition, by the running size of their texts."""

    def __init__(self, block_bytes: int) -> None:
        self.first, self.block_bytes, self.block, self.used = TaskContext.get().partitionId() << 32, block_bytes, 0, 0

    def __call__(self, sizes: list[int]) -> np.ndarray:
        out = np.empty(len(sizes), np.int64)
        for k, size in enumerate(sizes):
            if self.used and self.used + size > self.block_bytes:
                self.block, self.used = self.block + 1, 0
            self.used += size + 64
            out[k] = self.first + self.block
        return out


@contextmanager
def steady_splits(spark: SparkSession):
    """While this holds, the split of files, and with it the blocks, does not follow the number of executors."""
    name = "spark.sql.files.minPartitionNum"
    unset = name not in spark.conf.getAll
    if unset:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if unset:
            spark.conf.unset(name)


def _release(spark: SparkSession) -> None:
    """Asks for the shuffle files of finished steps to be removed now; only disk use depends on it."""
    spark._jvm.System.gc()


def score(
    docs: DataFrame,
    train: F.Column,
    fold: F.Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    fan: int = FAN,
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row, written to the shared folder.

    ``train`` says which rows are learned from; ``fold`` which of these are held out
    when weights are learned.
    """
    with steady_splits(docs.sparkSession):
        return _score(docs, train, fold, id_col, text_col, block_bytes, bucket_bytes, fan)


def _score(docs: DataFrame, train: F.Column, fold: F.Column, id_col: str, text_col: str, block_bytes: int, bucket_bytes: int, fan: int) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"), F.coalesce(train & fold, F.lit(False)).alias("_fold")
    )
    size = F.coalesce(F.octet_length("_text"), F.lit(0))
    total, taught, taught_fold = source.agg(F.sum(size.cast("long") + 64), F.count_if("_train"), F.count_if("_fold")).first()
    ways = Exchange(total or 0, bucket_bytes, fan)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = _Numbering(block_bytes), {}  # by block: those of the fold are odd
        for batch in slices(batches):
            texts = as_bytes(batch.column(0))
            which = number([len(t or b"") for t in texts]) * 2 + batch.column(2).to_numpy(zero_copy_only=False)
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for block in np.unique(which).tolist():
                mine = np.flatnonzero(which == block)
                h, begin = tokens([texts[k] for k in mine.tolist()])
                held.setdefault(block, []).append((h, bigrams(h, begin), np.repeat(learn[mine], np.diff(begin))))
            for block in sorted(b for b in held if b >> 1 < which[-1] >> 1):
                yield from _sent(block, held.pop(block), ways)
        for block in sorted(held):
            yield from _sent(block, held.pop(block), ways)

    group = F.pmod(F.xxhash64("sender"), F.lit(ways.groups))
    sent = source.select("_text", "_train", "_fold").mapInArrow(collect, SENT).withColumn("group", group)
    keys = ["kind", "part", "group"]
    steps = []
    for step in range(1, ways.steps):
        steps.append(scratch.write(sent, f"sent_{step}"))
        sent = steps[-1].groupBy(*keys).applyInArrow(_forwarding(ways, step), SENT + ", group long")
    replies = scratch.write(sent.groupBy(*keys).applyInArrow(_ending(ways.steps == 1), REPLY), f"replies_{ways.steps}")
    _release(spark)
    words = replies.where("sender = -1 and kind = 0").agg(F.sum("distinct"), F.sum("tokens"), F.sum("fold_tokens")).first()
    v, n, n_fold = (int(x or 0) for x in words)
    for step in range(ways.steps - 1, 0, -1):
        # what the next step's nodes say to a node of this one: its part is cut into theirs, its group is the sender
        said = replies.where("sender <> -1").select("kind", F.expr(f"part div {ways.fan}").alias("upper"), F.col("sender").alias("group"), "part", "check", "total", "fold")
        both = steps[step - 1].groupBy(*keys).cogroup(said.groupBy("kind", "upper", "group"))
        replies = scratch.write(both.applyInArrow(_returning(step == 1), REPLY), f"replies_{step}")
        scratch.drop(f"sent_{step}", f"replies_{step + 1}")
        _release(spark)
    answers = replies.where("sender >= 0").select("kind", "part", F.col("sender").alias("block"), "check", "total", "fold")

    @F.arrow_udf("long")
    def numbered(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        number = _Numbering(block_bytes)
        for column in columns:
            yield pa.array(number(column.to_pylist()))

    texts = source.withColumn("block", numbered.asNondeterministic()(size) * 2 + F.col("_fold").cast("long"))

    def before(values: np.ndarray, begin: np.ndarray, first: int) -> np.ndarray:
        """The count of each token's context: that of the word before, or of texts."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[begin[:-1]] = first
        return out

    def held_out(left: pa.Table, right: pa.Table) -> pa.Table:
        h, begin = tokens(as_bytes(left["_text"]))
        (one, one_fold), (two, two_fold) = _Counts(right, h, begin).values
        c1, c2 = one - one_fold, two - two_fold
        cv = before(c1, begin, taught - taught_fold)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = [np.where(c1 > 0, c1 / max(n - n_fold, 1), 0), np.where((cv > 0) & (c2 > 0), c2 / np.maximum(cv, 1), 0)]
            steps = [np.where(x > 0, np.round(STEPS * (np.log2(x * (v + 1)) + OCTAVES // 2)), -1).clip(-1, STEPS * OCTAVES).astype(np.int64) for x in p]
        cell, count = np.unique((context_bucket(cv) * 1000 + steps[0] + 1) * 1000 + steps[1] + 1, return_counts=True)
        return pa.table({"cell": cell.astype(np.int64), "n": count.astype(np.int64)})

    fold_texts = texts.where("_fold").select("block", "_text")
    odd = answers.where("block % 2 = 1")
    cells = fold_texts.groupBy("block").cogroup(odd.groupBy("block")).applyInArrow(_guard(held_out), "cell long, n long")
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most a cell for each bucket and pair of steps
    if n:
        weights = learn_weights({(c // 1_000_000, c // 1000 % 1000 - 1, c % 1000 - 1): k for c, k in cells})
    else:  # no counts to weigh
        weights = np.tile([1.0, 0.0, 0.0], (CONTEXTS + 1, 1))

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        h, begin = tokens(as_bytes(left["_text"]))
        (one, _), (two, _) = _Counts(right, h, begin).values
        cv = before(one, begin, taught)
        x = weights[context_bucket(cv)]
        p = x[:, 0] / (v + 1) + x[:, 1] * one / max(n, 1) + x[:, 2] * two / np.maximum(cv, 1)
        base = np.log10((one + 0.1) / (n + 0.1 * (v + 1)))
        at = begin[:-1]
        size = np.diff(begin)
        return pa.Table.from_arrays(
            [
                left["_id"],
                pa.array(size.astype(np.int64)),
                pa.array(np.add.reduceat((one > 0).astype(np.int64), at)),
                pa.array(np.full(len(at), n, np.int64)),
                pa.array(np.add.reduceat(base, at)),
                pa.array(np.add.reduceat(np.log10(np.maximum(p, 1e-300)), at)),
            ],
            names=OUT,
        )

    grouped = texts.select("block", "_id", "_text").groupBy("block").cogroup(answers.groupBy("block"))
    out = grouped.applyInArrow(_guard(rate), f"_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = scratch.write(out, "scores")
    scratch.drop("replies_1")
    return out.withColumnRenamed("_id", id_col)


OUT = ["_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
SENT = "kind int, part long, sender long, keys binary, counts binary, fold binary"
SENT_NAMES, SENT_KINDS = ["kind", "part", "sender", "keys", "counts", "fold", "group"], [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
REPLY = "kind int, part long, sender long, check long, total binary, fold binary, distinct long, tokens long, fold_tokens long"
REPLY_NAMES = ["kind", "part", "sender", "check", "total", "fold", "distinct", "tokens", "fold_tokens"]
REPLY_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names[: len(columns)])


def _sent(block: int, parts: list[tuple], ways: Exchange) -> Iterator[pa.RecordBatch]:
    """A block's lists, a batch each: distinct words, then bigrams, with their counts in rows that are learned from."""
    learn = np.concatenate([p[2] for p in parts])
    for kind in (0, 1):
        keys = np.concatenate([p[kind] for p in parts])
        every = np.unique(keys)
        taught, n = np.unique(keys[learn], return_counts=True)
        counts = np.zeros(len(every), np.int64)
        counts[np.searchsorted(every, taught)] = n
        for part, some in ways.cut(every, 0, 0):
            packed = pack_counts(counts[some])
            yield from _table([(kind, part, block, pack_keys(every[some]), packed, packed if block % 2 else b"")], SENT_NAMES, SENT_KINDS).to_batches()


def _forwarding(ways: Exchange, step: int):
    def run(table: pa.Table) -> pa.Table:
        """A node's merged list, cut for the nodes of the next step."""
        kind, part, group = (table[c][0].as_py() for c in ("kind", "part", "group"))
        node = Node(table)
        total, fold = node.sums()
        cuts = ways.cut(node.keys, part, step)
        rows = [(kind, finer, group, pack_keys(node.keys[some]), pack_counts(total[some]), pack_counts(fold[some]), group // ways.fan) for finer, some in cuts]
        return _table(rows, SENT_NAMES, SENT_KINDS)

    return run


def _ending(blocks: bool):
    def run(table: pa.Table) -> pa.Table:
        """A node that has all counts of its part: answers to its senders, and a row of sums."""
        kind, part = (table[c][0].as_py() for c in ("kind", "part"))
        node = Node(table)
        total, fold = node.sums()
        rows = [(kind, part, *r, 0, 0, 0) for r in node.replies(total, fold, blocks)]
        rows.append((kind, part, -1, 0, b"", b"", int((total > 0).sum()), int(total.sum()), int(fold.sum())))
        return _table(rows, REPLY_NAMES, REPLY_KINDS)

    return run


def _returning(blocks: bool):
    def run(sent: pa.Table, said: pa.Table) -> pa.Table:
        """A node's answers to its senders, from the answers that it got itself."""
        if not sent.num_rows or not said.num_rows:
            raise RuntimeError("a node of the exchange got no answers")
        node = Node(sent)
        total, fold = _answers(list(zip(*(said[c].to_pylist() for c in ("part", "check", "total", "fold")))), node.keys)
        kind, part = (sent[c][0].as_py() for c in ("kind", "part"))
        return _table([(kind, part, *r, 0, 0, 0) for r in node.replies(total, fold, blocks)], REPLY_NAMES, REPLY_KINDS)

    return run


def _guard(run):
    """Blocks have both documents and answers; anything else means that two reads of the input differ."""

    def checked(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            raise RuntimeError("the documents of a block differ between two reads of the input")
        return run(left, right)

    return checked


def fold_of(id_col: str, parts: int, which: int) -> F.Column:
    """Whether an id's crc32 leaves the remainder ``which``."""
    return id_crc(id_col) % parts == which
