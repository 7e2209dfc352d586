"""Near-duplicate vectors by Euclidean p-stable hashing, confirmed by exact cosines.

Equal vectors of one label become one class with a multiplicity. Each class's unit
vector is projected on random Gaussian directions; a table's code is the tuple of
quantised projections. Classes that share a code in some table are compared by
cosine in double precision. A pair is counted in the first table where its codes
meet, so links are counted once. Large buckets are dealt out as pairs of blocks.

Codes travel with a number for each class, not with vectors: one aggregation finds the
codes that several classes share, and names both where there are two. Each class also
has 64 signs of further projections; two classes alone in a bucket are compared only
if their signs do not differ in more places than vectors at the limit do but once in
some hundred million times. Two classes that are alone in several buckets are sent for
the first of them only. A vector is sent with 32 bits of each code, which tell in what
table a pair meets first; that they are equal where the codes are not happens to a pair
once in some hundred million times.

Only rows of one label and length are compared. Rows whose label, id or vector is
null, whose vector is empty, zero or holds null or non-finite components link with
nothing: 0 links, their own id as component. Repeated rows are copies of each other.
Rows that share an id are one node of the components. Empty tables give no rows. A
cosine equal to the limit is a link. Vectors of any length are compared; other columns
are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, small_side
from .runs import block_pairs, complete_runs, fixed, grouped_pairs, least_labels

#: Rows of a block; a bucket of at most so many rows is compared in one piece.
BLOCK = 256


def collision(distance: float, width: float) -> float:
    """The chance that one quantised projection is equal for two points so far apart."""
    t = width / distance
    return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(rows: int, cosine: float, recall: float = 0.97, stray: float = 0.1) -> tuple[float, int, int]:
    """(width of a cell, projections a table, tables): among ``rows`` unrelated vectors about ``stray`` share a given
    vector's code in one table, and a pair at the cosine's limit meets in some table with a chance of ``recall``.
    Of the widths that give this, the one with the fewest tables."""

    def with_width(width: float) -> tuple[int, int, float]:
        near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
        k = max(4, math.ceil(math.log(stray / max(rows, 2)) / math.log(far)))
        return max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k))), k, width

    tables, k, width = min(with_width(w / 4) for w in range(4, 21))
    return width, k, tables


def sign_limit(cosine: float, signs: int = 64) -> int:
    """In how many of the signs two vectors at the limit differ at most: 6.5 standard deviations over the mean."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.ceil(signs * p + 6.5 * math.sqrt(signs * p * (1 - p)))


@functools.lru_cache(maxsize=8)
def _directions(seed: int, length: int, tables: int, k: int, width: float) -> tuple[np.ndarray, ...]:
    """The random numbers of vectors of one length, drawn once a worker: directions, shifts, odd factors, directions of the signs."""
    draw = np.random.default_rng([seed, length])
    directions, shift = draw.standard_normal((length, tables * k)), draw.uniform(0, width, tables * k)
    odd = draw.integers(1, 2**63, (tables, k), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return directions, shift, odd, draw.standard_normal((length, 64))


def _check(column: pa.Array) -> list[np.ndarray | None]:
    out = []
    for value in column:
        if not value.is_valid or value.values.null_count or not len(value.values):
            out.append(None)
            continue
        v = value.values.to_numpy(zero_copy_only=False)
        out.append(v + 0 if np.isfinite(v).all() and v.any() else None)  # + 0: no negative zeros
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=-1, keepdims=True)  # neither overflow nor underflow in the norm
    return v / np.sqrt((v * v).sum(axis=-1, keepdims=True))


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.93,
    recall: float = 0.97,
    seed: int = 11,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row. Steps are written to the shared folder.

    ``recall`` is the chance, for a pair just at the limit, to be found; nearer pairs
    are found with more. The numbers of projections and tables follow the largest
    label's rows. No pair reaches the driver and none but a block's spanning links
    leave the task that compares it.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    element = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    id_kind = vectors.schema[id_col].dataType.simpleString()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                got = [v if i and g else None for v, i, g in zip(_check(part.column(2)), part.column(0).is_valid().to_pylist(), part.column(1).is_valid().to_pylist())]
                raw = [None if v is None else v.astype(kind).tobytes() for v in got]
                group = [None if r is None else hashlib.blake2b(b"%r %d " % (g, len(r)) + r, digest_size=16).digest() for r, g in zip(raw, part.column(1).to_pylist())]
                space = [None if r is None else f"{g} {len(r)}" for r, g in zip(raw, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(space, pa.string()), pa.array(group, pa.binary()), pa.array(raw, pa.binary())], names=["_id", "_space", "_class", "_vec"]
                )

    rows = vectors.select(F.col(id_col), F.col(label_col).cast("string"), F.col(vec_col))
    rows = scratch.write(rows.mapInArrow(clean, f"_id {id_kind}, _space string, _class binary, _vec binary"), "rows")
    valid = rows.where(F.col("_class").isNotNull())
    classes = valid.groupBy("_class", "_space").agg(F.min("_id").alias("_rep"), F.count("*").alias("_n"), F.first("_vec").alias("_vec"))
    classes = scratch.write(classes, "classes")
    largest = classes.groupBy("_space").count().agg(F.max("count")).first()[0] or 0
    width, k, tables = plan(largest, cosine, recall=recall)

    below = 63 - tables.bit_length()  # bits of a code under the table's number

    def codes_of(space: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A 63-bit code for each table, with the label and the table's number mixed in: the low halves, after one
        for the label, and the high halves; and the signs."""
        directions, shift, odd, more = _directions(seed, x.shape[1], tables, k, width)
        cells = np.floor((x @ directions + shift) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, k)
        mixed = (cells * odd).sum(2, dtype=np.uint64)
        salt = np.uint64(int.from_bytes(hashlib.blake2b(space.encode(), digest_size=8).digest(), "little"))
        mixed = (mixed ^ salt ^ (np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        # the table's number comes first: a lesser code is of an earlier table
        codes = (np.arange(tables, dtype=np.uint64) << np.uint64(below)) | (mixed >> np.uint64(64 - below))
        low = np.column_stack([np.full(len(x), salt >> np.uint64(32)), codes & np.uint64(0xFFFFFFFF)])
        return low.astype("<u4"), (codes >> np.uint64(32)).astype("<u4"), np.packbits(x @ more > 0, axis=1).view("<i8").ravel()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                spaces, raw = np.array(part.column(1).to_pylist(), object), part.column(2).to_pylist()
                low = np.zeros((len(raw), tables + 1), "<u4")
                high = np.zeros((len(raw), tables), "<u4")
                signs = np.zeros(len(raw), np.int64)
                for space in set(spaces.tolist()):
                    mine = np.flatnonzero(spaces == space)
                    low[mine], high[mine], signs[mine] = codes_of(space, _unit(np.stack([np.frombuffer(raw[i], kind) for i in mine])))
                halves = [pa.array([c.tobytes() for c in half], pa.binary()) for half in (low, high)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), part.column(4), *halves, pa.array(signs)], names=["_rep", "_vec", "_n", "_class", "_low", "_high", "_signs"]
                )

    coded = classes.select("_rep", "_space", "_vec", "_n", "_class").mapInArrow(
        encode, f"_rep {id_kind}, _vec binary, _n long, _class binary, _low binary, _high binary, _signs long"
    )
    # a short number for each class, which the written table keeps
    coded = scratch.write(coded.withColumn("_num", F.monotonically_increasing_id()), "coded")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                codes = fixed(part.column(1), "<u4")[:, 1:].astype(np.int64) | fixed(part.column(2), "<u4").astype(np.int64) << 32
                who = pa.array(np.tile(np.arange(part.num_rows), tables))
                yield pa.RecordBatch.from_arrays([pa.array(codes.T.ravel()), part.column(0).take(who)], names=["_code", "_num"])

    bands = coded.select("_num", "_low", "_high").mapInArrow(spread, "_code long, _num long")
    shared = bands.groupBy("_code").agg(F.count("*").alias("_rows"), F.min("_num").alias("_a"), F.max("_num").alias("_b"))
    shared = scratch.write(shared.where("_rows > 1"), "shared")
    two = shared.where("_rows = 2").groupBy("_a", "_b").agg(F.min("_code").alias("_code"))
    for side in ("_a", "_b"):
        two = two.join(coded.select(F.col("_num").alias(side), F.col("_signs").alias(f"_signs{side}")), side)
    two = two.where(F.bit_count(F.col("_signs_a").bitwiseXOR(F.col("_signs_b"))) <= sign_limit(cosine))
    two = two.select("_code", F.lit(2).cast("long").alias("_rows"), F.explode(F.array("_a", "_b")).alias("_num"))
    several = shared.where("_rows > 2").select("_code", "_rows")
    more = bands.join(small_side(several, several.count()), "_code").select("_code", "_rows", "_num")
    members = scratch.write(two.union(more), "members")
    placed = block_pairs(members, "_rows", "_num", BLOCK).join(coded.select("_num", "_n", "_vec", "_low"), "_num")
    keys = ["_code", "_lo", "_hi"]
    placed = placed.select(*keys, "_own", "_num", "_n", "_vec", "_low").repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in complete_runs(batches, 3, 1024):
            own, num, n = table["_own"].to_numpy(), table["_num"].to_numpy(), table["_n"].to_numpy()
            lo, hi = table["_lo"].to_numpy(), table["_hi"].to_numpy()
            raw = table["_vec"].to_pylist()
            codes = fixed(table["_low"], "<u4")
            label, codes = codes[:, 0], codes[:, 1:]
            which = table["_code"].to_numpy() >> below
            length = np.array(list(map(len, raw)))
            x = np.zeros((len(raw), length.max()))
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                x[mine, : size // int(kind[2])] = _unit(np.stack([np.frombuffer(raw[i], kind) for i in mine]))
            found_a, found_b = [], []

            def keep(a: np.ndarray, b: np.ndarray) -> None:
                # a block pair compares across the blocks; the first table where codes meet counts
                across = ((lo[a] == hi[a]) | (own[a] != own[b])) & (label[a] == label[b])
                a, b = a[across], b[across]
                near = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
                a, b = a[near], b[near]
                first = np.argmax(codes[a] == codes[b], axis=1) == which[a]
                found_a.append(a[first])
                found_b.append(b[first])

            for a, b in grouped_pairs(begin, np.diff(begin) <= 2 * BLOCK * 4):
                for at in range(0, len(a), 50_000):
                    keep(a[at : at + 50_000], b[at : at + 50_000])
            sizes = np.diff(begin)
            for at, m in zip(begin[:-1][sizes > 2 * BLOCK * 4].tolist(), sizes[sizes > 2 * BLOCK * 4].tolist()):
                for i in range(m - 1):  # a block much larger than planned, row by row
                    keep(np.full(m - i - 1, at + i), np.arange(at + i + 1, at + m))
            a, b = (np.concatenate(f) if f else np.zeros(0, int) for f in (found_a, found_b))
            if not len(a):
                continue
            links = np.zeros(len(n), np.int64)
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
            root = least_labels(len(n), a, b)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(num[some]), pa.array(links[some]), pa.array(num[root[some]])], names=["_num", "_links", "_root"])

    found = scratch.write(placed.mapInArrow(compare, "_num long, _links long, _root long"), "found")
    scratch.drop("members", "shared")
    names = coded.select("_num", "_rep")
    edges = found.select("_num", "_root").distinct().join(names, "_num").select(F.col("_rep").alias("a"), F.col("_root").alias("_num"))
    edges = edges.join(names, "_num").select("a", F.col("_rep").alias("b"))
    roots = components(scratch, edges)
    # classes of several labels can share their least id
    links = found.groupBy("_num").agg(F.sum("_links").alias("_links")).join(coded.select("_num", "_class"), "_num").drop("_num")
    known = classes.select("_class", "_rep", "_n").join(links, "_class", "left").join(roots, F.col("_rep") == F.col("node"), "left")
    known = scratch.write(
        known.select("_class", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("n_links"), F.coalesce("root", "_rep").alias("component_id")), "known"
    )
    # the rows of one class can be a third of all: a small side is broadcast, else Spark splits large partitions
    out = rows.select("_id", "_class").join(small_side(known, known.count()), "_class", "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "_id").alias("component_id"),
        F.col("_id").eqNullSafe(F.coalesce("component_id", "_id")).alias("kept"),
    )
