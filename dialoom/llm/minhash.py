"""Near-duplicate documents by HyperMinHash registers, banding, and a check on the full sets.

A document's set holds the 64-bit hashes of its word shingles. The hash range is cut
into buckets; of each bucket's least hash a register keeps the number of leading
zeros and ten mantissa bits. Registers are banded; documents that share a band are
candidates. The Jaccard similarity is estimated from equal registers, corrected for
chance collisions. Links are confirmed on the full sets and give components.

Equal sets are one class and are never compared with each other. Classes of a band
meet in blocks of a bounded number of rows and shingles. Both the estimate and the
check on the full sets happen inside the task that holds a block: no pair is ever a
row. What leaves a task is, of each block, the rows that still have a partner by the
estimate, then the links that join two of its groups, fewer than it has rows.

In a first round, in a band shared by few classes all pairs meet, in a larger one
each class meets leaders. In a second round, wherever a band still spans several
components, the classes outside its largest component meet all others; a pair is
let go only where its estimate is so far below the limit that chance cannot explain
it. So no link between components is lost. For b classes in a band's largest
component and s outside it, b * S + s * (S + B) rows are dealt out, where S and B
are the numbers of blocks that s and b fill: in proportion to the band while its
outsiders fit one block.

Null, empty and white-space texts have empty sets and link with nothing. Texts with
fewer words than a shingle have one, their whole sequence. Rows that share an id are
one node; a null id links with nothing and is kept. Empty tables give no rows. Very
long texts are read whole, one at a time; their sets fill blocks of their own. Pairs
exactly at the limit are links. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, components, slices, small_side
from .runs import complete_runs, fixed, led_pairs
from .words import M1, M2, word_hashes

MANTISSA = 10
BANDS = 32
EMPTY = np.uint16(0xFFFF)
#: In a band shared by at most so many classes all pairs are candidates.
SMALL = 8
#: Classes of a block in larger bands, and leaders that each of them meets there.
BLOCK, LEADERS = 256, 4
#: Classes of a block of the second round, where pairs of blocks meet; and shingles of a block of either round.
PAIR_BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Runs of the second round up to this length are compared whole.
SHORT = 64
#: A band that would deal each class to more blocks than this is divided by codes of other registers,
#: made from so many shuffles of these.
WIDE, SHUFFLES = 64, 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles: A-Z in lower case, words between ASCII white space."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist()):
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        h = hashes[end - n : end]
        width = min(size, n)
        x = h[: n - width + 1].copy()
        for k in range(1, width):
            x *= M1
            x += h[k : n - width + 1 + k]
        out.append(np.unique(_mix(x + np.uint64(width))))
    return out


def registers(hashes: np.ndarray, count: int) -> np.ndarray:
    """``count`` registers: leading zeros (6 bits) and mantissa (10 bits) of each bucket's least hash.

    Buckets are equal parts of the hash range, so a sorted set gives them in order."""
    step = np.uint64((1 << 64) // count)
    edges = np.arange(count, dtype=np.uint64) * step
    at = np.searchsorted(hashes, edges)
    end = np.append(at[1:], len(hashes))
    some = end > at
    value = (hashes[at[some]] - edges[some]) * np.uint64(count)  # uniform in 64 bits
    _, exponent = np.frexp(value.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62).astype(np.uint64)
    mantissa = (value << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = np.full(count, EMPTY)
    out[some] = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def plan(percent: int, bands: int = BANDS, miss: float = 1e-5) -> int:
    """Registers a band: as many as keep the chance to miss a pair at the limit below ``miss``."""
    j = percent / 100
    return max([1, *(r for r in range(1, 13) if (1 - j**r) ** bands < miss)])


def sub_plan(percent: int, others: int, miss: float = 1e-5) -> int:
    """Registers a code of a divided band: as many as keep the chance that a pair at the limit shares no code below ``miss``.

    Of ``others`` registers a binomial number k agrees; given k, a code agrees as a draw without replacement does."""
    k = np.arange(others + 1)
    log = np.append(0, np.cumsum(np.log(np.arange(1, others + 1))))
    j = percent / 100
    weight = np.exp(log[others] - log - log[::-1] + k * np.log(j) + (others - k) * np.log(max(1 - j, 1e-12)))
    best = 1
    for r in range(1, 13):
        agree = np.prod([np.maximum(k - i, 0) / (others - i) for i in range(r)], axis=0)
        if (weight * (1 - agree) ** (SHUFFLES * (others // r))).sum() < miss:
            best = r
    return best


def leading_zeros(sizes: np.ndarray, count: int) -> np.ndarray:
    """For sets of these sizes, how likely a register has 0, 1, 2 ... leading zeros."""
    zeros = np.arange(0, 40)[None, :]
    k = np.maximum(sizes / count, 1)[:, None]
    return np.abs((1 - 2.0 ** -(zeros + 1)) ** k - (1 - 2.0**-zeros) ** k).astype(np.float32)


def band_codes(regs: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, filled) of each row and band; a band without any filled register says nothing."""
    n, count = regs.shape
    r = count // bands
    cells = regs.reshape(n, bands, r)
    code = np.zeros((n, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * M1
    for k in range(r):
        code = _mix(code + cells[:, :, k].astype(np.uint64) * M1 + np.uint64(k + 1))
    return code, (cells != EMPTY).any(2)


def sub_codes(regs: np.ndarray, band: int, bands: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, filled) of rows that share ``band``, from the registers outside it, shuffled alike in all tasks."""
    r = regs.shape[1] // bands
    others = np.delete(regs, np.s_[band * r : (band + 1) * r], axis=1)
    groups = others.shape[1] // width
    order = [np.random.default_rng(k).permutation(others.shape[1])[: groups * width] for k in range(SHUFFLES)]
    return band_codes(others[:, np.concatenate(order)], SHUFFLES * groups)


class Estimator:
    """Decides which pairs of rows go on to the check; holds the registers of one table of rows."""

    def __init__(self, regs: np.ndarray, sizes: np.ndarray, bands: int, percent: int) -> None:
        self.regs, self.sizes, self.bands, self.percent = regs, sizes, bands, percent
        self.zeros = leading_zeros(sizes, regs.shape[1])

    def keep(self, a: np.ndarray, b: np.ndarray, band: np.ndarray, slack: bool) -> np.ndarray:
        """Which pairs share ``band`` as their first one and reach the limit by their estimate; with
        ``slack``, by an estimate that may lie four standard deviations too low.

        Of a union of u hashes the registers show some without replacement, so the
        deviation is that of such a sample; a register more or less is allowed beside it.
        """
        out = np.zeros(len(a), bool)
        for at in range(0, len(a), 8192):
            i, j = a[at : at + 8192], b[at : at + 8192]
            n, m = self.sizes[i], self.sizes[j]
            fit = np.flatnonzero(100 * np.minimum(n, m) >= self.percent * np.maximum(n, m))
            i, j, n, m = i[fit], j[fit], n[fit], m[fit]
            x, y = self.regs[i], self.regs[j]
            none = (x == EMPTY) & (y == EMPTY)
            same = x == y
            bins = x.shape[1] - none.sum(1)
            # that two different least hashes give one register: as many zeros, and the same mantissa
            chance = np.einsum("ij,ij->i", self.zeros[i], self.zeros[j]) / 2**MANTISSA
            estimate = ((same & ~none).sum(1) / bins - chance) / (1 - chance)
            limit = self.percent / 100
            if slack:
                union = np.maximum((n + m) / (1 + limit), bins + 1)
                deviation = np.sqrt(limit * (1 - limit) / bins * (1 - (bins - 1) / (union - 1)))
                limit = limit - 4 * deviation - 1 / bins - 0.005
            good = estimate >= limit
            r = x.shape[1] // self.bands
            equal = same.reshape(len(i), self.bands, r).all(2) & ~none.reshape(len(i), self.bands, r).all(2)
            good &= np.argmax(equal, 1) == band[at : at + 8192][fit]
            out[at + fit[good]] = True
        return out


def _signatures(docs: DataFrame, size: int, count: int, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(as_bytes(batch.column(1)), size)
            linked = [len(s) > 0 and i for s, i in zip(sets, batch.column(0).is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(list(map(len, sets)), pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if k else None for s, k in zip(sets, linked)], pa.binary()),
                    pa.array([registers(s, count).tobytes() if k else None for s, k in zip(sets, linked)], pa.binary()),
                ],
                names=["_id", "_n", "_class", "_regs"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"_id {kind}, _n long, _class binary, _regs binary")


def _surviving(table: pa.Table, begin: np.ndarray, leads: np.ndarray, bands: int, percent: int, second: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of a block, of a leader each, that the estimate does not refuse."""
    look = Estimator(fixed(table["_regs"], "<u2"), table["_n"].to_numpy(), bands, percent)
    band = table["_band"].to_numpy()
    if second:
        own, lo, hi = (table[c].to_numpy() for c in ("_own", "_lo", "_hi"))
        root = table["_root"].combine_chunks().dictionary_encode().indices.to_numpy()
        # all pairs of short runs, which are handled together; those of one component go below
        leads = leads | np.repeat(np.diff(begin) <= SHORT, np.diff(begin))
    found = [(np.zeros(0, np.int64),) * 2]
    for a, b in led_pairs(begin, leads, not second):
        if second:  # what is not joined yet; of two blocks, pairs across them
            apart = (root[a] != root[b]) & ((lo[a] >= hi[a]) | (own[a] != own[b]))
            a, b = a[apart], b[apart]
        ok = look.keep(a, b, band[a], second)
        found.append((a[ok], b[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def spanning_links(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int, begin: np.ndarray) -> tuple[list[int], list[int]]:
    """Links among the pairs (a, b) of rows of one block, judged on the full sets: as many as join its groups.

    A pair whose rows are joined already is not judged again."""
    size = np.array(list(map(len, sets)), np.int64)
    start = np.append(0, np.cumsum(size))
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    seen, label = np.zeros(len(values), bool), np.arange(len(sets))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    rows, first = np.unique(a, return_index=True)
    out_a: list[int] = []
    out_b: list[int] = []
    for i, at, end in zip(rows.tolist(), first.tolist(), [*first[1:].tolist(), len(a)]):
        other = b[at:end]
        other = other[label[other] != label[i]]
        if not len(other):
            continue
        mine = ids[start[i] : start[i + 1]]
        seen[mine] = True
        common = np.array([np.count_nonzero(seen[ids[start[j] : start[j + 1]]]) for j in other.tolist()])
        seen[mine] = False
        near = other[100 * common >= percent * (size[i] + size[other] - common)]
        if len(near):
            groups, which = np.unique(label[near], return_index=True)
            out_a += [i] * len(which)
            out_b += near[which].tolist()
            run = int(np.searchsorted(begin, i, "right")) - 1
            here = label[begin[run] : begin[run + 1]]
            here[np.isin(here, np.append(groups, label[i]))] = min(int(groups[0]), int(label[i]))
    return out_a, out_b


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: links where 100 * intersection >= percent * union.

    Steps are written to the shared folder as narrow tables; sets travel only for
    documents with a candidate that the estimate did not let go.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    count = bands * plan(percent, bands)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = scratch.write(_signatures(docs, shingle, count, id_col, text_col), "rows")
    # equal sets are one class; counts combine before the shuffle
    classes = rows.where(F.col("_class").isNotNull()).groupBy("_class").agg(F.min("_id").alias("_rep"), F.first("_n").alias("_n"), F.first("_regs").alias("_regs"))
    classes = scratch.write(classes, "classes")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            codes, filled = band_codes(fixed(batch.column(1), "<u2"), bands)
            who, band = np.nonzero(filled)
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes[filled].view(np.int64)), pa.array(band.astype(np.int32)), batch.column(0).take(pa.array(who)), batch.column(2).take(pa.array(who))],
                names=["_code", "_band", "_rep", "_n"],
            )

    every = classes.select("_rep", "_regs", "_n").mapInArrow(spread, f"_code long, _band int, _rep {kind}, _n long")
    shared = every.groupBy("_code").agg(F.count("*").alias("_rows"), F.min("_rep").alias("_lead"), F.sum("_n").alias("_total")).where("_rows > 1")
    members = scratch.write(every.join(shared, "_code"), "members")
    regs = classes.select("_rep", "_regs")

    def full(rows_: Column, shingles_: Column, block: int) -> Column:
        """How many blocks so many classes and shingles fill."""
        return F.greatest(F.ceil(rows_ / block), F.ceil(shingles_ / BLOCK_SHINGLES)).cast("int")

    # first round: all pairs of small bands; in blocks of large ones, leaders with all
    blocks = F.when(F.col("_rows") <= SMALL, 1).otherwise(full(F.col("_rows"), F.col("_total"), BLOCK))
    own = F.pmod(F.xxhash64("_rep"), blocks).cast("int")
    dealt = members.withColumn("_block", F.explode(F.when(F.col("_rep") == F.col("_lead"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))))
    small = (F.col("_rows") <= SMALL).alias("_leads")
    dealt = dealt.join(regs, "_rep").select("_code", "_block", "_band", "_rep", "_n", "_regs", small)
    links = _links(scratch, docs, classes, dealt, "one", ["_code", "_block"], shingle, percent, bands, id_col, text_col)
    roots = components(scratch, links, "cc1_")

    # second round: what is left between the components of one band
    known = members.join(roots, F.col("_rep") == F.col("node"), "left")
    known = scratch.write(known.select("_code", "_band", "_rep", "_n", F.coalesce("root", "_rep").alias("_root")), "known")

    def apart(rows_: DataFrame, name: str) -> DataFrame:
        """The rows of codes that several components share."""
        split = rows_.groupBy("_code").agg(F.min("_root").alias("x"), F.max("_root").alias("y")).where("x <> y").select("_code")
        return scratch.write(rows_.join(split, "_code", "left_semi"), name)

    def sizes(rows_: DataFrame) -> DataFrame:
        """Of each code: its largest component, whether several classes are outside it, and the blocks that both fill."""
        parts = rows_.groupBy("_code", "_root").agg(F.count("*").alias("k"), F.sum("_n").alias("w"))
        both = parts.groupBy("_code").agg(F.max(F.struct("k", "_root", "w")).alias("big"), F.sum("k").alias("k"), F.sum("w").alias("w"))
        outside = F.col("k") - F.col("big.k")
        return both.select(
            "_code",
            F.col("big._root").alias("_big"),
            (outside > 1).alias("_several"),
            full(outside, F.col("w") - F.col("big.w"), PAIR_BLOCK).alias("_s"),
            full(F.col("big.k"), F.col("big.w"), PAIR_BLOCK).alias("_b"),
        )

    left = apart(known, "left")
    bands_ = scratch.write(sizes(left), "bands")
    wide = scratch.write(bands_.where(F.col("_s") + F.col("_b") > WIDE).select("_code"), "wide")
    if n_wide := wide.count():
        width = sub_plan(percent, count - count // bands)

        def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1024):
                regs_, band = fixed(batch.column(5), "<u2"), batch.column(1).to_numpy()
                outer = batch.column(0).to_numpy().view(np.uint64)
                for k in np.unique(band).tolist():
                    here = np.flatnonzero(band == k)
                    codes, filled = sub_codes(regs_[here], k, bands, width)
                    who = here[np.nonzero(filled)[0]]
                    inner = _mix(codes[filled] + outer[who] * M2)
                    taken = [batch.column(c).take(pa.array(who)) for c in (1, 2, 3, 4)]
                    yield from slices(iter([pa.RecordBatch.from_arrays([pa.array(inner.view(np.int64)), *taken], names=names)]), 8192)

        names = ["_code", "_band", "_rep", "_n", "_root"]
        side = small_side(wide, n_wide)
        inside = left.join(side, "_code", "left_semi").join(regs, "_rep").select(*names, "_regs")
        inside = apart(inside.mapInArrow(divide, f"_code long, _band int, _rep {kind}, _n long, _root {kind}"), "inside")
        left = left.join(side, "_code", "left_anti").select(*names).union(inside.select(*names))
        bands_ = bands_.join(side, "_code", "left_anti").union(sizes(inside))
    left = left.join(bands_, "_code").withColumn("_leads", F.col("_root") != F.col("_big"))
    left = left.withColumn("_own", F.pmod(F.xxhash64("_rep"), F.when(F.col("_leads"), F.col("_s")).otherwise(F.col("_b"))).cast("int"))
    # blocks of outsiders meet each other (_lo <= _hi) and the blocks of the largest component (_hi < 0)
    at = lambda lo, hi: F.struct(lo.cast("int").alias("_lo"), hi.cast("int").alias("_hi"))
    mine, each = F.col("_own"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    with_others = F.transform(each("_s"), lambda k: at(F.least(mine, k), F.greatest(mine, k)))
    with_big = F.transform(each("_b"), lambda k: at(mine, -1 - k))
    of_big = F.transform(each("_s"), lambda k: at(k, -1 - mine))
    places = F.when(~F.col("_leads"), of_big).when(F.col("_several"), F.concat(with_others, with_big)).otherwise(with_big)
    left = left.withColumn("_at", F.explode(places)).join(regs, "_rep")
    left = left.select("_code", "_at._lo", "_at._hi", "_own", "_band", "_rep", "_root", "_n", "_regs", "_leads")
    more = _links(scratch, docs, classes, left, "two", ["_code", "_lo", "_hi"], shingle, percent, bands, id_col, text_col)
    joined = links.union(more).union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = components(scratch, joined, "cc2_")
    scratch.drop("known", "left", "bands", "wide", "inside", "members")

    named = classes.select("_class", "_rep").join(roots, F.col("_rep") == F.col("node")).select("_class", F.col("root").alias("_root"))
    several = rows.groupBy("_class").count().where("count > 1 and _class is not null").select("_class")
    # only classes with a link or a copy need a join; single rows are their own component
    ends = classes.select("_class", "_rep").join(several, "_class", "left_semi").join(named, "_class", "left")
    ends = ends.select("_class", F.coalesce("_root", "_rep").alias("_root")).union(named.join(several, "_class", "left_anti"))
    ends = scratch.write(ends, "ends")
    out = rows.select("_id", "_n", "_class").join(small_side(ends, ends.count()), "_class", "left")
    component = F.coalesce("_root", "_id")
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def _links(
    scratch: Scratch, docs: DataFrame, classes: DataFrame, dealt: DataFrame, name: str, keys: list[str], size: int, percent: int, bands: int, id_col: str, text_col: str
) -> DataFrame:
    """Links (a, b), confirmed on full sets, between the rows of each block; enough of them to join its groups.

    ``dealt`` has a row for each class and block. First its rows that the estimate
    leaves no partner go; the others' sets are made anew from the texts, once each, and
    sent to the blocks, where pairs are judged."""
    second = name == "two"
    kind = docs.schema[id_col].dataType.simpleString()
    schema = dealt.schema
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "_rep")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in complete_runs(batches, len(keys), 2048):
            leads = table["_leads"].to_numpy().copy()
            if not second:  # in order of id, so the same ones lead in many bands
                for k in range(LEADERS):
                    leads[np.minimum(begin[:-1] + k, begin[1:] - 1)] = True
            a, b = _surviving(table, begin, leads, bands, percent, second)
            some = np.union1d(a, b)
            if len(some):
                table = table.set_column(table.schema.get_field_index("_leads"), "_leads", pa.array(leads))
                yield from table.take(pa.array(some)).to_batches(2048)

    marked = scratch.write(dealt.mapInArrow(mark, schema), f"marked_{name}")
    wanted = scratch.write(classes.select("_rep", "_class").join(marked.select("_rep").distinct(), "_rep", "left_semi"), f"wanted_{name}")
    texts = docs.select(F.col(id_col).alias("_rep"), F.col(text_col).alias("_text")).join(small_side(wanted, wanted.count()), "_rep")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(as_bytes(batch.column(1)), size)
            right = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == c for s, c in zip(sets, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(right, pa.bool_())), pa.array([s.tobytes() for s, k in zip(sets, right) if k], pa.binary())], names=["_rep", "_set"]
            )

    # a row that repeats gives its set once
    sets = texts.select("_rep", "_text", "_class").mapInArrow(make, f"_rep {kind}, _set binary").groupBy("_rep").agg(F.first("_set").alias("_set"))
    ready = marked.join(sets, "_rep").select(*schema.names, "_set").repartition(*keys).sortWithinPartitions(*keys, "_rep")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in complete_runs(batches, len(keys), 1024):
            a, b = _surviving(table, begin, table["_leads"].to_numpy(), bands, percent, second)
            if not len(a):
                continue
            sets = [np.frombuffer(x, np.uint64) for x in table["_set"].to_pylist()]
            a, b = spanning_links(sets, a, b, percent, begin)
            who = table["_rep"].combine_chunks()
            yield pa.RecordBatch.from_arrays([who.take(pa.array(a, pa.int64())), who.take(pa.array(b, pa.int64()))], names=["a", "b"])

    links = scratch.write(ready.mapInArrow(judge, f"a {kind}, b {kind}"), f"links_{name}")
    scratch.drop(f"marked_{name}", f"wanted_{name}")
    return links


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: the one with the smallest id. Rows without a set or id are all kept;
    of rows that repeat the kept id, one stays."""
    found = near_duplicates(docs, shingle, percent, id_col=id_col, text_col=text_col)
    gone = found.where("not kept").select(id_col).distinct()
    gone = Scratch(docs.sparkSession, "gone").write(gone, "ids")
    left = docs.join(small_side(gone, gone.count()), id_col, "left_anti").select(*docs.columns)
    twice = found.where("kept and n_shingles > 0").groupBy(id_col).count().where(F.col("count") > 1).select(id_col)
    twice = Scratch(docs.sparkSession, "twice").write(twice.where(F.col(id_col).isNotNull()), "ids")
    if not twice.head(1):
        return left
    same = small_side(twice, twice.count())
    once = left.join(same, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns)
    return left.join(same, id_col, "left_anti").select(*docs.columns).union(once)


__all__ = ["drop_near_duplicates", "near_duplicates", "plan", "registers", "shingle_sets", "spanning_links"]
