"""Language identification by nearest centroid.

A text's vector: its character trigrams (bytes of the lower-cased text, letters
only, words kept apart), hashed to a fixed number of places, square roots of
counts times inverse document frequency, length one. Each language has several
centroids, clustered from a bounded sample of labelled rows; the nearest centroid
by cosine decides. A text is rejected if it has no letter, or if its cosine is
below half of the smallest that any training row has with its own language.

Null texts and texts without a letter: ``und``, score 0, rejected. Very long texts
are read whole. Rows whose label is null are not learned from; without any
labelled text every prediction is ``und``. Equal rows (id and text) are learned from
once, however often they occur; rows that share an id only are rows of their own, and
an id may be null. Of equal cosines the first centroid wins, by label, then by cluster.
Other columns are not read, or kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

#: Places that trigrams are hashed to.
PLACES = 8192
#: At most so many labelled rows are learned from, split evenly over the languages.
MAX_TRAINING_ROWS = 4096
CENTROIDS = 4
NO_LANGUAGE = "und"

#: Bytes by symbol: letters a to z, bytes beyond ASCII, and 0 for all else.
SYMBOLS = np.zeros(256, np.uint32)
SYMBOLS[97:123] = np.arange(1, 27)
SYMBOLS[128:] = np.arange(27, 155)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """The counts of a text's hashed trigrams. Trigrams inside runs of other characters do not count."""
    s = SYMBOLS[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    a, b, c = s[:-2], s[1:-1], s[2:]
    codes = ((a * 24317 + b) * 24317 + c) * np.uint32(2654435769) >> np.uint32(19)
    return np.bincount(codes[b > 0], minlength=PLACES)


def _cluster(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, begun with the row that is farthest from the centroids so far."""
    centre = rows.mean(0)
    chosen = [int(np.argmax(rows @ centre))]
    nearest = rows @ rows[chosen[0]]
    while len(chosen) < min(k, len(rows)):
        # typical outliers, not the most extreme one
        chosen.append(int(np.argsort(nearest)[len(nearest) // 20]))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centroids = rows[chosen]
    for _ in range(rounds):
        own = np.argmax(rows @ centroids.T, 1)
        sums = np.stack([rows[own == j].sum(0) if (own == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


class LanguageModel:
    """``idf``, ``centroids`` (a row each), ``labels`` (of the rows) and the least cosine that is accepted."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, labels: list[str], least: float) -> None:
        self.idf, self.centroids, self.labels, self.least = idf.astype(np.float32), centroids.astype(np.float32), labels, least

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        v = np.sqrt(rows.astype(np.float32)) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        known = [k for k, t in enumerate(texts) if t and self.labels and has_letter(t)]
        out = [(NO_LANGUAGE, 0.0, True)] * len(texts)
        for at in range(0, len(known), 64):
            some = known[at : at + 64]
            cosines = self.vectors(np.stack([counts(texts[k]) for k in some])) @ self.centroids.T
            best = np.argmax(cosines, 1)
            for k, j, row in zip(some, best.tolist(), cosines):
                score = min(1.0, max(0.0, float(row[j])))
                out[k] = (self.labels[j], score, score < self.least)
        return out


def fit(docs: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_rows: int = MAX_TRAINING_ROWS) -> LanguageModel:
    """Learns from at most ``max_rows`` labelled rows for which ``train`` holds, an equal share for each language
    but at least one; so more labels than ``max_rows`` are refused.

    Each language gives its distinct rows with the least hashes of id and text, so the
    same input always gives the same model. Trigrams are counted on the executors; the
    driver gets at most ``PLACES`` counts for each drawn row.
    """
    text, label = F.col(text_col).cast("string"), F.col(label_col).cast("string")
    drawn_by = F.xxhash64(F.lit("language"), F.col(id_col), text)
    labelled = docs.where(train & label.isNotNull() & text.rlike("\\p{L}")).select(label.alias("label"), drawn_by.alias("hash"), text.alias("text"))
    # about how many distinct rows each language has
    n = labelled.groupBy("label").agg(F.approx_count_distinct("hash", 0.02).alias("n")).limit(max_rows + 1).collect()
    if len(n) > max_rows:
        raise ValueError(f"more than {max_rows} labels")
    if not n:
        return LanguageModel(np.ones(PLACES), np.zeros((0, PLACES)), [], 0.0)
    each = max_rows // len(n)
    # somewhat more than each language's share, so that it is reached; languages with few rows give all
    chances = [(r.label, min(1.0, (1.5 * each + 50) / r.n) * 2.0**64 - 2.0**63) for r in n]
    chances = F.broadcast(docs.sparkSession.createDataFrame(chances, "label string, below double"))
    drawn = labelled.join(chances, "label").where(F.col("hash").cast("double") <= F.col("below"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple] = set()
        for batch in slices(batches):
            labels, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for k, key in enumerate(zip(labels, hashes)):
                if key not in done and has_letter(t := batch.column(2)[k].as_py()):
                    keep.append((*key, counts(t)))
                    done.add(key)
            filled = [np.flatnonzero(c) for *_, c in keep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in keep], pa.string()),
                    pa.array([x[1] for x in keep], pa.int64()),
                    pa.array([f.astype("<u2").tobytes() for f in filled], pa.binary()),
                    pa.array([c[f].astype("<f4").tobytes() for (*_, c), f in zip(keep, filled)], pa.binary()),
                ],
                names=["label", "hash", "places", "counts"],
            )

    rows = drawn.select("label", "hash", "text").mapInArrow(run, "label string, hash long, places binary, counts binary").dropDuplicates(["label", "hash"])
    least = Window.partitionBy("label").orderBy("hash")
    table = rows.withColumn("_k", F.row_number().over(least)).where(F.col("_k") <= each).drop("_k").toArrow()
    labels = np.array(table["label"].to_pylist(), object)
    places = [np.frombuffer(b, "<u2") for b in table["places"].to_pylist()]
    values = [np.frombuffer(b, "<f4") for b in table["counts"].to_pylist()]
    if not len(labels):
        return LanguageModel(np.ones(PLACES), np.zeros((0, PLACES)), [], 0.0)
    frequency = np.zeros(PLACES)
    for p in places:
        frequency[p] += 1
    idf = np.log((1 + len(labels)) / (1 + frequency)) + 1
    blank, centroids, names, accepted = LanguageModel(idf, np.zeros((0, PLACES)), [], 0.0), [], [], 1.0
    for name in sorted(set(labels.tolist())):
        # the rows in an order that does not depend on the partitions
        mine = sorted(np.flatnonzero(labels == name).tolist(), key=lambda k: (places[k].tobytes(), values[k].tobytes()))
        dense = np.zeros((len(mine), PLACES), np.float32)
        for row, k in zip(dense, mine):
            row[places[k]] = values[k]
        dense = blank.vectors(dense)
        own = _cluster(dense, CENTROIDS)
        accepted = min(accepted, float((dense @ own.T).max(1).min()))
        centroids.append(own)
        names += [name] * len(own)
    return LanguageModel(idf, np.concatenate(centroids), names, accepted / 2)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for each row; no shuffle. The model has a fixed size."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = shipped.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())],
                names=names,
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with their columns. Only the text goes to Python, and only a flag comes back."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out: list[bool] = []
            for part in slices([pa.RecordBatch.from_arrays([column], names=["text"])]):
                out += [not x[2] for x in shipped.value.predict(part.column(0).to_pylist())]
            yield pa.array(out, pa.bool_())

    return docs.where(known(F.col(text_col).cast("string")))
