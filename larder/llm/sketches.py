"""Bottom-k fingerprints of texts: the k smallest hashes of their five-word shingles."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.textblocks import U64, Words, mix, text_blocks

#: Hashes of a fingerprint; a likeness has a standard error of at most 0.5 / sqrt(K) = 0.044.
K = 128
WIDTH = 5
#: Bytes kept of each hash.
BYTES = 6
_TOP = float(1 << 8 * BYTES)


class Sketch:
    """The k smallest distinct 48-bit shingle hashes of a text, in order. Under k of them: all there are."""

    __slots__ = ("hashes", "k")

    def __init__(self, hashes: np.ndarray, k: int = K):
        self.hashes, self.k = np.unique(hashes)[:k], k

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both shingle sets together, as if made from both texts' shingles."""
        return Sketch(np.concatenate([self.hashes, other.hashes]), min(self.k, other.k))

    def distinct(self) -> float:
        """Estimated number of distinct shingles; exact below k."""
        if len(self.hashes) < self.k:
            return float(len(self.hashes))
        return (self.k - 1) * _TOP / float(self.hashes[-1])

    def resemblance(self, other: Sketch) -> float:
        """Share of common shingles among all: of the k smallest of both, those in both. Two empty sets are alike."""
        both = np.union1d(self.hashes, other.hashes)[: min(self.k, other.k)]
        if not len(both):
            return 1.0
        return len(np.intersect1d(np.intersect1d(both, self.hashes, True), other.hashes, True)) / len(both)

    def containment(self, other: Sketch) -> float:
        """Estimated share of this text's shingles that the other holds."""
        own = self.distinct()
        if not own:
            return 1.0
        return min(1.0, self.resemblance(other) * self.merge(other).distinct() / own)

    def text(self) -> str:
        """The fingerprint as a string: its hashes in base64, big-endian."""
        data = self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :]
        return base64.b64encode(data.tobytes()).decode()

    @classmethod
    def parse(cls, text: str, k: int = K) -> Sketch:
        data = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BYTES)
        wide = np.zeros((len(data), 8), np.uint8)
        wide[:, 8 - BYTES :] = data
        out = cls.__new__(cls)
        out.hashes, out.k = wide.view(">u8").reshape(-1).astype(np.uint64), k
        return out


def sketches(texts: pa.Array, k: int = K) -> list[Sketch]:
    """A sketch of every text; words are parted by white space, letters A-Z folded."""
    out = []
    for first, end, data, starts in text_blocks(texts):
        hashes, bounds = Words(data, starts).shingles(WIDTH)
        hashes = mix(hashes) >> U64(64 - 8 * BYTES)
        out.extend(Sketch(hashes[bounds[i] : bounds[i + 1]], k) for i in range(end - first))
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", k: int = K) -> DataFrame:
    """`docs` plus `fingerprint` and `n_distinct` (estimated). A null or empty text has the empty fingerprint.

    A column of `docs` with one of these names is replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("fingerprint", "n_distinct")])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = sketches(batch.column(text_col), k)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([s.text() for s in made], pa.string()), pa.array([s.distinct() for s in made], pa.float64())],
                [*batch.schema.names, "fingerprint", "n_distinct"])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(add, f"{schema}, fingerprint string, n_distinct double")


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(part, ahead, doc_id, text) dealt out so that each part is a range of ids and ends with the next range's first row.

    Ranges begin at ids of `docs` near the quantiles; only these few ids come to the driver. The rows of a part lie in one
    partition, in order of (ahead, doc_id, text); the row with `ahead` is the one after its last. The last range is
    followed by the first row of all.
    """
    docs = docs.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")))
    lows = docs.select("key").agg(
        F.percentile_approx("key", [i / parts for i in range(parts)], 100 * parts).alias("q"), F.min("key").alias("low")).first()
    lows = sorted({*(lows["q"] or []), lows["low"]} - {None})
    table = docs.withColumn("part", _search(lows))
    first = table.where(F.col("key").isin(lows)).groupBy("part", "key").agg(F.min_by("doc_id", "text").alias("doc_id"), F.min("text").alias("text"))
    first = first.select(F.pmod(F.col("part") - 1, F.lit(max(1, len(lows)))).alias("part"), F.lit(1).alias("ahead"), "key", "doc_id", "text")
    rows = table.select("part", F.lit(0).alias("ahead"), "key", "doc_id", "text").unionByName(first)
    return rows.repartition(parts, "part").sortWithinPartitions("part", "ahead", "key", "text").drop("key")


def _search(lows: list[int]) -> Column:
    """Index of the last of `lows` that is not above the key, as nested comparisons."""

    def between(low: int, high: int) -> Column:
        if high - low <= 1:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("key") < F.lit(lows[middle]), between(low, middle)).otherwise(between(middle, high))

    return between(0, max(1, len(lows)))


def _edited(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Results of the rows whose next row follows in the stream; `ahead` rows serve as next alone."""
    part, last = None, None
    for batch in batches:
        pairs: list[tuple] = []
        for p, ahead, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "ahead", "doc_id", "text")), strict=True):
            text = text or ""
            if part == p and last is not None:
                pairs.append((*last, text))
            part, last = p, None if ahead else (doc_id, text)
        for at in range(0, len(pairs), 500):
            ids, texts, after = zip(*pairs[at : at + 500], strict=True)
            changed = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after, strict=True)]
            own, edit, next_ = (sketches(pa.array(x, pa.large_string()), k) for x in (texts, changed, after))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column("doc_id").type), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                 pa.array([s.text() for s in own], pa.string()), pa.array([s.text() for s in edit], pa.string()),
                 pa.array([a.resemblance(b) for a, b in zip(own, edit, strict=True)], pa.float64()),
                 pa.array([a.resemblance(b) for a, b in zip(own, next_, strict=True)], pa.float64())],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprint every text, and its edited text, whose last half is replaced by the next document's beginning.

    The last floor(n / 2) of n code points give way to the first as many, or all, of the next document in order of ids
    (of texts where ids repeat); the first document follows the last. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next (resemblances to the edited and to the next text).

    A null text is empty; two empty texts have a likeness of 1, an empty and another 0. A null id stands first.
    Repeated rows follow one another. One row is its own next. Extra columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = (f"doc_id {dict(docs.dtypes)['doc_id']}, n_chars long, edited_sha256 string, fingerprint string,"
              " edited_fingerprint string, near_edited double, near_next double")
    return with_next(docs, parts).mapInArrow(lambda batches: _edited(batches, k), schema)
