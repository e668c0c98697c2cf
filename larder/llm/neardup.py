"""Near-duplicate grouping of documents: SuperMinHash, banding, verification on full sets, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.components import components, handy, keep, only
from larder.llm.signatures import band_keys, superminhash
from larder.llm.textblocks import U64, Words, mix, text_blocks

#: Words of a shingle.
WIDTH = 5
#: Bands and signature slots of a band. Two sets of similarity 0.85 agree in no band once in 2.5 million
#: pairs ((1 - 0.85 ** 4) ** 20 = 3.9e-7).
BANDS, ROWS = 20, 4
#: 64-bit words of the parity sketch.
SKETCH = 32


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _set_hash(shingles: np.ndarray) -> int:
    """Hash of a sorted set of shingles, independent of its text's order."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(shingles).sum(dtype=np.uint64) + U64(len(shingles))], np.uint64)).view(np.int64)[0])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: doc_id, text_key, set (hash of its shingle set), size, band keys, parity sketch."""
    for batch in batches:
        for first, end, data, starts in text_blocks(batch.column("text")):
            hashes, bounds = Words(data, starts).shingles(WIDTH)
            keys = band_keys(superminhash(hashes, bounds, BANDS * ROWS), BANDS)
            sizes, names = np.zeros(end - first, np.int64), np.zeros(end - first, np.int64)
            sketch = np.zeros((end - first, SKETCH), np.uint64)
            for row in range(end - first):
                shingles = np.unique(hashes[bounds[row] : bounds[row + 1]])
                sizes[row], names[row] = len(shingles), _set_hash(shingles)
                bits = np.bincount((shingles & U64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
                sketch[row] = np.packbits(bits.astype(np.uint8)).view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, end - first), batch.column("text_key").slice(first, end - first),
                    pa.array(names), pa.array(sizes),
                    pa.ListArray.from_arrays(np.arange(end - first + 1, dtype=np.int32) * BANDS, _long(keys.reshape(-1))),
                    pa.ListArray.from_arrays(np.arange(end - first + 1, dtype=np.int32) * SKETCH, _long(sketch.reshape(-1))),
                ],
                ["doc_id", "text_key", "set", "size", "bands", "sketch"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, shingles) of the rows whose text really has the set asked for."""
    for batch in batches:
        wanted = batch.column("set").to_pylist()
        for first, end, data, starts in text_blocks(batch.column("text")):
            hashes, bounds = Words(data, starts).shingles(WIDTH)
            names, sets = [], []
            for row in range(end - first):
                shingles = np.unique(hashes[bounds[row] : bounds[row + 1]])
                if _set_hash(shingles) == wanted[first + row]:
                    names.append(wanted[first + row])
                    sets.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["set", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets are similar enough."""
    for batch in batches:
        good = []
        for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
            left, right = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
            both = len(left) + len(right) - len(np.union1d(left, right))
            good.append(100 * both >= percent * (len(left) + len(right) - both))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _apart(percent: int) -> str:
    """SQL: may these two sets be similar enough, judged by sizes and parity sketches?

    A set's sketch toggles one bit per element, so two sketches differ in no more bits than the sets
    have elements not in common, and similarity s allows (1 - s) / (1 + s) * (size + size) of those.
    The test passes every pair that is similar enough.
    """
    bits = " + ".join(f"bit_count(l.sketch[{i}] ^ r.sketch[{i}])" for i in range(SKETCH))
    sizes = f"100 * least(l.size, r.size) >= {percent} * greatest(l.size, r.size)"
    return f"{sizes} and {100 + percent} * ({bits}) <= {100 - percent} * (l.size + r.size)"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, by_row: bool = False) -> DataFrame:
    """Group documents whose sets of five-word shingles have a similarity of `percent` / 100 or more.

    Returns one row per row of `docs`: doc_id, n_shingles, component_id (the smallest id of its group),
    kept (doc_id = component_id). Rows with equal sets are represented by one set from the start,
    so copies are never paired. Bands of SuperMinHash signatures give buckets; every member of a
    bucket meets the bucket's smallest member first. After these links are grouped, only buckets that
    still hold several groups are looked at again, and only pairs of different groups that pass the
    exact size and parity-sketch test (`_apart`) leave that join. Every link is confirmed on full sets.

    Null and empty texts and texts of white space have no shingle and are linked with nothing. Rows that
    repeat an id are separate rows with that id. A null id takes part and is never the smallest of a
    group that has another. Extra columns are ignored.

    With `by_row` two columns more: text_key (xxhash64 of the text), which tells rows of one id apart, and root, which
    names the group (null without a shingle). Groups of different texts with one id share a component_id, but never a root.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    with only("sets", "named-sets"):
        kinds = "doc_id long, text_key long, set long, size long, bands array<long>, sketch array<long>"
        described = keep(docs.mapInArrow(_describe, kinds), "sets")
        named = keep(_named_sets(docs, described, percent), "named-sets")
    extra = ["text_key", "root"] if by_row else []
    out = described.select("doc_id", "set", F.col("size").alias("n_shingles"), *extra[:1])
    out = out.join(named.select("set", "component_id", *extra[1:]), "set", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *extra)


def _named_sets(docs: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """(set, component_id, root) for every distinct set that is not empty."""
    sets = keep(
        described.where("size > 0").groupBy("set", "size").agg(
            F.min(F.struct("doc_id", "text_key")).alias("of"), F.min("doc_id").alias("doc_id"),
            F.min_by("bands", "set").alias("bands"), F.min_by("sketch", "set").alias("sketch")
        ),
        "distinct-sets",
    )
    buckets = sets.select(F.explode("bands").alias("bucket"), "set")
    leaders = buckets.groupBy("bucket").agg(F.min("set").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = keep(buckets.join(leaders, "bucket").select("bucket", "set", "leader"), "buckets")

    # One text of each set, told by id and text: rows that share an id, or have none, don't multiply.
    wanted = sets.join(members.select("set").distinct(), "set", "left_semi").select("set", "of.doc_id", "of.text_key")
    wanted = handy(keep(wanted, "wanted"))
    full = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["text_key"] == wanted["text_key"])).select("set", "text")
    full = keep(full.mapInArrow(_full_sets, "set long, shingles binary").dropDuplicates(["set"]), "full-sets")

    slim = sets.select("set", "size", "sketch")
    first = members.where("set <> leader").select(F.col("leader").alias("a"), F.col("set").alias("b")).distinct()
    first = (
        first.join(slim.alias("l"), F.col("a") == F.col("l.set")).join(slim.alias("r"), F.col("b") == F.col("r.set"))
        .where(_apart(percent)).select("a", "b")
    )
    links = keep(_verify(first, full, percent), "links-to-leaders")
    grouped = components(links)

    placed = members.join(grouped, members["set"] == grouped["node"], "left").select(
        "bucket", "set", F.coalesce("root", "set").alias("group"))
    mixed = placed.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
    rows = keep(placed.join(mixed.select("bucket"), "bucket").join(slim, "set"), "mixed-buckets")
    across = (
        rows.alias("l").join(rows.alias("r"), F.expr(
            f"l.bucket = r.bucket and l.set < r.set and l.group <> r.group and {_apart(percent)}"))
        .select(F.col("l.set").alias("a"), F.col("r.set").alias("b")).distinct()
    )
    more = keep(_verify(across, full, percent), "links-across")
    roots = components(links.unionByName(more))

    named = sets.join(roots, sets["set"] == roots["node"], "left").select(
        "set", "doc_id", F.coalesce("root", "set").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root").select("set", "component_id", "root")


def _verify(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that are similar on their full shingle sets."""
    with_sets = (
        pairs.join(full.select(F.col("set").alias("a"), F.col("shingles").alias("left")), "a")
        .join(full.select(F.col("set").alias("b"), F.col("shingles").alias("right")), "b")
    )
    return with_sets.select("a", "b", "left", "right").mapInArrow(lambda batches: _linked(batches, percent), "a long, b long")
