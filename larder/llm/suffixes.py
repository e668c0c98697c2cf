"""Removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

A suffix array over every byte of a corpus would be many times its size, so the arrays here are
sparse: of the starts inside each `LENGTH`-byte string, the suffix that begins with the
string's smallest `GRAM`-byte gram by hash is kept. Equal strings keep the same suffix, so no repeat
is missed. A suffix stands for the run of `LENGTH`-byte strings that chose it, which lie around it;
an entry holds its first eight bytes (`lead`, the order of the array), the hash of its gram (`gram`),
and the hash of all bytes of its run (`whole`). About one suffix in 137 bytes is kept.

Batches of documents get such arrays, each a table sorted and bucketed by gram. A batch is merge-scanned
against every existing level for suffixes in common, then becomes a level; two levels of one size are
merged into one of twice the size. All these joins meet bucket by bucket without a shuffle.

Runs that occur twice as a whole are repeated in full. A run whose suffix is shared but whose whole is
not is compared string by string with the other runs of that suffix; only such runs carry bytes through a
shuffle.

The same arrays also run over words instead of bytes: a string is then `WORDS` words, told apart by their hashes, whatever white
space is between them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.components import forget, keep, tidy
from larder.llm.textblocks import U64, Words, hash_spans, mix, prefix_sums, text_blocks, value_sums
from larder.sources import scratch

#: A string of this many bytes that starts twice is removed.
LENGTH = 400
#: Bytes of a suffix that choose and name it.
GRAM = 128
#: A passage: a string of more than 50 words that starts twice.
WORDS = 51
#: Runs of one suffix that a task compares at once; suffixes with more go block by block through a shuffle.
TOGETHER = 1024
#: Strings in a block of such a run, from coarse to fine.
BLOCKS = (64, 8, 1)
#: Bits of a place in a text.
PLACE = U64(31)

ORDER = ["lead", "gram", "whole"]
_ENTRY = "row long, low int, one int, high int, n int, lead long, gram long, whole long"
_CO_LOCATED = "spark.sql.requireAllClusterKeysForCoPartition"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of `width` values."""
    padded = np.concatenate([values, np.full(-len(values) % width, ~U64(0))]).reshape(-1, width)
    before = np.minimum.accumulate(padded, axis=1).reshape(-1)
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = len(values) - width + 1
    return np.minimum(after[:windows], before[width - 1 : width - 1 + windows])


class Bytes:
    """Texts as strings of bytes."""

    @staticmethod
    def units(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(units of a block, sums that give the hash of any span of them, bounds of the texts)."""
        return data, prefix_sums(data), starts

    @staticmethod
    def stored(text: bytes) -> bytes:
        return text

    @staticmethod
    def read(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(units, sums) of what `stored` wrote, or of a whole number of units of it."""
        found = np.frombuffer(data, np.uint8)
        return found, prefix_sums(found)

    @staticmethod
    def lead(units: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The eight bytes from each place as a number whose order is that of the bytes."""
        out = np.zeros(len(places), np.uint64)
        for i in range(8):
            out = (out << U64(8)) | units[places + i].astype(np.uint64)
        return (out ^ U64(1 << 63)).view(np.int64)

    size = 1

    @staticmethod
    def spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        return spans


class WordRuns:
    """Texts as strings of words, A-Z in lower case, by their hashes."""

    @staticmethod
    def units(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = Words(data, starts)
        hashes = words.hashes()
        return hashes, value_sums(hashes), words.bounds

    @staticmethod
    def stored(text: bytes) -> bytes:
        data = np.frombuffer(text, np.uint8)
        return Words(data, np.array([0, len(data)])).hashes().tobytes()

    @staticmethod
    def read(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        found = np.frombuffer(data, np.uint64)
        return found, value_sums(found)

    @staticmethod
    def lead(units: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The first word's hash."""
        return units[places].view(np.int64)

    size = 8

    @staticmethod
    def spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Spans of words as spans of bytes, from the first word's begin to the last one's end."""
        data = np.frombuffer(text, np.uint8)
        words = Words(data, np.array([0, len(data)]))
        return [(int(words.begins[a]), int(words.ends[b - 1])) for a, b in spans]


Units = type[Bytes] | type[WordRuns]


def _suffixes(batches: Iterator[pa.RecordBatch], units: Units, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The kept suffixes of each text, with the run of string starts low..high that chose them.

    Where one suffix and run follow themselves, as in a text that repeats a short period, n of them are one entry; low..one
    is then the first of them.
    """
    width = length - gram + 1
    mask = (U64(1) << PLACE) - U64(1)
    for batch in batches:
        rows = batch.column("row").to_numpy()
        for first, end, data, starts in text_blocks(batch.column("text")):
            data, sums, starts = units.units(data, starts)
            found = []
            for i in np.flatnonzero(np.diff(starts) >= length):
                low, high = starts[i], starts[i + 1]
                places = np.arange(low, high - gram + 1)
                grams = hash_spans(sums, places, places + gram)
                # The smallest hash, the first place among equals: one number that says both.
                least = _least(((grams >> PLACE) << PLACE) | (places - low).astype(np.uint64), width)
                change = np.flatnonzero(least[1:] != least[:-1]) + 1
                begin = np.concatenate([[0], change])
                until = np.concatenate([change - 1, [len(least) - 1]])
                at = (least[begin] & mask).astype(np.int64)
                with np.errstate(over="ignore"):  # the same bytes are the same run only around the same place
                    whole = mix(hash_spans(sums, low + begin, low + until + length) + (at - begin).astype(np.uint64))
                name = grams[at]
                own = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (whole[1:] != whole[:-1])]))
                count = np.diff(np.concatenate([own, [len(at)]]))
                found.append((np.full(len(own), rows[first + i]), begin[own], until[own], until[own + count - 1], count,
                              units.lead(data, low + at[own]), name[own], whole[own]))
            if found:
                row, begin, one, until, count, lead, name, whole = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row), *(pa.array(x.astype(np.int32)) for x in (begin, one, until, count)),
                     pa.array(lead), pa.array(name.view(np.int64)), pa.array(whole.view(np.int64))],
                    ["row", "low", "one", "high", "n", "lead", "gram", "whole"])


class SuffixIndex:
    """Levels of merged suffix arrays; a level holds each distinct run once, with its number of occurrences.

    All tables are bucketed by gram into the same number of buckets, so merging and scanning join bucket with bucket.
    """

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.levels: dict[int, list[DataFrame]] = {}
        self.tables: dict[DataFrame, tuple[str, str]] = {}
        self.hits: list[DataFrame] = []

    def table(self, df: DataFrame, name: str, partitions: str | None = None) -> DataFrame:
        """`df`, already dealt out by gram, as a bucketed and sorted table."""
        name = f"larder_{name}_{uuid.uuid4().hex}"
        path = scratch.new_dir(self.spark, name)
        writer = df.write.option("path", path).bucketBy(self.buckets, "gram").sortBy(*ORDER)
        (writer.partitionBy(partitions) if partitions else writer).saveAsTable(name)
        table = self.spark.table(name)
        self.tables[table] = (name, path)
        return table

    def insert(self, batch: DataFrame) -> None:
        """Scan a batch's suffix array with itself and every level, note what it shares, and make it a level.

        Levels of one size, left by the batch before, are merged first.
        """
        for size in sorted(self.levels):
            if len(same := self.levels[size]) == 2:
                older = same[1].withColumnRenamed("n", "more")
                merged = same[0].join(older, ORDER, "full").select(
                    *ORDER, (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
                self.levels[size] = []
                self.levels.setdefault(size + 1, []).append(self.table(merged, "level"))
                self.drop(*same)
        run = self.table(batch.groupBy(*ORDER).agg(F.sum("n").alias("n")), "run")
        own = run.groupBy("lead", "gram").agg((F.sum("n") > 1).alias("shared"))
        scan = run.join(own, ["lead", "gram"]).withColumn("again", F.col("n") > 1)
        for level in [x for same in self.levels.values() for x in same]:
            grams = level.select("lead", "gram").distinct().withColumn("_gram", F.lit(True))
            wholes = level.select(*ORDER, F.lit(True).alias("_whole"))
            scan = scan.join(grams, ["lead", "gram"], "left").join(wholes, ORDER, "left")
            scan = scan.withColumn("shared", F.col("shared") | F.col("_gram").isNotNull())
            scan = scan.withColumn("again", F.col("again") | F.col("_whole").isNotNull()).drop("_gram", "_whole")
        self.hits.append(keep(scan.where("shared").select(*ORDER, "again"), "shared"))
        self.levels.setdefault(0, []).append(run)

    def shared(self) -> tuple[DataFrame, DataFrame]:
        """(suffixes that occur twice, runs that occur twice as a whole), over all batches."""
        hits = self.hits[0]
        for more in self.hits[1:]:
            hits = hits.unionByName(more)
        return hits.select("lead", "gram").distinct(), hits.where("again").select(*ORDER).distinct()

    def drop(self, *tables: DataFrame) -> None:
        """Delete some tables, or all that are left."""
        for table in tables or list(self.tables):
            name, path = self.tables.pop(table)
            self.spark.sql(f"drop table if exists {name}")
            scratch.remove(self.spark, path)


@contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """Inside, tables bucketed by one of a join's keys are joined without a shuffle."""
    before = spark.conf.get(_CO_LOCATED, "true")
    spark.conf.set(_CO_LOCATED, "false")
    try:
        yield
    finally:
        spark.conf.set(_CO_LOCATED, before)


def repeated_spans(texts: DataFrame, length: int = LENGTH, batches: int = 4, together: int = TOGETHER, units: Units = Bytes) -> DataFrame:
    """(row, spans) for the rows (row, text) with repeats: the spans, in units, covered by a repeated string of `length` units.

    Spans may touch or overlap and are in no order. The rows are inserted in `batches` batches. What the result reads is
    one table, which `forget` deletes.
    """
    gram = min(GRAM, max(8, length // 3))
    spark = texts.sparkSession
    index = SuffixIndex(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    entries = texts.mapInArrow(lambda parts: _suffixes(parts, units, length, gram), _ENTRY)
    entries = entries.withColumn("batch", F.pmod("row", F.lit(batches)).cast("int")).repartition(index.buckets, "gram")
    try:
        with co_located(spark), tidy(spark):
            entries = index.table(entries, "suffixes", "batch")
            for number in range(batches):
                index.insert(entries.where(F.col("batch") == number))
            grams, wholes = index.shared()
            marked = keep(
                entries.join(grams, ["lead", "gram"], "left_semi")
                .join(wholes.withColumn("again", F.lit(True)), ORDER, "left")
                .select("row", "low", "one", "high", *ORDER, F.coalesce("again", F.lit(False)).alias("again")),
                "shared-suffixes",
            )
    finally:
        index.drop()
        forget(*index.hits)

    sure = marked.where("again").select("row", F.col("low").alias("begin"), (F.col("high") + length).alias("end"))
    distinct = marked.groupBy(*ORDER).agg(
        F.min(F.struct("row", "low", "one")).alias("first"), F.max("again").alias("again"))
    several = distinct.groupBy("lead", "gram").agg(
        F.count("*").alias("members"), F.min("again").alias("all_again")).where("members > 1 and not all_again")
    several = several.select("lead", "gram", (F.col("members") > together).alias("large"))
    cut = F.struct("first.low", "first.one", "lead", "gram", "again", "large")
    cuts = distinct.join(several, ["lead", "gram"]).groupBy("first.row").agg(F.collect_list(cut).alias("cuts"))
    runs = keep(
        texts.join(cuts, "row").select("row", "text", "cuts").dropDuplicates(["row"]).mapInArrow(
            lambda parts: _cut(parts, units, length),
            "row long, low int, lead long, gram long, again boolean, large boolean, bytes binary"),
        "runs",
    )
    small = runs.where("not large").repartition("gram").sortWithinPartitions("gram")
    small = small.mapInArrow(lambda parts: _compare(parts, units, length), "row long, begin int, end int")
    large, parts = _large(runs.where("large"), units, length, gram)
    spans = sure.unionByName(small)
    for found in large:
        spans = spans.unionByName(found)
    spans = spans.distinct()
    spans = keep(spans.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "spans")
    forget(marked, runs, *parts)
    return spans


def _large(runs: DataFrame, units: Units, length: int, gram: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(spans of the strings that runs of one suffix share, tables they read), without bringing the runs of a suffix together.

    Runs are parted into blocks of neighbouring strings, by how far before the suffix a string starts. Two blocks share
    strings only if they agree in what all strings of the block cover (`core`), and all of them if they are equal (`whole`). So
    only blocks that agree in the one and not in the other are parted further, down to single strings.
    """
    large: list[DataFrame] = []
    tables: list[DataFrame] = []
    if runs.isEmpty():
        return large, tables
    blocks = runs.select("row", "low", "gram", "again", "bytes")
    for size in [n for n in BLOCKS if n < length - gram + 1]:
        parted = keep(blocks.mapInArrow(
            lambda parts, size=size: _parted(parts, units, length, gram, size),
            "row long, low int, n int, core long, whole long, gram long, again boolean, bytes binary"), "blocks")
        tables.append(parted)
        equal = parted.groupBy("core", "whole").agg((F.count("*") > 1).alias("twice"), F.max("again").alias("again"))
        large.append(parted.where("not again").join(equal.where("twice").select("core", "whole"), ["core", "whole"], "left_semi").select(
            "row", F.col("low").alias("begin"), (F.col("low") + F.col("n") - 1 + length).alias("end")))
        # One block stands for its equals: those need no answer any more, others may share strings with them.
        settled = F.col("twice") | F.col("again")
        mixed = equal.groupBy("core").agg(F.count("*").alias("kinds"), F.min(settled).alias("all")).where("kinds > 1 and not all").select("core")
        kinds = parted.groupBy("core", "whole").agg(
            (F.max("again") | (F.count("*") > 1)).alias("again"), F.first(F.struct("row", "low", "gram", "bytes")).alias("one"))
        blocks = kinds.join(mixed, "core", "left_semi").select("one.row", "one.low", "one.gram", "again", "one.bytes")
    return large, tables


def _parted(batches: Iterator[pa.RecordBatch], units: Units, length: int, gram: int, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to `size` strings of each run; single strings come without their units."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    names = ["row", "low", "n", "core", "whole", "gram", "again", "bytes"]
    for batch in batches:
        row, low, name = (batch.column(x).to_numpy() for x in ("row", "low", "gram"))
        again = batch.column("again").to_numpy(zero_copy_only=False)
        out: list[list] = []
        pieces: list[bytes | None] = []
        for i, stored in enumerate(batch.column("bytes")):
            stored = stored.as_buffer()
            data, sums = units.read(stored)
            strings = len(data) - length + 1
            # The suffix: where its gram stands first in the last string.
            may = np.arange(strings - 1, len(data) - gram + 1)
            place = may[np.argmax(hash_spans(sums, may, may + gram) == name[i : i + 1].view(np.uint64))]
            block = (place - np.arange(strings)) // size
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            last = np.concatenate([first[1:], [strings]]) - 1
            near = block[first] * size
            with np.errstate(over="ignore"):
                seed = name[i : i + 1].view(np.uint64) + mix(block[first].astype(np.uint64))
                core = mix(hash_spans(sums, place - near, place - near - size + 1 + length) + seed)
                whole = mix(hash_spans(sums, first, last + length) + seed + mix((place - first).astype(np.uint64) * U64(1 << 32) + last.astype(np.uint64) - first.astype(np.uint64)))
            count = len(first)
            out.append([np.full(count, row[i]), low[i] + first, last - first + 1, core.view(np.int64), whole.view(np.int64),
                        np.full(count, name[i]), np.full(count, again[i])])
            data_bytes = stored.to_pybytes() if size > 1 else b""
            pieces += [data_bytes[units.size * a : units.size * (b + length)] if size > 1 else None for a, b in zip(first, last, strict=True)]
            if len(pieces) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([*map(np.concatenate, zip(*out, strict=True)), pieces], kinds, strict=True)], names)
                out, pieces = [], []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([*map(np.concatenate, zip(*out, strict=True)), pieces], kinds, strict=True)], names)


def _cut(batches: Iterator[pa.RecordBatch], units: Units, length: int) -> Iterator[pa.RecordBatch]:
    """The units of the runs named in `cuts`."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
    names = ["row", "low", "lead", "gram", "again", "large", "bytes"]
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for row, text, cuts in zip(batch.column("row"), batch.column("text"), batch.column("cuts"), strict=True):
            data, row = units.stored(text.as_buffer().to_pybytes()), row.as_py()
            for c in cuts.as_py():
                piece = data[units.size * c["low"] : units.size * (c["one"] + length)]
                out.append((row, c["low"], c["lead"], c["gram"], c["again"], c["large"], piece))
                size += len(piece)
            if size > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _names(batch: pa.RecordBatch, units: Units, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, run, start) of every string of every run; a name joins a string and its suffix."""
    names, runs, places = [], [], []
    low, gram = (batch.column(x).to_numpy() for x in ("low", "gram"))
    for i, data in enumerate(batch.column("bytes")):
        data, sums = units.read(data.as_buffer())
        start = np.arange(len(data) - length + 1)
        hashes = hash_spans(sums, start, start + length)
        with np.errstate(over="ignore"):
            hashes = mix(hashes + gram[i : i + 1].view(np.uint64))
        names.append(hashes)
        runs.append(np.full(len(start), i))
        places.append(start + low[i])
    return np.concatenate(names), np.concatenate(runs), np.concatenate(places)


def _compare(batches: Iterator[pa.RecordBatch], units: Units, length: int) -> Iterator[pa.RecordBatch]:
    """Spans of the strings that two runs of one suffix share; the rows of a suffix follow one another."""
    waiting: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        waiting = pa.concat_tables([waiting, table]) if waiting is not None else table
        gram = waiting.column("gram").to_numpy()
        done = int(np.argmax(gram == gram[-1])) if len(gram) else 0  # the last suffix may go on
        if done:
            yield from _compared(waiting.slice(0, done), units, length)
            waiting = waiting.slice(done)
    if waiting is not None and len(waiting):
        yield from _compared(waiting, units, length)


def _compared(table: pa.Table, units: Units, length: int) -> Iterator[pa.RecordBatch]:
    gram = table.column("gram").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    first = 0
    while first < len(gram):  # whole suffixes, about 2,000 runs at a time
        later = starts[(starts > first) & (starts >= first + 2000)]
        end = int(later[0]) if len(later) else len(gram)
        batch = table.slice(first, end - first).combine_chunks().to_batches()[0]
        names, runs, places = _names(batch, units, length)
        _, back, counts = np.unique(names, return_inverse=True, return_counts=True)
        open_runs = ~batch.column("again").to_numpy(zero_copy_only=False)
        hit = (counts[back] > 1) & open_runs[runs]
        runs, places = runs[hit], places[hit]
        if len(runs):
            new = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1]) | (places[1:] != places[:-1] + 1)]))
            last = np.concatenate([new[1:] - 1, [len(runs) - 1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(runs[new])), pa.array(places[new].astype(np.int32)),
                 pa.array((places[last] + length).astype(np.int32))], ["row", "begin", "end"])
        first = end


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal runs that spans cover, in order."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans or []):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def _remove(batches: Iterator[pa.RecordBatch], units: Units, with_text: bool, with_words: bool) -> Iterator[pa.RecordBatch]:
    """Each row without its spans."""
    for batch in batches:
        sizes, removed, runs, digests, texts, words = [], [], [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            found = units.spans(data, _merged(spans.as_py()))
            ends = [0, *(end for _, end in found)]
            rest = b"".join([*(data[a:begin] for a, (begin, _) in zip(ends, found, strict=False)), data[ends[-1] :]])
            sizes.append(len(data))
            removed.append(len(data) - len(rest))
            runs.append(len(found))
            digests.append(hashlib.sha256(rest).hexdigest())
            if with_text:
                texts.append(None if not text.is_valid else rest.decode("utf-8", "ignore"))
        added = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())]
        if with_text:
            added.append(pa.array(texts, pa.string()))
        if with_words:
            words = [sum(end - begin for begin, end in _merged(spans)) for spans in batch.column("passages").to_pylist()]
            added.append(pa.array(words, pa.int64()))
        others = [x for x in batch.schema.names if x not in ("text", "spans", "passages")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(x) for x in others] + added,
            others + ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text + ["passage_words"] * with_words)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, batches: int = 4,
                   together: int = TOGETHER, with_text: bool = True, carry: tuple[str, ...] = (), units: Units = Bytes, passages: int = 0) -> DataFrame:
    """Remove every unit covered by a string of `length` units that also starts anywhere else in `docs`.

    Texts are taken as UTF-8 bytes, or with `units=WordRuns` as words `[^\\x20\\x09-\\x0D]+`, A-Z in lower case, whatever white space parts
    them; what is removed then goes from a word's begin to a word's end. Strings are judged on the input. Returns per row: doc_id, n_bytes,
    n_removed (bytes), n_spans (maximal removed runs), kept_sha256 (of the remaining bytes), and with `with_text`
    kept_text, in which a character cut by a removal is left out. With `passages` also passage_words: how many words of the text
    lie in a string of so many words that also starts anywhere else. Columns named in `carry` come along.

    A null text counts as empty bytes and its kept_text stays null; texts shorter than `length` are kept whole. Equal
    rows, ids repeated or null included, are separate documents, so all their long strings repeat. Other
    columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[
        F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)])
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    # A string of n words has 2 n - 1 bytes at least.
    long = lambda n, u: docs.where(F.octet_length("text") >= (n if u is Bytes else 2 * n - 1)).select("row", "text")
    spans = repeated_spans(long(length, units), length, batches, together, units)
    kinds = dict(docs.dtypes)
    extra = {f"_carry{i}": c for i, c in enumerate(carry)}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *extra))
    schema += ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    read = ["doc_id", *extra, "text", "spans"]
    if passages:
        words = repeated_spans(long(passages, WordRuns), passages, batches, together, WordRuns)
        both = keep(spans.join(words.withColumnRenamed("spans", "passages"), "row", "full"), "both-spans")
        forget(spans, words)
        spans, read, schema = both, [*read, "passages"], schema + ", passage_words long"
    joined = docs.join(spans, "row", "left").select(*read)
    return joined.mapInArrow(lambda parts: _remove(parts, units, with_text, bool(passages)), schema).withColumnsRenamed(extra)
