"""A hierarchical Pitman-Yor language model over words, its seating sampled by Gibbs, its predictions averaged.

Every word is a context with a restaurant of its own, whose customers are the words that followed it (the end of a text is
the context of the next text's first word). All of them share one parent, the root, whose customers are their tables,
and the root's parent is the uniform distribution over the known words and one more for all unknown ones. `seating` moves the
customers. All restaurants of a sweep are sampled at once, given the tables of the sweep before; a dish of one restaurant is
a row of its own, so a context that holds a third of the corpus is spread like any other. After some sweeps the
predictive probabilities of several are averaged.

The work goes through parcels: rows with packed arrays that are sent to a bucket or a block.
  block    about a million tokens of whole texts, written once
  word bucket    a range of word hashes; a word's number is its place in the bucket and the bucket's number
  gram bucket    pairs (context, word) with the same hash of the context, or of the pair where the context is hot
Blocks tell word buckets their words and get numbers and counts back; with these they tell gram buckets their pairs. In each
sweep gram buckets ask word buckets for the parent's chances and tell them their tables. At the end the blocks get the
probability of each of their pairs. So only distinct words and pairs of a block travel, a few bytes each.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.components import forget, keep
from larder.llm.seating import FEW, reseat
from larder.llm.textblocks import U64, Words, mix, text_blocks

#: Tokens of a block, and of the corpus per word bucket and per gram bucket, about.
BLOCK, WORDS, GRAMS = 1 << 20, 1 << 22, 1 << 20
#: A context with this share of all tokens is dealt out pair by pair.
HOT = 1 << 14
#: Sweeps before the first one whose probabilities count, and how many of those are averaged.
BURN_IN, SAMPLES = 3, 3
#: Strength of all restaurants; their discounts follow from the counts of counts.
STRENGTH = 1.0
#: Added to a count in the base score.
ADDED = 0.1

_PARCEL = "to long, kind string, sender long, part long, arrays array<binary>"
_NAMES = ["to", "kind", "sender", "part", "arrays"]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_END = U64(0x5851F42D4C957F2D)

Parcel = tuple[int, str, int, int, list[bytes]]


def pack(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, as many as the largest needs (all eight if one is negative), other numbers as they are."""
    if values.dtype.kind == "f":
        return values.dtype.char.encode() + b"\0" + values.tobytes()
    values = np.ascontiguousarray(values).astype(np.int64, copy=False)
    planes = 1 if not len(values) else 8 if values.min() < 0 else max(1, -(-int(values.max()).bit_length() // 8))
    return b"i" + bytes([planes]) + b"".join((values >> (8 * i)).astype(np.uint8).tobytes() for i in range(planes))


def unpack(data: bytes) -> np.ndarray:
    kind, planes = data[:1], data[1]
    if kind != b"i":
        return np.frombuffer(data, kind.decode(), offset=2)
    found = np.frombuffer(data, np.uint8, offset=2).reshape(planes, -1)
    out = found[0].astype(np.int64)
    for i in range(1, planes):
        out |= found[i].astype(np.int64) << (8 * i)
    return out


def _batch(parcels: list[Parcel]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in parcels], k) for i, k in enumerate(_KINDS)], _NAMES)


def _read(table: pa.Table | pa.RecordBatch) -> Iterator[Parcel]:
    """The parcels of a bucket or block, by kind, sender and part."""
    for row in sorted(table.to_pylist(), key=lambda r: (r["kind"], r["sender"], r["part"])):
        yield row["to"], row["kind"], row["sender"], row["part"], row["arrays"]


def _each(parcels: DataFrame, function: Callable[[Parcel], list[Parcel]]) -> DataFrame:
    """What `function` makes of each parcel."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for parcel in _read(batch.slice(i, 1)):
                    if made := function(parcel):
                        yield _batch(made)
    return parcels.mapInArrow(run, _PARCEL)


def _met(parcels: DataFrame, function: Callable[[int, dict[str, list[Parcel]]], list[Parcel]]) -> DataFrame:
    """What `function` makes of all parcels that were sent to one place, by kind."""
    def run(table: pa.Table) -> pa.Table:
        kinds: dict[str, list[Parcel]] = {}
        to = table.column("to")[0].as_py()
        for parcel in _read(table):
            kinds.setdefault(parcel[1], []).append(parcel)
        return pa.Table.from_batches([_batch(function(to, kinds))])
    return parcels.groupBy("to").applyInArrow(run, _PARCEL)


# Blocks of texts, and the numbers and counts of their words.

def _cut(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole texts: ids, which of them are null, held out, lengths, distinct words (hashes), words of the texts."""
    waiting: list[tuple] = []
    size = 0

    def block() -> pa.RecordBatch:
        ids, held, lengths, tokens = (np.concatenate(x) for x in zip(*waiting, strict=True))
        words, places = _distinct(tokens)
        none = np.array([i is None for i in ids])
        ids = np.array([0 if i is None else i for i in ids], np.int64)
        arrays = [pack(x) for x in (ids, none, held, lengths, words.view(np.int64), places)]
        return _batch([(uuid.uuid4().int >> 66, "text", len(words), len(tokens), arrays)])

    for batch in batches:
        ids = np.array(batch.column("doc_id").to_pylist(), object)
        held = batch.column("held_out").to_numpy(zero_copy_only=False)
        for first, end, data, starts in text_blocks(batch.column("text")):
            words = Words(data, starts)
            lengths = words.counts + 1
            tokens = np.full(int(lengths.sum()), _END)
            inside = np.ones(len(tokens), bool)
            inside[np.cumsum(lengths) - 1] = False
            tokens[inside] = words.hashes()
            waiting.append((ids[first:end], held[first:end], lengths, tokens))
            size += len(tokens)
            if size >= limit:
                yield block()
                waiting, size = [], 0
    if waiting:
        yield block()


def _sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(`values`, none negative, by size, where each of these stood); equal ones as they stood.

    Value and place are sorted as one number, which is much quicker than sorting places by values. The lowest bits of values
    that leave no room for the place are cut off; should values differ in these alone, places are sorted after all.
    """
    if not len(values):
        return values, np.zeros(0, np.int64)
    room = U64(len(values).bit_length())
    cut = U64(max(0, int(values.max()).bit_length() + int(room) - 64))
    both = (values.astype(np.uint64) >> cut) << room
    both |= np.arange(len(values), dtype=np.uint64)
    both.sort()
    order = (both & ((U64(1) << room) - U64(1))).view(np.int64)
    if not cut:
        return (both >> room).astype(values.dtype), order
    ordered = values[order]
    if (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(values, kind="stable")
        ordered = values[order]
    return ordered, order


def _order(values: np.ndarray) -> np.ndarray:
    """Places of `values`, none negative, by value; equal ones as they stand."""
    return _sorted(values)[1]


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, where each of `values`, none negative, stands among them)."""
    ordered, order = _sorted(values)
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(ordered), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def _ranks(order: np.ndarray) -> np.ndarray:
    out = np.empty_like(order)
    out[order] = np.arange(len(order))
    return out


def _by_token(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(values, lengths)


def _tell_words(parcel: Parcel, bits: int) -> list[Parcel]:
    """A block's words and how often they are learned from, to their buckets."""
    block, _, _, _, arrays = parcel
    held, lengths, words, places = (unpack(x) for x in arrays[2:6])
    words = words.view(np.uint64)
    counts = np.bincount(places[_by_token(held == 0, lengths)], minlength=len(words))
    marks = (np.arange(1, 1 << bits, dtype=np.uint64) << U64(64 - bits)) if bits else np.zeros(0, np.uint64)
    bounds = np.concatenate([[0], np.searchsorted(words, marks), [len(words)]])
    return [(i, "words", block, 0, [pack(words[a:b].view(np.int64)), pack(counts[a:b])])
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b]


def _number(to: int, kinds: dict[str, list[Parcel]], buckets: int) -> list[Parcel]:
    """A bucket's words get numbers; the blocks hear those of their words, and the counts."""
    told = [(p[2], unpack(p[4][0]).view(np.uint64), unpack(p[4][1])) for p in kinds["words"]]
    words, place = _distinct(np.concatenate([w for _, w, _ in told]))
    counts = np.bincount(place, weights=np.concatenate([n for *_, n in told]), minlength=len(words)).astype(np.int64)
    out: list[Parcel] = [(to, "counts", int(counts.sum()), int((counts > 0).sum()), [pack(counts)])]
    upto = 0
    for block, w, _ in told:
        mine = place[upto : upto + len(w)]
        upto += len(w)
        out.append((block, "numbers", to, 0, [pack(mine * buckets + to), pack(counts[mine])]))
    return out


def _identify(to: int, kinds: dict[str, list[Parcel]], total: int, known: int) -> list[Parcel]:
    """A block with the numbers and counts of its words, and the base scores of its texts."""
    (*_, arrays), = kinds["text"]
    held, lengths, places = unpack(arrays[2]), unpack(arrays[3]), unpack(arrays[5])
    numbers = np.concatenate([unpack(p[4][0]) for p in kinds["numbers"]])
    counts = np.concatenate([unpack(p[4][1]) for p in kinds["numbers"]])
    text = _by_token(np.arange(len(lengths)), lengths)
    logs = np.log10((counts + ADDED) / (total + ADDED * (known + 1)))
    base = np.bincount(text, weights=logs[places], minlength=len(lengths))
    heard = np.bincount(text[counts[places] > 0], minlength=len(lengths))
    return [(to, "block", 0, 0, [*arrays[:4], pack(numbers), pack(counts), arrays[5], pack(heard), pack(base)])]


# Pairs of a context and a word.

def _pairs(parcel: Parcel, buckets: int, hot: float) -> tuple[np.ndarray, ...]:
    """(bounds by gram bucket, contexts, words, counts, place of each token's pair) of a block."""
    arrays = parcel[4]
    held, lengths, numbers, counts, places = (unpack(arrays[i]) for i in (2, 3, 4, 5, 6))
    ends = np.cumsum(lengths) - 1
    before = np.empty_like(places)
    before[1:] = places[:-1]
    before[ends - lengths + 1] = places[ends[0]]  # the end of a text comes before every text
    with np.errstate(over="ignore"):
        name = mix(numbers.astype(np.uint64) + U64(1))
    home = (name % U64(buckets)).astype(np.int64)
    by_number = _order(numbers)
    by_home = by_number[_order(home[by_number])]
    rank = _ranks(by_number)
    # In the order of a context's bucket, the context and the word.
    codes, place = _distinct(_ranks(by_home)[before] * len(numbers) + rank[places])
    learned = np.bincount(place, weights=_by_token(held == 0, lengths), minlength=len(codes)).astype(np.int64)
    left, right = np.divmod(codes, len(numbers))
    left, right = by_home[left], by_number[right]
    contexts, words, bucket = numbers[left], numbers[right], home[left]
    spread = counts[left] >= hot
    if spread.any():
        with np.errstate(over="ignore"):
            bucket[spread] = mix(name[left[spread]] + words[spread].astype(np.uint64)) % U64(buckets)
        order = _order(bucket * len(numbers) + rank[left])  # the words of a context keep their order
        contexts, words, bucket, learned, place = contexts[order], words[order], bucket[order], learned[order], _ranks(order)[place]
    return np.searchsorted(bucket, np.arange(buckets + 1)), contexts, words, learned, place


def _tell_pairs(parcel: Parcel, buckets: int, hot: float) -> list[Parcel]:
    bounds, contexts, words, counts, _ = _pairs(parcel, buckets, hot)
    return [(i, "pairs", parcel[0], 0, [pack(np.diff(contexts[a:b], prepend=0)), pack(words[a:b]), pack(counts[a:b])])
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b]


class _Pairs:
    """All pairs that were told to one gram bucket; `place` says where those of each message, one after the other, stand."""

    def __init__(self, parcels: list[Parcel], buckets: int):
        self.senders = [(p[2], len(unpack(p[4][2]))) for p in parcels]
        contexts = np.concatenate([np.cumsum(unpack(p[4][0])) for p in parcels])
        words = np.concatenate([unpack(p[4][1]) for p in parcels])
        counts = np.concatenate([unpack(p[4][2]) for p in parcels])
        self.contexts, left = _keys(contexts, buckets)
        self.words, right = _keys(words, buckets)
        codes, self.place = _distinct(left * len(self.words) + right)
        self.left, self.right = codes // len(self.words), codes % len(self.words)
        self.counts = np.bincount(self.place, weights=counts, minlength=len(codes)).astype(np.int64)


def _keys(numbers: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word numbers by word bucket and place in it, where each of `numbers` stands there)."""
    found, place = _distinct(numbers)
    order = _order(found % buckets)
    return found[order], _ranks(order)[place]


def _to_words(keys: np.ndarray, buckets: int, kind: str, sender: int, *values: np.ndarray) -> list[Parcel]:
    """Places of words and what belongs to them, to each word bucket."""
    part = keys % buckets
    bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    return [(int(part[a]), kind, sender, 0, [pack(keys[a:b] // buckets), *(pack(v[a:b]) for v in values)])
            for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _count(to: int, kinds: dict[str, list[Parcel]], buckets: int) -> list[Parcel]:
    """The pairs of a bucket counted: those seen more than once become a state, of the others only sums by word go on.

    A pair seen once has one table whatever is sampled. All words and contexts of the bucket are told to the word buckets: they
    ask for their values at the end.
    """
    pairs = _Pairs(kinds["pairs"], buckets)
    once, often = pairs.counts == 1, pairs.counts > 1
    single_words = np.bincount(pairs.right[once], minlength=len(pairs.words))
    single_contexts = np.bincount(pairs.left[once], minlength=len(pairs.contexts))
    out = [*_to_words(pairs.words, buckets, "all words", to, single_words), *_to_words(pairs.contexts, buckets, "all contexts", to, single_contexts)]
    words, right = _keys(pairs.words[pairs.right[often]], buckets)
    contexts, left = _keys(pairs.contexts[pairs.left[often]], buckets)
    c = pairs.counts[often]
    one = np.ones(len(c), np.int64)
    out.append((to, "state", int(once.sum()), int((c == 2).sum()), [pack(x) for x in (words, contexts, right, left, c, one, c[c > FEW], one - 1)]))
    return out


# Sweeps.

def _tell_tables(parcel: Parcel, buckets: int) -> list[Parcel]:
    """Tables of the repeated pairs, summed by word and by context, to the word buckets."""
    words, contexts, right, left, _, t, *_ = (unpack(x) for x in parcel[4])
    return [
        *_to_words(words, buckets, "word tables", parcel[0], np.bincount(right, weights=t, minlength=len(words)).astype(np.int64)),
        *_to_words(contexts, buckets, "context tables", parcel[0], np.bincount(left, weights=t, minlength=len(contexts)).astype(np.int64))]


def _ask(parcel: Parcel, buckets: int) -> list[Parcel]:
    words, contexts = unpack(parcel[4][0]), unpack(parcel[4][1])
    return [*_to_words(words, buckets, "all words", parcel[0]), *_to_words(contexts, buckets, "all contexts", parcel[0])]


def _sums(parcels: list[Parcel], size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for p in parcels:
        np.add.at(out, unpack(p[4][0]), unpack(p[4][1]))
    return out


def _open(to: int, kinds: dict[str, list[Parcel]]) -> list[Parcel]:
    """A word bucket's state before anything is seated: counts, tables of single pairs by word and by context, an empty root."""
    counts = unpack(kinds["counts"][0][4][0])
    none = np.zeros(len(counts), np.int64)
    singles = [_sums(kinds.get(k, []), len(counts)) for k in ("all words", "all contexts")]
    return [(to, "root", 0, 0, [pack(x) for x in (counts, *singles, none, none, none, none[:0])])]


def _seat_root(to: int, kinds: dict[str, list[Parcel]], buckets: int, chance: float, all_tables: int | None, discount: float, sample: bool, salt: int) -> list[Parcel]:
    """The root's dishes of a bucket: customers are the tables of the pairs; then one sweep (without totals only a start).

    Keeps of each word count, single tables, tables of its restaurant, customers and tables in the root; with `sample`
    also its mass in the root and the tables of its restaurant, for the average.
    """
    arrays = [unpack(x) for x in kinds["root"][0][4]]
    counts, single_words, single_contexts, _, customers, t, tables = arrays[:7]
    restaurant = single_contexts + _sums(kinds.get("context tables", []), len(counts))
    wanted = single_words + _sums(kinds.get("word tables", []), len(counts))
    if all_tables is None:
        t, tables = np.minimum(wanted, 1), wanted[wanted > FEW]
    else:
        names = mix((np.arange(len(counts)) * buckets + to).astype(np.uint64))
        tables, t = reseat(names, tables, customers, t, wanted, np.full(len(counts), all_tables), np.full(len(counts), chance), STRENGTH, discount, salt)
    customers = wanted
    out = [counts, single_words, single_contexts, restaurant, customers, t, tables, *arrays[7:]]
    if sample:
        out += [(customers - discount * t), restaurant]
    return [(to, "root", int(customers.sum()), int(t.sum()), [pack(x) for x in out])]


def _answer(to: int, kinds: dict[str, list[Parcel]], discount: float, whole: tuple[float, float]) -> list[Parcel]:
    """Each word's chance in the root, and the tables of its restaurant, to the gram buckets that ask."""
    _, _, _, restaurant, customers, t, *_ = (unpack(x) for x in kinds["root"][0][4])
    chances = (customers - discount * t) / whole[0] + whole[1]
    out = [(p[2], "chances", to, 0, [pack(chances[unpack(p[4][0])])]) for p in kinds.get("all words", [])]
    return out + [(p[2], "tables", to, 0, [pack(restaurant[unpack(p[4][0])])]) for p in kinds.get("all contexts", [])]


def _joined(parcels: list[Parcel], array: int = 0) -> np.ndarray:
    return np.concatenate([unpack(p[4][array]) for p in parcels])


def _seat_pairs(to: int, kinds: dict[str, list[Parcel]], discount: float, sample: bool, salt: int) -> list[Parcel]:
    """One sweep over the repeated pairs of a bucket."""
    words, contexts, right, left, c, t, tables, summed = (unpack(x) for x in kinds["state"][0][4])
    if len(c):
        chances, totals = _joined(kinds["chances"]), _joined(kinds["tables"])
        with np.errstate(over="ignore"):
            names = mix(mix(contexts.astype(np.uint64) + U64(7))[left] + words.astype(np.uint64)[right])
        tables, t = reseat(names, tables, c, t, c, totals[left], chances[right], STRENGTH, discount, salt)
    return [(to, "state", 0, 0, [pack(x) for x in (words, contexts, right, left, c, t, tables, summed + t * sample)])]


# Probabilities and scores.

def _answer_all(to: int, kinds: dict[str, list[Parcel]], roots: list[tuple[float, float]]) -> list[Parcel]:
    """Each word's chances in the root and each context's count and tables, one of every sample, to the gram buckets."""
    arrays = [unpack(x) for x in kinds["root"][0][4]]
    counts, masses, tables = arrays[0], arrays[7::2], arrays[8::2]
    chances = [(m / whole + rest).astype(np.float32) for m, (whole, rest) in zip(masses, roots, strict=True)]
    out: list[Parcel] = []
    for p in kinds.get("all words", []):
        out.append((p[2], "chances", to, 0, [pack(x[unpack(p[4][0])]) for x in chances]))
    for p in kinds.get("all contexts", []):
        out.append((p[2], "tables", to, 0, [pack(x[unpack(p[4][0])]) for x in (counts, *tables)]))
    return out


def _probabilities(to: int, kinds: dict[str, list[Parcel]], buckets: int, discount: float, samples: int) -> list[Parcel]:
    """log10 of the averaged predictive probability of every pair, to the blocks."""
    pairs = _Pairs(kinds["pairs"], buckets)
    words, contexts, right, left, _, _, _, summed = (unpack(x) for x in kinds["state"][0][4])
    t = np.minimum(pairs.counts, 1).astype(float) * samples
    t[pairs.counts > 1] = summed  # both stand in the order of contexts and words
    customers = _joined(kinds["tables"], 0)[pairs.left]
    mass = np.maximum(samples * pairs.counts - discount * t, 0.0)
    for s in range(samples):
        chance = _joined(kinds["chances"], s).astype(float)[pairs.right]
        mass += (STRENGTH + discount * _joined(kinds["tables"], s + 1)[pairs.left]) * chance
    logs = np.log10(mass / samples / (customers + STRENGTH)).astype(np.float32)[pairs.place]
    bounds = np.cumsum([0, *(n for _, n in pairs.senders)])
    return [(block, "logs", to, 0, [pack(logs[a:b])]) for (block, _), a, b in zip(pairs.senders, bounds[:-1], bounds[1:], strict=True)]


def _scores(table: pa.Table, buckets: int, hot: float, total: int) -> pa.Table:
    """The scores of a block's texts."""
    parcels = list(_read(table))
    block = next(p for p in parcels if p[1] == "block")
    logs = np.concatenate([unpack(p[4][0]) for p in parcels if p[1] == "logs"]).astype(float)
    ids, none, held, lengths, *_, heard, base = (unpack(x) for x in block[4])
    *_, place = _pairs(block, buckets, hot)
    scores = np.bincount(_by_token(np.arange(len(lengths)), lengths), weights=logs[place], minlength=len(lengths))
    return pa.table({
        "doc_id": pa.array(ids, mask=none.astype(bool)), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(lengths),
        "n_known": pa.array(heard), "train_tokens": pa.array(np.full(len(lengths), total)), "base_score": pa.array(base), "score": pa.array(scores)})


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", burn_in: int = BURN_IN, samples: int = SAMPLES,
          block: int = BLOCK, words: int = WORDS, grams: int = GRAMS, hot: int = HOT) -> DataFrame:
    """log10 probability of every text under a model learned from those whose crc32(id as text) mod 10 is not 0.

    Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end. Returns per text doc_id, held_out (that remainder
    is 0), n_tokens, n_known (tokens seen in learning), train_tokens (all tokens learned from), base_score (add-0.1
    counts of single words) and score (the Pitman-Yor model's, averaged over `samples` sweeps after `burn_in`). The result
    depends on the texts and ids alone, not on how they are dealt out.

    A null or empty text is one end. Null ids are learned from; rows that share an id are separate texts. Without any text to learn
    from every probability is one over one unknown word. An empty table gives an empty result; other columns are
    ignored. Words are told apart by 64-bit hashes. Scores add up logarithms of 24 bits' precision. Counts per bucket are all
    that comes to the driver.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"))
    texts = keep(rows.mapInArrow(lambda parts: _cut(parts, block), _PARCEL), "texts")
    tokens = texts.agg(F.sum("part")).first()[0]
    if tokens is None:
        return spark.createDataFrame([], _RESULT)
    bits = max(0, math.ceil(math.log2(tokens / words)))
    n_words, n_grams = 1 << bits, math.ceil(tokens / grams)

    numbered = keep(_met(_each(texts, lambda p: _tell_words(p, bits)), lambda to, kinds: _number(to, kinds, n_words)), "numbers")
    counts = numbered.where("kind = 'counts'")
    total, known = counts.agg(F.sum("sender"), F.sum("part")).first()
    blocks = keep(_met(texts.unionByName(numbered.where("kind = 'numbers'")), lambda to, kinds: _identify(to, kinds, total, known)), "blocks")
    forget(texts)
    often = total / hot

    counted = keep(_met(_each(blocks, lambda p: _tell_pairs(p, n_grams, often)), lambda to, kinds: _count(to, kinds, n_words)), "pairs")
    state, asked = counted.where("kind = 'state'"), counted.where("kind <> 'state'")
    discount = _discount(*state.agg(F.sum("sender"), F.sum("part")).first())
    root = keep(_met(counts.unionByName(asked), _open), "opened")
    forget(numbered)

    def seat_root(sample: bool, salt: int, top: float = 0.0, all_tables: int | None = None) -> DataFrame:
        told = root.unionByName(_each(state, lambda p: _tell_tables(p, n_words)))
        seated = keep(_met(told, lambda to, kinds: _seat_root(to, kinds, n_words, 1 / (known + 1), all_tables, top, sample, salt)), "root")
        forget(root)
        return seated

    def totals() -> tuple[int, tuple[float, float]]:
        """All tables of the root; what a word's mass there is divided by, and what is added for the root's own parent."""
        customers, tables = root.agg(F.sum("sender"), F.sum("part")).first()
        whole = customers + STRENGTH
        return tables, (whole, (STRENGTH + top * tables) / (known + 1) / whole)

    root = seat_root(False, 0)
    top = _discount(*_each(root, _counts_of_counts).agg(F.sum("sender"), F.sum("part")).first())
    tables, whole = totals()
    roots = []
    for sweep in range(1, burn_in + samples + 1):
        sample, before = sweep > burn_in, state
        answers = _met(root.unionByName(_each(state, lambda p: _ask(p, n_words))), lambda to, kinds: _answer(to, kinds, top, whole))
        state = keep(_met(state.unionByName(answers), lambda to, kinds: _seat_pairs(to, kinds, discount, sample, 2 * sweep)), "seated")
        if sweep > 1:
            forget(before)
        root = seat_root(sample, 2 * sweep + 1, top, tables)
        tables, whole = totals()
        if sample:
            roots.append(whole)

    answers = _met(root.unionByName(asked), lambda to, kinds: _answer_all(to, kinds, roots))
    pairs = _each(blocks, lambda p: _tell_pairs(p, n_grams, often))
    logs = keep(_met(pairs.unionByName(answers).unionByName(state), lambda to, kinds: _probabilities(to, kinds, n_words, discount, samples)), "logs")
    forget(counted, root, state)
    return blocks.unionByName(logs).groupBy("to").applyInArrow(lambda table: _scores(table, n_grams, often, total), _RESULT)


def _counts_of_counts(parcel: Parcel) -> list[Parcel]:
    """How many of a bucket's words have one customer in the root, and how many two."""
    customers = unpack(parcel[4][4])
    return [(parcel[0], "ones", int((customers == 1).sum()), int((customers == 2).sum()), [])]
