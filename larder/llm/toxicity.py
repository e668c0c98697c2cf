"""Toxicity of texts whose words may be disguised: a noisy channel is undone before words are scored.

Corpus letters give a letter-trigram model. Suspicious tokens (digits and signs among letters, letters
repeated, single letters in a row) become lattices of the letters they may stand for, and a Viterbi search
under that model restores the word. Restored and plain words are looked up in a table of word and
prefix features learned from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.components import bounded_sample, keep
from larder.llm.signatures import superminhash
from larder.llm.textblocks import Words, text_blocks

#: Labelled rows learned from at most, of each label; the first in the order of a hash of their ids.
TRAIN_ROWS = 20_000
#: Features kept at most, and how often one must be seen in the labelled rows to speak for itself.
FEATURES, SEEN = 20_000, 4
#: Signature values by which copies among the labelled rows are told.
COPIES = 4
#: Standard errors by which a feature's share of toxic rows is lowered.
CAUTION = 2.5
PREFIXES = (6, 5, 4)
#: Hypotheses kept at each place of a lattice, characters of a lattice (longer tokens are also parted and matched whole), tokens remembered.
BEAM, LONGEST, KNOWN = 8, 32, 300_000

# Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "%": "x", "#": "h",
}
SEPARATORS = " .-_*~·'`/\\,:"
_STRIP = ".,;:!?\"'()[]{}#*%&$|<>«»“”„…¡¿-_/\\"
SYMBOLS = 60


def symbol(char: str) -> int:
    """Class of a lower-case character for the letter model: 0 no letter, a-z, Latin-1 letters, 59 other letters."""
    code = ord(char)
    if 97 <= code <= 122:
        return code - 96
    if 0xDF <= code <= 0xFF and code != 0xF7:
        return min(58, code - 0xE0 + 27) if code >= 0xE0 else 59
    return 59 if char.isalpha() else 0


def _symbol_table() -> np.ndarray:
    """Symbols of the code points up to U+FFFF; beyond, there are few letters and they share symbol 59 or 0."""
    return np.array([symbol(chr(i).lower()[:1] or " ") if not 0xD800 <= i < 0xE000 else 0 for i in range(1 << 16)], np.int32)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, total = _symbol_table(), np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        texts = [t for t in batch.column("text").to_pylist() if t]
        for first in range(0, len(texts), 200):
            codes = np.frombuffer(" ".join(texts[first : first + 200]).encode("utf-32-le", "replace"), np.uint32)
            s = np.concatenate([[0], table[np.minimum(codes, 0xFFFF)], [0]])
            total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["gram", "n"])


def letter_model(docs: DataFrame, extra: list[str]) -> np.ndarray:
    """log P(third symbol | two before), from all texts of `docs`, and `extra` words as often as the average word's letters.

    The table has 60 ** 3 entries whatever the corpus; each partition sends its non-zero counts.
    """
    rows = docs.select("text").mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    for row in rows:
        counts[row["gram"]] = row["n"]
    weight = max(1.0, counts.sum() / 1e5)
    for word in extra:
        s = [0, *(symbol(c) for c in word), 0]
        for a, b, c in zip([0, *s[:-1]], s, [*s[1:], 0], strict=True):
            counts[a * SYMBOLS**2 + b * SYMBOLS + c] += weight
    cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs = cube.sum(axis=0)
    backoff = (pairs + 0.5) / (pairs + 0.5).sum(axis=1, keepdims=True)
    return np.log((cube + 5.0 * backoff) / (cube.sum(axis=2, keepdims=True) + 5.0)).astype(np.float32)


def restore(token: str, model: np.ndarray, beam: int = BEAM) -> list[tuple[str, float]]:
    """The most likely words behind a token with their log probabilities, best first.

    Each character opens the letters it may stand for; a separator, or a letter that repeats the one before, may also
    stand for nothing. Hypotheses with the same letters so far are merged into the better one.
    """
    states: dict[str, float] = {"": 0.0}
    before = ""
    for char in token:
        options: list[tuple[str, float]] = []
        if char.isalpha():
            options.append((char, 0.0))
            if char == before:
                options.append(("", -1.0))
        elif char in LEET:
            options.extend((letter, -1.0) for letter in LEET[char])
            if char == before:
                options.append(("", -1.0))
        if char in SEPARATORS or (not char.isalpha() and char not in LEET):
            options.append(("", -0.5))
        before = char
        new: dict[str, float] = {}
        for text, score in states.items():
            a, b = (symbol(text[-2]) if len(text) > 1 else 0), (symbol(text[-1]) if text else 0)
            for letter, cost in options:
                value = score + cost + (float(model[a, b, symbol(letter)]) if letter else 0.0)
                if value > new.get(text + letter, -math.inf):
                    new[text + letter] = value
        states = dict(sorted(new.items(), key=lambda item: (-item[1], item[0]))[:beam])
    ended = {t: s + float(model[symbol(t[-2]) if len(t) > 1 else 0, symbol(t[-1]), 0]) for t, s in states.items() if t}
    return sorted(ended.items(), key=lambda item: (-item[1], item[0]))


_RUN = re.compile(r"(.)\1+")
_LONG_RUN = re.compile(r"(.)\1\1")
_STRETCHED = re.compile(r"(.)\1{2,}")
_PARTS = re.compile(rf"[^{re.escape(SEPARATORS)}]+")


def single(token: str) -> str | None:
    """The one character that a token is but for punctuation around it, if it is one."""
    if len(token) < 2:
        return token
    if token[0].isalnum() and token[-1].isalnum():
        return None
    for signs in (".,;:!?\"'()[]{}…", _STRIP + SEPARATORS):
        if len(rest := token.strip(signs)) == 1:
            return rest
    return None


def features(word: str) -> list[str]:
    """A word's features, the most specific first."""
    return [f"={word}"] + [word[:n] for n in PREFIXES if len(word) > n] if len(word) >= 3 else []


def plain_words(text: str) -> list[str]:
    return text.lower().split()


class Scorer:
    """Scores texts with a table feature -> probability that a row with it is toxic."""

    def __init__(self, table: dict[str, float], model: np.ndarray, base: float):
        self.table, self.model, self.base, self.known = table, model, base, {}
        words = (f.removeprefix("=") for f in table if f[0] == "=" or len(f) > PREFIXES[-1])
        self.stems = {word[:n] for word in words for n in range(len(word) + 1)}

    def of_word(self, word: str, most: int | None = None) -> float:
        """What the most specific known feature says; `most` leaves out the more general ones."""
        for feature in features(word)[:most]:
            if feature in self.table:
                return self.table[feature]
        return 0.0

    def of_token(self, token: str) -> float:
        """Probability for a token as it stands or as restored."""
        value = self.known.get(token)
        if value is None:
            value = self._of_token(token)
            if len(token) <= 4 * LONGEST:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[token] = value
        return value

    def _of_token(self, token: str) -> float:
        value = self.of_word(token.strip(_STRIP))
        if value >= 0.5:
            return value
        short = token if len(token) <= LONGEST else _STRETCHED.sub(r"\1\1", token)
        value = self._restored(short[:LONGEST], short != token)
        if value >= 0.5:
            return value
        parts = set(_PARTS.findall(token)) - {token, token.strip(_STRIP)}
        if parts or len(token) > LONGEST:
            value = max([self.spelled(token), *(self.of_token(part) for part in parts if len(part) > 2)])
        return value if value >= 0.5 else 0.0

    def _restored(self, token: str, stretched: bool) -> float:
        """What the decoded token says; `stretched` if letters that repeat were left out of it already."""
        word = token.strip(_STRIP)
        value = self.of_word(word)
        if value >= 0.5:
            return value
        suspicious = not word.isalpha() and any(c.isalpha() for c in word) and len(word) >= 3
        repeated = _RUN.sub(r"\1", word)
        if not suspicious and repeated != word:
            suspicious = stretched or bool(_LONG_RUN.search(word)) or self.of_word(repeated, 2) >= 0.5
        if not suspicious and word != token and word.isalpha():  # a sign at an end may be a letter
            suspicious = token[0] in LEET or token[-1] in LEET
        if suspicious:
            for form in dict.fromkeys((word, token.strip(".,;:?\"'"))):
                for text, _ in restore(form, self.model):
                    value = max(value, self.of_word(text, 2))  # short prefixes fit too many restored words
        return value if value >= 0.5 else 0.0

    def spelled(self, token: str) -> float:
        """The highest value of a known word that stands anywhere in a token of any length, as disguised as `restore` allows.

        It begins and ends at the token's ends or beside a sign, so in a run of single letters anywhere, and at least one of
        its characters is a letter. What only a prefix says counts if no longer known word from there says less.
        """
        chars: list[list] = []  # character, may begin here, may end here
        before = " "
        for i, char in enumerate(token):
            if char.isalpha() or char in LEET:
                ends = i + 1 == len(token) or not token[i + 1].isalnum()
                if len(chars) > 1 and chars[-1][0] == chars[-2][0] == char:
                    chars[-1][2] |= ends
                else:
                    chars.append([char, not before.isalnum(), ends])
            before = char
        best, said = 0.0, {}
        states: set[tuple[int, str, bool]] = set()
        for k, (char, begins, ends) in enumerate(chars):
            letter = char.isalpha()
            options = char if letter else LEET[char]
            new = {(at, text, known or letter) for at, text, known in states} if k and char == chars[k - 1][0] else set()
            for at, text, known in [*states, *([(k, "", False)] if begins else [])]:
                new |= {(at, text + x, known or letter) for x in options if text + x in self.stems}
            states = new
            follows = k + 1 < len(chars) and (not ends or (chars[k + 1][1] and chars[k + 1][2]))
            for at, text, known in states:
                if known and len(text) > 2:
                    if ends:
                        value = self.table.get("=" + text)
                        if value is not None:
                            best = max(best, value)
                            said[at] = max(said.get(at, (0, 0.0)), (len(text), value))
                    if follows and text in self.table:
                        said[at] = max(said.get(at, (0, 0.0)), (len(text), self.table[text]))
        return max([best, *(value for _, value in said.values())])

    def of_text(self, text: str | None) -> float:
        """1 - product of (1 - p) over the distinct tokens with p of a half or more; without one, a low constant.

        Words below a half say less than the share of toxic rows does, and a long text has many of them.
        """
        tokens = plain_words(text) if text else []
        found = set(tokens)
        run: list[str] = []
        for token in [*tokens, ""]:  # i d i o t
            char = single(token)
            if char:
                run.append(char)
            else:
                if len(run) > 2:
                    found.add(" ".join(run))
                run = []
        rest = 1.0 - self.base
        for value in map(self.of_token, found):
            if value:
                rest *= 1.0 - value
        return 1.0 - rest


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features with the number of toxic and of other rows that hold them, per batch."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = {f for token in set(plain_words(text or "")) for f in features(token.strip(_STRIP))}
            counts[int(toxic)].update(found)
        names = list(counts[1].keys() | counts[0].keys())
        for first in range(0, len(names), 100_000):
            part = names[first : first + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([counts[1][f] for f in part], pa.int64()), pa.array([counts[0][f] for f in part], pa.int64())],
                ["feature", "toxic", "other"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the values of a short signature of their shingles instead of their texts."""
    for batch in batches:
        for first, end, data, starts in text_blocks(batch.column("text")):
            signature = superminhash(*Words(data, starts).shingles(), COPIES).view(np.int64)
            columns = [batch.column(c).slice(first, end - first) for c in ("doc_id", "toxic")]
            yield pa.RecordBatch.from_arrays(
                [columns[0].cast(pa.int64()), columns[1], *(pa.array(np.ascontiguousarray(signature[:, i])) for i in range(COPIES))],
                ["doc_id", "toxic", *(f"k{i}" for i in range(COPIES))])


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Scorer:
    """Learn the feature table from (doc_id, toxic), at most `train_rows` of each label, and the letter model from all texts."""
    known = labels.where("toxic is not null").select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    sample = [bounded_sample(known.where(side), train_rows, "doc_id") for side in ("toxic", "not toxic")]
    sample = sample[0].unionByName(sample[1]).dropDuplicates(["doc_id"])
    # Copies and near copies would make every word of one toxic text look toxic: of rows that agree in any of a few
    # signature values, one stays.
    keys = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text").mapInArrow(
        _signed, "doc_id long, toxic boolean, " + ", ".join(f"k{i} long" for i in range(COPIES)))
    for i in range(COPIES):
        keys = keys.groupBy("toxic", f"k{i}").agg(F.min(F.struct("doc_id", *(f"k{j}" for j in range(COPIES)))).alias("r")).select("toxic", "r.*")
    sample = keep(keys.select("doc_id", "toxic"), "sample")
    rows = docs.join(F.broadcast(sample), "doc_id").select("text", "toxic")
    counted = rows.mapInArrow(_seen, "feature string, toxic long, other long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where(f"toxic + other >= {SEEN}")
    size = sample.agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("int")).alias("toxic")).first()
    share = F.expr("toxic / (toxic + other)")
    counted = counted.withColumn("p", _lowered(share, F.expr("toxic + other")))
    strong = counted.where("p >= 0.5").orderBy(F.desc("toxic"), "feature").limit(FEATURES).collect()
    stems = sorted({f.lstrip("=")[: PREFIXES[-1]] for f in (r["feature"] for r in strong)})
    table = {r["feature"]: r["p"] for r in strong}
    if stems:  # the more specific features of the same stems, so that a harmless word is not judged by its prefix
        weak = counted.where("p < 0.5").where(F.substring(F.ltrim(F.col("feature"), F.lit("=")), 1, PREFIXES[-1]).isin(stems))
        table |= {r["feature"]: r["p"] for r in weak.orderBy(F.desc(F.expr("toxic + other")), "feature").limit(FEATURES).collect()}
    base = 0.25 / ((size["n"] or 0) + 1.0)
    words = [f[1:] for f, p in table.items() if f[0] == "=" and p >= 0.5]
    return Scorer(table, letter_model(docs, words), base)


def _lowered(share, count):
    """Lower end of Wilson's interval for a share."""
    z = CAUTION
    middle = share + z * z / 2 / count
    spread = z * F.sqrt(share * (1 - share) / count + z * z / 4 / count / count)
    return (middle - spread) / (1 + z * z / count)


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id's text divides by five."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Score every text of `docs` (doc_id, text): doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Labels (doc_id, toxic) of held-out rows are never read. A null or empty text gets the lowest score. Without labels
    all texts do. Repeated rows are scored alike; if labels repeat an id, one of them counts; null ids have no
    label. Extra columns are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scorer = learn(docs, labels.where(~held_out() & F.col("doc_id").isNotNull()), train_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                scores = [scorer.of_text(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                    ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
