import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from larder.llm import packing, tokens
from larder.llm.packing import Limits
from larder.llm.queries import tokenizer_path
from larder.llm.tokens import WordTokenizer
from tests.llm.helpers import prose

TEXTS = [None, "", " ", "Hello, WORLD's 12 don't", "<|endoftext|> a", "naïve café İstanbul ΣΑΣ ﬁ", "中文 text 🙂", "á \x1c b\x85c", "it'S", "x" * 5000]


def test_words_encode_as_whole_texts():
    own, plain = WordTokenizer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    rng = random.Random(2)
    texts = [*TEXTS[1:], *(prose(rng, 200) + rng.choice(["!", "...", " 3.14", "\n", "'s!'s", "''d9x"]) for _ in range(40))]
    for _ in range(2):
        got = list(own.encode_all(texts))
        assert [x.tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(own.encode_all([])) == []


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 3, 40), Limits(100, 5, 100)])
def test_pieces_are_whole_and_within_limits(spark, limits):
    rng = random.Random(3)
    rows = [(i, t, rng.choice([None, 0, 5, 10**6]), 1) for i, t in enumerate(TEXTS + [prose(rng, rng.choice([1, 5, 30, 300, 3000])) for _ in range(120)] + [None] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prompt long, length int").repartition(3).sortWithinPartitions("doc_id")
    got = packing.pack(docs, tokenizer_path(), limits, masked_col="prompt").collect()
    plain = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, *_ in rows}
    prompt = {i: min(len(ids[i]), p or 0) for i, _, p, _ in rows}
    pieces, sequences = {}, {}
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, tokens in ids.items():
        upto = 0
        for start, length in sorted(pieces[i]):
            assert start == upto
            upto += length
        assert upto == len(tokens)
    for members in sequences.values():
        upto = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == upto
            upto += r.length
        assert upto == limits.tokens or upto & (upto - 1) == 0
        assert upto <= limits.tokens and len(members) <= limits.segments
        assert sum(r.start + r.length - max(r.start, min(r.start + r.length, prompt[r.doc_id])) for r in members) <= limits.loss


def test_empty_table_and_limits(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, tokenizer_path(), Limits(loss=0))


def test_lower_casing_and_rare_letters_encode_as_whole_texts(monkeypatch):
    own, plain = WordTokenizer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    letters = "".join(map(chr, [*range(0xA1, 0x130), *range(0x131, 0x250)]))
    texts = [" ".join(letters), letters, letters.upper(), "<|ENDOFTEXT|> a", "x<|EndOfText|>", "Ⱥb ȾC ÀÉ's 'LL ǅx", *(f"{c}'T a{c}1{c}" for c in letters)]
    for known in (10**6, 300):
        monkeypatch.setattr(tokens, "KNOWN", known)
        for _ in range(2):
            assert [x.tolist() for x in own.encode_all(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
