import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tessera.llm.common import table
from tessera.llm.sentencepieces import PieceCodec, encode_documents

from .conftest import SF


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def texts(spark):
    rng = random.Random(4)
    hard = ["", " ", "   ", " a", "a ", "▁a▁▁b", "日本語 テキスト", "😀😀 x", "\n\n\t x", "aaaa" * 300, "<s> </s> <unk> <0x41>", "é" * 700, "1234567890", "a\x00b", "the " * 50, "‍‍", " ".join("ab" * k for k in range(60))]
    alphabet = "abetinhors  \n'sé—12½日😀_.▁"
    return hard + ["".join(rng.choice(alphabet) for _ in range(80)) for _ in range(400)] + [r.text for r in table(spark, SF, "documents").collect()]


def test_ids_and_decoding_equal_the_library(spark, library):
    codec, all_texts = PieceCodec(), texts(spark)
    got = codec.encode_batch(all_texts)
    for t, ids in zip(all_texts, got, strict=True):
        assert ids.tolist() == library.encode(t, add_bos=True, add_eos=True), t
        assert codec.decode(ids) == library.decode(ids.tolist()), t


def test_heap_equals_rounds():
    codec, rng = PieceCodec(), random.Random(9)
    words = ["▁" + "".join(rng.choice("aeinrst日x") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for w, symbols in zip(words, codec.encode_words(words), strict=True):
        assert np.array_equal(symbols, codec.encode_long(w)), w


def test_query(spark, hard, empty, library):
    got = sorted(map(tuple, encode_documents(hard).collect()), key=str)
    want = []
    for r in hard.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert encode_documents(empty).count() == 0
