from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from conftest import SMALL
from tokenizers import Tokenizer

from streamgrid.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "aabbth e\n\t  é中.=-_퟿😀ſ٣²'sdlv1\x1c\x85\xa0½Жҋ"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return bpe.Vocabulary(f.read())


def test_encoding_equals_merging_by_rank(vocabulary, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["a" * 3000, "=-" * 2000, " " * 500, "<|endoftext|>x<|endoftext|>", "thethe" * 999, ""]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert vocabulary.encode(text) == ids
        assert vocabulary.decode_bytes(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_neighbours_fit_exactly_if_they_encode_to_themselves(vocabulary, library):
    rng = random.Random(6)
    tokens = [t for t in vocabulary.whole.values() if vocabulary.length[t] < 6]
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        data = vocabulary.decode_bytes([a, b])
        assert vocabulary.fits(a, b) == (data not in vocabulary.whole and vocabulary.encode_piece(data) == [a, b])


def test_round_trip_and_digest(spark, odd, library):
    encoded = bpe.encode(odd, PATH)
    assert encoded.count() == odd.count() and "size" in encoded.columns
    for row in bpe.decode(encoded, PATH, out="again").collect():
        assert row["again"] == (row["text"] or "")
        assert row["tokens"] == library.encode(row["text"] or "", add_special_tokens=False).ids
    for row in bpe.digest(odd, PATH).collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()


def test_unknown_ids_are_no_bytes(spark):
    df = spark.createDataFrame([([64, None, -1, 999_999, 65],), (None,), ([],)], "tokens array<int>")
    assert [r["text"] for r in bpe.decode(df, PATH).collect()] == ["ab", "", ""]


def test_empty_table(nothing):
    assert bpe.digest(nothing, PATH).count() == 0


def test_query(spark, library):
    from streamgrid.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op1_bpe"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
