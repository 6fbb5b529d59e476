import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuesift.llm.packing import BLOCK, pack, unpack
from cuesift.llm.tokens import Encoder, token_files, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=900))
@settings(max_examples=60, deadline=None)
def test_pack_round_trip(values):
    values = np.array(values, np.uint64)
    assert (unpack(pack(values)) == values).all()


def test_blocks_unpack_by_themselves_and_small_values_pack_tightly():
    values = np.arange(5 * BLOCK + 7, dtype=np.uint64) % 2
    piece = pack(values)
    assert (unpack(piece, 2, 4) == values[2 * BLOCK : 4 * BLOCK]).all()
    assert len(unpack(piece, 9)) == 0
    assert len(piece) < len(values) / 4 + 100
    assert len(unpack(pack(np.zeros(0, np.uint64)))) == 0
    with pytest.raises(ValueError):
        unpack(b"x" * 40)


@pytest.fixture(scope="module")
def model():
    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    return model


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


ALPHABET = " \t\n\r\x0b\x0c ab's'rellA é12.,!«»\xa0 \x1c\x85中́<|endoftext|>\U0001f600"


@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=14), st.text(max_size=6)), min_size=1, max_size=12))
@settings(max_examples=120, deadline=None)
def test_parts_have_the_ids_of_the_whole_text(model, encoder, texts):
    for text, ids in zip(texts, encoder.rows(pa.array(texts, pa.string()))):
        assert ids.tolist() == model.encode(text or "", add_special_tokens=False).ids


def test_files_hold_every_text(spark, odd, empty, model):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    got = token_files(odd, PATH).collect()
    assert len(got) == len(rows)
    want = {}
    for doc_id, text in rows:
        ids = [*model.encode(text, add_special_tokens=False).ids, 0]
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
    start = 0
    previous = -1
    for r in sorted(got, key=lambda r: r.start):
        assert (r.n_tokens, r.ids_crc32, r.ids) in want[r.doc_id]
        assert r.start == start and (r.doc_id or -1) >= previous
        start, previous = start + r.n_tokens, r.doc_id or -1
    assert token_files(empty, PATH).collect() == []


def test_vocabulary_needs_a_whole_path(odd):
    with pytest.raises(ValueError):
        write_tokens(odd, "/tmp/unused", "byte_bpe_50k.json")
