import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from boreflow.llm import tokens as K
from boreflow.llm.queries import tokenizer_path
from tests.llm.helpers import awkward, frame, prose

TOK = Tokenizer.from_file(tokenizer_path())


def whole(text):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, K.END_ID]


def test_read_back_by_brute_force(spark):
    rows = [r for r in awkward() if r[0] is not None]
    got = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in K.token_output(frame(spark, rows), tokenizer_path()).collect()}
    want, start = set(), 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0], str(r[1]))):
        ids = whole(t)
        want.add((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_null_ids_and_empty_table(spark):
    out = K.token_output(frame(spark, awkward()), tokenizer_path()).collect()
    assert len(out) == len(awkward())
    assert sorted(r.start for r in out if r.doc_id is None)[0] == 0
    assert K.token_output(frame(spark, []), tokenizer_path()).count() == 0


PIECES = st.sampled_from(["don't", "a.b", "x,", "...", "<|endoftext|>", "é", "e\u0301.", "ß", "Σ", "ΑΣ.", "12.5,", "日本", " ", "\n", "\u00a0", "\u2003", "\x1c", "\x00", "'s", "!!", "İ", "a1b22", "X_y-z", "$5.00,", "ÀÉß", "heshon$$$", "µª", "~^`", "</s>", "ĳÿ×÷"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(PIECES, st.text(max_size=6)), max_size=12).map("".join), max_size=6))
def test_chunks_equal_whole_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, cuts = K.Encoder(tokenizer_path()).encode([t.encode() for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == [whole(t) for t in texts]


def test_random_access_and_guards():
    docs = [np.arange(k, dtype="<u2") for k in (5, 0, 3000)]
    sink = io.BytesIO()
    sink.close = lambda: None
    w = K.ShardWriter(sink, b"abcd" * 100, 2)
    for k, d in enumerate(docs):
        w.add(k or None, d)
    w.close()
    size = sink.tell()
    r = K.ShardReader(sink, size, b"abcd" * 100)
    assert [r.ids(k).tolist() for k in (2, 0, 1)] == [docs[k].tolist() for k in (2, 0, 1)]
    assert [r.doc_id(k) for k in range(3)] == [None, 1, 2]
    with pytest.raises(ValueError, match="another dictionary"):
        K.ShardReader(sink, size, b"other")


def test_dictionary_of_long_texts(spark):
    long = [(k, f"{k} " + prose(k, 15_000)) for k in range(8)]
    assert min(len(t) for _, t in long) > K.DICT_DOC_BYTES
    only = K.train_dictionary(frame(spark, long).select("doc_id", "text"), tokenizer_path())
    assert 0 < len(only) <= K.DICT_BYTES
