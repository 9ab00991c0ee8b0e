import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from priorwise.llm import packing
from priorwise.llm.queries import vocabulary

DOCS = "doc_id long, text string, DOC_TOKENS string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return packing.BpeEncoder(vocabulary())


def encoded(encoder, texts):
    import pyarrow as pa

    return [ids[b[i] : b[i + 1]].tolist() for lo, hi, ids, b in encoder(pa.array(texts, pa.string())) for i in range(hi - lo)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abAé 　  \u0085\n\t.,!'s1€ß|<>​中\r\x1c")), max_size=40), max_size=6))
def test_ids_are_those_of_the_tokenizer(tokenizer, encoder, texts):
    assert encoded(encoder, texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_special_strings_are_text(tokenizer, encoder):
    texts = ["a <|endoftext|> b", "", "don't we'll", "x" * 5000, "word. Next\nLine, end"]
    assert encoded(encoder, texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def check(pieces, docs, tokenizer, window):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for doc, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    used = {}
    for s, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        used[s] = at
    return used


@pytest.mark.parametrize("parts,open_windows", [(1, 4), (7, 2)])
def test_every_id_in_one_piece_and_little_padding(spark, tokenizer, parts, open_windows):
    docs = [(i, None if i % 17 == 3 else "word apple, pear. " * (i * i % 37) + "\nend " * (i % 5), "x") for i in range(120)]
    df = spark.createDataFrame(docs, DOCS).repartition(parts)
    out = packing.pack_documents(df, vocabulary(), window=64, open_windows=open_windows, min_cut=4, fan_in=2)
    pieces = out.collect()
    assert all(np.frombuffer(p.ids, "<u4").size == p.length for p in pieces)
    used = check(pieces, [d[:2] for d in docs], tokenizer, 64)
    assert sum(used.values()) > 0.93 * 64 * len(used)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], DOCS)
    assert packing.pack_documents(df, vocabulary()).count() == 0
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "c", "x"), (2, "", None)], DOCS)
    out = packing.pack_documents(df, vocabulary(), keep_ids=False).collect()
    assert len(out) == 4 and "ids" not in out[0]
    assert len({(p.sequence_id, p.offset) for p in out}) == 4


def test_blank_lines(tokenizer, encoder):
    texts = ["a.\n\nNext", "One\n\n\nTwo\nThree", "a\n \nb", "\n\na\n\n", "x\n\n\n\ny é\n\né z", "Line,\n\n- item\n- item\n\n\tTab"]
    assert encoded(encoder, texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
