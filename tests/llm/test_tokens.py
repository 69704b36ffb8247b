import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wardlight.llm import queries, tokens, vbyte
from wardlight.llm.common import read

SF = "/root/testdata/sf0.001"
FILE = tokens.public_tokenizer("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["", " ", "  ", "a  ", " \n a", "a\n\n\nb", "x　y  z\xa0", "\x01a \x01", "a <|endoftext|> b  <|endoftext|>", "it's ###, 12a",
       "a\x1c \x1cb", "\r\n\r\n x", "é́ ​﻿ ", "<|endoftext|><|endoftext|>\n", "many\t\tspaces   here .\n"]


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_library(spark):
    enc = tokens.Encoder(FILE)
    texts = ODD + [r.text for r in read(spark, SF, "documents").collect()]
    for _ in range(2):
        flat, lengths = enc.ids(pa.array(texts))
        got = [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])]
        assert got == [library(t) for t in texts]


def test_every_known_sign_is_treated_as_the_library_does():
    other = re.compile(tokens._OTHER)
    signs = [chr(c) for c in range(0x450) if not other.match(chr(c))]
    assert len(signs) > 500
    enc = tokens.Encoder(FILE)
    texts = [t for c in signs for t in (f"a{c}", f" {c}1", f"7{c}.", f"{c}'{c}", f"'s{c} 've{c}", f"{c}{c}{c}a {c} {c}  ")]
    flat, lengths = enc.ids(pa.array(texts))
    assert [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] == [library(t) for t in texts]


def test_long_texts_are_parted_in_runs(monkeypatch):
    monkeypatch.setattr(tokens, "_RUN", 7)
    monkeypatch.setattr(tokens, "CACHED", 3)
    texts = ["it's a   long text, isn't  it? \n yes 12 34ab " * 9, "unbroken" * 30, "é è ê " * 20, " x" * 40, "a 中 b" * 9]
    flat, lengths = tokens.Encoder(FILE).ids(pa.array(texts))
    assert [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] == [library(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab.,'s1tveldm²½ßΩжẞ中٣ª \n\t\xa0　\x01|<>é")), max_size=30), min_size=1, max_size=4))
def test_cuts_do_not_change_ids(texts):
    flat, lengths = tokens.encoder(FILE).ids(pa.array(texts))
    assert [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] == [library(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_round_trip(values):
    control, data = vbyte.encode(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert vbyte.decode(control, data, len(values)).tolist() == values


def test_files_hold_all_documents_in_order(spark):
    rows = [(5, "b c"), (1, None), (None, "x"), (3, ""), (3, "tie"), (3, "tie"), (9, "long " * 60_000), (-4, "ODD  <|endoftext|>")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, ids string, start int")
    manifest, by_rank = vbyte.write_tokens(docs, FILE, 0, block_tokens=4)
    got = sorted(vbyte.read_tokens(manifest, by_rank).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -4, 1, 3, 3, 3, 5, 9]
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    ids = lambda raw: np.frombuffer(raw, "<u4").tolist()
    assert sorted((str(r.doc_id), ids(r.ids)) for r in got) == sorted((str(i), [*library(t or ""), 0]) for i, t in rows)
    manifest, by_rank = vbyte.write_tokens(docs.limit(0), FILE, 0)
    assert vbyte.read_tokens(manifest, by_rank).count() == 0


def test_op3_query(spark):
    docs = sorted((r.doc_id, r.text) for r in read(spark, SF, "documents").collect())
    want, at = {}, 0
    for d, t in docs:
        ids = np.array([*library(t), 0], "<u4")
        want[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    got = queries.QUERIES["op3_token_files"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got.collect()} == want
