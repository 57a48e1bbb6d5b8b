"""Patched frame-of-reference blocks and token files, by exact round trips."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Regex, Tokenizer, pre_tokenizers

from graphloom.llm import pfor, token_coder
from graphloom.llm.queries import QUERIES
from graphloom.llm.token_coder import Coder
from graphloom.llm.token_files import Reader, place, read_tokens, write_tokens

FILE = public_tokenizers.path("byte_bpe_50k.json")
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(FILE)
    found.encode_special_tokens = True
    return found


@pytest.fixture(scope="module")
def coder():
    return Coder(FILE)


def wanted(tokenizer, rows):
    """(doc_id, start, ids) by encoding one text after the other."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("make", [
    lambda rng: rng.integers(0, 1 << 32, 1000, dtype=np.uint32),
    lambda rng: rng.integers(5, 9, 1280, dtype=np.uint32),
    lambda rng: np.full(300, 7, np.uint32),
    lambda rng: np.where(rng.random(5000) < 0.03, 4_000_000_000, rng.integers(0, 50, 5000)).astype(np.uint32),
    lambda rng: np.zeros(0, np.uint32),
    lambda rng: np.array([0xFFFFFFFF], np.uint32),
])
def test_blocks_round_trip(make):
    values = make(np.random.default_rng(3))
    data, start = pfor.encode(values)
    got = pfor.decode(np.frombuffer(data, np.uint8), start)
    assert len(start) == -(-len(values) // pfor.BLOCK)
    assert (got[:len(values)] == values).all()


def test_outliers_do_not_widen_a_block():
    values = np.arange(128, dtype=np.uint32) % 16
    plain = len(pfor.encode(values)[0])
    values[77] = 3_000_000_000
    assert len(pfor.encode(values)[0]) == plain + 5  # a position and a value


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab'sé .,\n\t  \x1c<|>1", max_size=30), max_size=8))
def test_remembered_pieces_give_the_ids_of_whole_texts(coder, texts):
    got = coder.encode(texts)
    assert [x.tolist() for x in got] == [
        e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_files_round_trip(spark, tokenizer, tmp_path):
    texts = ["some words <|endoftext|> here", None, "", "x" * 500, "two  spaces \n here ", "ü€😀 q"]
    rows = [(i * 7 % 50, texts[i % 6]) for i in range(50)] + [(None, "no id"), (3, "again"), (900, "w " * 9000)]
    df = spark.createDataFrame([(*r, 5, "f") for r in rows],
                               "doc_id bigint, text string, start int, file string")
    folder = f"file://{tmp_path}/ids"
    files = write_tokens(df, folder, FILE)
    got = read_tokens(spark, files, folder).collect()
    # Rows of equal ids may follow each other in either order; ids and starts settle the rest.
    ordered = sorted(got, key=lambda r: r["start"])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == [
        (r["doc_id"] is not None, r["doc_id"] or 0) for r in ordered]
    start = 0
    for r in ordered:
        assert r["start"] == start and r["n_tokens"] * 4 == len(r["ids"])
        start += r["n_tokens"]
    by_text = sorted((r["doc_id"] or -1, np.frombuffer(r["ids"], "<u4").tolist()) for r in got)
    assert by_text == sorted((i or -1, ids) for i, _, ids in wanted(tokenizer, rows))
    assert sum(r["n_ids"] for r in files.collect()) == start
    fs, base = place(folder)
    part = files.orderBy("part").first()
    with fs.open_input_file(f"{base}/{part['file']}") as source:
        reader = Reader(source)
        every = reader.ids(0, reader.n_ids)
        assert (reader.ids(3, min(200, reader.n_ids)) == every[3:200]).all()
    assert not [name for name in os.listdir(base) if name.startswith(".part")]


def test_equal_ids_spread_and_empty_tables(spark, tokenizer, tmp_path):
    df = spark.createDataFrame([(1, f"text {i}") for i in range(300)], "doc_id bigint, text string")
    files = write_tokens(df, f"{tmp_path}/one", FILE)
    assert files.count() > 1 and sum(r["n_docs"] for r in files.collect()) == 300
    none = write_tokens(df.filter("false"), f"{tmp_path}/none", FILE)
    assert none.count() == 0 and read_tokens(spark, none, f"{tmp_path}/none").collect() == []


def test_query_against_the_library(spark, tokenizer):
    rows = sorted((r["doc_id"], r["text"]) for r in
                  spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    df = QUERIES["op13_token_files"](spark, SF_DIR)
    assert dict(df.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint",
                               "ids_crc32": "bigint"}
    assert sorted(map(tuple, df.collect())) == [
        (i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, s, x in wanted(tokenizer, rows)]


def test_frequent_pieces_outlive_a_full_memory(monkeypatch):
    monkeypatch.setattr(token_coder, "MOST_PIECES", 50)
    coder, seen = Coder(FILE), []
    library = coder.library
    monkeypatch.setattr(coder, "library", lambda texts, *a, **k: (seen.extend(texts), library(texts, *a, **k))[1])
    for i in range(40):
        texts = [f"the word é, of {' '.join(f'w{i}x{j}' for j in range(8))}", f"odd\t{i} the\n"]
        assert [x.tolist() for x in coder.encode(texts)] == [
            e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert len(coder.number) == len(coder.size) == len(coder.uses) < 80
    assert sum("word" in text for text in seen) == 1


def test_a_word_is_encoded_once_with_and_without_marks(monkeypatch):
    coder, seen = Coder(FILE), []
    library = coder.library
    monkeypatch.setattr(coder, "library", lambda texts, *a, **k: (seen.extend(texts), library(texts, *a, **k))[1])
    texts = ["Some erndinti, words erndinti. here erndinti", "erndinti: it's, 'tis! a1, ß; ª? x,, ,", "É. no. \n"]
    for _ in range(2):
        assert [x.tolist() for x in coder.encode(texts)] == [
            e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert sum(" ".join(seen).split().count(w) for w in ("erndinti", "erndinti,", "erndinti.")) == 2


def test_other_tokenizers_keep_words_and_marks_together(tmp_path):
    file = str(tmp_path / "joining.json")
    joining = Tokenizer.from_file(FILE)
    joining.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(r" ?\S+|\s+"), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    joining.save(file)
    coder = Coder(file)
    texts = ["Dr. Who, e.g. it. a, of, the. no!", "U.S. dollars."]
    assert not coder.marks and [x.tolist() for x in coder.encode(texts)] == [
        e.ids for e in joining.encode_batch(texts, add_special_tokens=False)]
