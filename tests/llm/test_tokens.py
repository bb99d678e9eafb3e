"""Token files against the tokenizer, and the number format on its own."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bytetext, tokens
from millrace.llm.model_queries import tokenizer_path
from millrace.llm.queries import QUERIES

from ..conftest import SF


@pytest.fixture(scope="module")
def pieces():
    return tokens.Pieces(tokenizer_path())


def encoded(pieces, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])
    out = []
    for _, data, off in bytetext.slices([batch], [], "t", 1 << 12):
        ids, count = tokens.encode_slice(pieces, data, off)
        ends = np.cumsum(count)
        out += [ids[a:b].tolist() for a, b in zip(ends - count, ends)]
    return out


PARTS = ["a", "B", "é", "'", "s", "'t", " ", "  ", "\n", "\t", ".", ",", "!!", "7", "²", "—", " ", "<|", "<|endoftext|>", "ß", "日本", "\r\n", "_",
         "$", "\x00", "\x1c", "ÿ", "×", "ɐ", "😀", "¿", "d'", "10", " ", "́", "ª"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=1, max_size=8))
def test_pieces_give_the_tokenizers_ids(texts):
    p = tokens.Pieces(tokenizer_path()) if not hasattr(test_pieces_give_the_tokenizers_ids, "p") else test_pieces_give_the_tokenizers_ids.p
    test_pieces_give_the_tokenizers_ids.p = p
    assert encoded(p, texts) == [e.ids for e in p.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_forgetting_keeps_the_ids(pieces, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 50)
    rnd = random.Random(1)
    texts = [" ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 6))) for _ in range(200)) for _ in range(40)]
    assert encoded(pieces, texts) == [e.ids for e in pieces.tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 70000), max_size=60))
def test_numbers_come_back(numbers):
    x = np.array(numbers, np.uint32)
    control, data = tokens.pack(x)
    assert len(control) == (len(x) + 3) // 4
    assert len(data) == sum(max(1, (int(n).bit_length() + 7) // 8) for n in x)
    assert tokens.unpack(control, data, len(x)).tolist() == numbers


def test_block_comes_back():
    raw = tokens.block_bytes([3, None, -7], np.array([2, 1, 300], np.uint32), np.arange(303, dtype=np.uint32) * 999)
    ids, counts, ranks = tokens.read_block(raw)
    assert ids == [3, None, -7] and counts.tolist() == [2, 1, 300] and ranks.tolist() == [k * 999 for k in range(303)]
    with pytest.raises(ValueError):
        tokens.read_block(b"none" + raw[4:])


def expected(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, QUERIES["op2_token_ids"](spark, SF).collect()))
    assert got == sorted(expected(docs))


def test_edges(spark):
    rows = [(5, None), (None, "no id"), (2, ""), (2, ""), (7, "long " * 200000), (9, "<|endoftext|> x"), (-3, "é\n\nz"), (8, "same"), (8, "same")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, part string, start int").repartition(4)
    manifest, ranks = tokens.encode(spark, df, tokenizer_path())
    got = sorted(map(tuple, tokens.read(manifest, ranks).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    assert len(ranks) == 50257 and sorted(ranks.tolist()) == list(range(50257))
    empty, order = tokens.encode(spark, df.limit(0), tokenizer_path())
    assert tokens.read(empty, order).count() == 0


def test_frequent_ids_come_first(spark):
    df = spark.createDataFrame([(1, "the the the the the cat"), (2, "the the")], "doc_id long, text string")
    blocks = tokens.tokenized(df, "doc_id", "text", tokenizer_path(), 2)
    ranks = tokens.ranking(blocks, 50257)
    from tokenizers import Tokenizer

    the = Tokenizer.from_file(tokenizer_path()).encode(" the").ids[0]
    assert ranks[0] == the


def thue_morse(n, letters="ab"):
    """Two words of ``n`` letters that meet under every polynomial modulo a power of two."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join(letters[b] for b in bits[:n]), "".join(letters[1 - b] for b in bits[:n])


def test_words_made_to_meet(pieces):
    a, b = thue_morse(2048)
    pieces.forget()
    assert encoded(pieces, [a, b, f"x {a} y", f"x {b} y"]) == pieces.whole([a, b, f"x {a} y", f"x {b} y"])
    raw = np.frombuffer((a + b).encode(), np.uint8)
    assert len(set(bytetext.span_hashes(raw, np.array([0, 2048]), np.array([2048, 4096])).tolist())) == 2


def test_pieces_under_one_hash(pieces, monkeypatch):
    monkeypatch.setattr(bytetext, "span_hashes", lambda data, start, end, which=0: (end - start).astype(np.uint64) % np.uint64(3))
    pieces.forget()
    texts = ["one two three four", "six two four one", "", "alpha beta; gamma, delta", "one two"]
    assert encoded(pieces, texts) == pieces.whole(texts) and encoded(pieces, texts[::-1]) == pieces.whole(texts[::-1])
    pieces.forget()


def test_hashes_of_ranges_of_long_texts():
    """The same bytes have the same hash wherever they stand, also past the table of powers."""
    rnd = random.Random(6)
    part = rnd.randbytes(3000)
    data = np.frombuffer(rnd.randbytes(bytetext._BLOCK - 1500) + part + rnd.randbytes(bytetext._BLOCK) + part + b"!", np.uint8)
    first, second = bytetext._BLOCK - 1500, 2 * bytetext._BLOCK + 1500
    at = np.arange(0, 2900, 7)
    for which in (0, 1):
        h = bytetext.hasher(data, which)
        assert np.array_equal(h(first + at, first + at + 60), h(second + at, second + at + 60))
