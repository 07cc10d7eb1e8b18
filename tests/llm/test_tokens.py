"""Ids, bit packing, token files and packing: exact round trips against the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quillsift.llm import packing, tokenfile
from quillsift.llm.encoding import Encoder, ids_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    (5, "a  b"), (1, None), (2, ""), (9, " lead and trail "), (3, "don't <|endoftext|> stop. Now, été\n \n x\ty"), (3, "same id"),
    (7, "word " * 5000), (8, "x" * 60_000), (4, "same id"), (None, "no id"), (6, "日本 語  x\u00a0 y\x1c z"),
]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def pieces():
    return Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab.,' \n\t1é日_\u00a0\x1c", "'s", "  ", "Word", "ﬁ", "<|endoftext|>", "&&&", "!\n?", "\u0301", "²", "Ⅷ", "\r\n"]), max_size=40))
def test_pieces_encode_like_the_whole(whole, pieces, parts):
    text = "".join(parts)
    assert ids_of(pieces.encode(text)).tolist() == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.integers(0, 300), st.randoms(use_true_random=False))
def test_bits_round_trip(width, n, random):
    ids = np.array([random.randrange(1 << width) for _ in range(n)], dtype=np.uint32)
    data = tokenfile.pack(ids, width)
    assert len(data) == -(-n // 64) * width * 8
    assert tokenfile.unpack(data, width, n).tolist() == ids.tolist()
    assert all(tokenfile.id_at(data, width, i) == ids[i] for i in range(0, n, 7))


def test_too_wide_ids_are_refused():
    with pytest.raises(ValueError):
        tokenfile.pack(np.array([8]), 3)


def expected(whole, end):
    return [(i, [*whole.encode(t or "", add_special_tokens=False).ids, end]) for i, t in TEXTS]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_file(spark, whole, tmp_path):
    df = spark.createDataFrame([(i, t, 0) for i, t in TEXTS], "doc_id long, text string, shard int")
    tokenfile.write_token_file(df, f"{tmp_path}/f", PATH, block_ids=500)
    got = sorted(tokenfile.read_token_file(spark, f"{tmp_path}/f").collect(), key=lambda r: r.start)
    docs = expected(whole, 0)
    assert [r.doc_id for r in got] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i))
    assert sorted(map(str, ((r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got))) == sorted(map(str, ((i, len(x), crc(x)) for i, x in docs)))
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    tokenfile.write_token_file(df.limit(0), f"{tmp_path}/empty", PATH)
    assert tokenfile.read_token_file(spark, f"{tmp_path}/empty").count() == 0


def check_plan(lengths, made, window):
    order = np.lexsort((made["start"], made["document"]))
    seen = {}
    for d, s, n in zip(*(made[k][order] for k in ("document", "start", "length"))):
        assert n > 0 and s == seen.get(d, 0)
        seen[d] = s + n
    assert seen == {i: n for i, n in enumerate(lengths) if n}
    order = np.lexsort((made["offset"], made["sequence"]))
    filled = {}
    for q, o, n in zip(*(made[k][order] for k in ("sequence", "offset", "length"))):
        assert o == filled.get(q, 0)
        filled[q] = o + n
    assert all(n <= window for n in filled.values()) and sorted(filled) == list(range(len(filled)))
    return len(filled)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=120), st.sampled_from([(64, 8), (64, 1), (50, 8), (128, 16)]))
def test_plans_place_every_id_once(lengths, shape):
    window, grain = shape
    check_plan(lengths, packing.plan(np.array(lengths, dtype=np.int64), window, grain), window)


def test_padding_is_small_with_a_hot_length():
    lengths = np.concatenate([np.full(2000, 700), np.random.default_rng(1).integers(1, 6000, 4000)])
    n = check_plan(lengths.tolist(), packing.plan(lengths), 2048)
    assert lengths.sum() / (n * 2048) > 0.99


def test_least_squares_is_optimal():
    rng = np.random.default_rng(0)
    shapes = packing.combinations(16, 3)
    matrix = np.zeros((17, len(shapes)))
    for m in range(3):
        np.add.at(matrix, (shapes[:, m], np.arange(len(shapes))), 1.0)
    matrix[0] = 0
    target = rng.integers(0, 50, 17).astype(float)
    target[0] = 0
    x = packing.nnls(matrix, shapes, target)
    gradient = matrix.T @ (target - matrix @ x)
    assert (x >= 0).all() and gradient.max() < 0.1 and np.abs(gradient[x > 1e-6]).max() < 0.1


def test_packed_documents(spark, whole):
    df = spark.createDataFrame([(i, t, 0) for i, t in TEXTS], "doc_id long, text string, length int").repartition(3)
    got = packing.pack_documents(df, PATH, unit_ids=4000).collect()
    parts = {}
    for r in sorted(got, key=lambda r: r.start):
        parts.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    docs = expected(whole, 1)
    same = [x for i, x in docs if i == 3]
    for (i, n), rows in parts.items():
        ids = b"".join(bytes(r.ids) for r in rows)
        assert any(i == j and len(x) == n and crc(x) == zlib.crc32(ids) for j, x in docs)
    assert len(parts) == len(docs) and len(same) == 2
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0) and r.length * 4 == len(r.ids)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
