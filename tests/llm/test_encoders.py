import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from filecover.llm.byte_bpe import byte_bpe, byte_bpe_digests, encoder, vocabulary
from filecover.llm.token_files import TokenReader, TokenWriter, from_planes, to_planes, write_tokens

RANKS = vocabulary("byte_bpe_50k.tiktoken")
WORDS = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_are_the_librarys(library):
    ours, draw = encoder(RANKS, public_tokenizers.PATTERN), random.Random(4)
    for _ in range(1500):
        text = "".join(draw.choice("aab c\n1'sé世ñ😀\t the.ing<|endoftext|>") for _ in range(draw.randint(0, 70)))
        ids = np.frombuffer(ours.encode(text), "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert ours.decode(ours.encode(text)) == text.encode()
    for text in ("a" * 50_000, "abcdefghij" * 2000, " " * 3000, "̀" * 500):
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_rows(sample, nothing, library):
    rows, docs = sample
    got = Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in byte_bpe(docs, RANKS, public_tokenizers.PATTERN).collect())
    ids = lambda t: np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
    assert got == Counter((r[0], ids(r[1]), (r[1] or "").encode()) for r in rows)
    digests = Counter(map(tuple, byte_bpe_digests(docs, RANKS, public_tokenizers.PATTERN).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digests == Counter((r[0], len(ids(r[1])) // 4, sha(ids(r[1])), sha((r[1] or "").encode())) for r in rows)
    assert byte_bpe(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("planes", [4, 32])
def test_planes_round_trip(planes, tmp_path):
    draw = np.random.default_rng(1)
    for n in (1, 7, 8, 4096):
        ids = draw.integers(0, 1 << draw.integers(1, 32), n, np.uint32)
        assert np.array_equal(from_planes(to_planes(ids, planes), n), ids)
    lengths = draw.integers(0, 50, 300)
    ids = draw.integers(0, 50_000, int(lengths.sum()), np.uint32)
    out, cut = TokenWriter(planes, 256), int(lengths[:120].sum())
    out.add(np.arange(120), np.ones(120, bool), lengths[:120], ids[:cut])
    out.add(np.arange(120, 300), np.arange(180) > 3, lengths[120:], ids[cut:])
    out.close(f"file://{tmp_path}/x/one.tok")
    read = TokenReader(f"{tmp_path}/x/one.tok")
    assert np.array_equal(read.lengths, lengths) and read.known.sum() == 296 and read.n_ids == len(ids)
    for a, b in ((0, len(ids)), (5, 5), (255, 257), (1000, 3000)):
        assert np.array_equal(read.ids(a, b), ids[a:b])


@pytest.mark.parametrize("planes", [4, 32])
def test_files(sample, nothing, planes):
    rows, docs = sample
    tokenizer = Tokenizer.from_file(WORDS)
    coded = [(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]
    raw = lambda ids: np.array(ids, "<u4").tobytes()
    coded.sort(key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    want, at = [], 0
    for doc, ids in coded:
        want.append((doc, at, len(ids), zlib.crc32(raw(ids))))
        at += len(ids)
    files = write_tokens(docs, WORDS, 2, planes=planes, block=512)
    assert sorted(map(tuple, files.documents().collect()), key=lambda r: r[1]) == want
    assert write_tokens(nothing, WORDS, 2).documents().count() == 0


def test_added_tokens_are_the_librarys(spark):
    tokenizer = Tokenizer.from_file(WORDS)  # as it is loaded: it recognises its added tokens
    texts = [
        "before, plain. Words", "a<|endoftext|>b", "<|ENDOFTEXT|> stays text", "One, <|startoftext|>. Two <|endoftext|><|endoftext|>!",
        "<|EndOfText|>x <|endoftext|>\u0301 E\u0301, <|endof text|>", "", "<|endoftext|>", "after: plain words <|other|>",
    ]
    want, at = [], 0
    for doc, text in enumerate(texts):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(map(tuple, write_tokens(docs, WORDS, 2).documents().collect())) == want
