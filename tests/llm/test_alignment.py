import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from filecover.llm import alignment
from filecover.llm.alignment import Aligner, ByteLevel, Pieces, group_ends, irregular_groups, token_alignment

from .conftest import COLUMNS, rows_of, sample_texts

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    " ", "  ", "a", "a  b", "a   b", "\n", "a\n", "a \n", "a \n b", "\n\n  a", "x▁y", "a  b", "a　  b c", "<|endoftext|> <s> </s> x",
    "😀 ü\x00 \x7f", "tab\t\t x", "ends  ", " starts", "\x1c a", "a\x1c  b", "ﬁ Å ①", "\x85 a", "a \x85  b ​  c", "a\r\n  b", "don't  we'll", "x▁y and  more", "0" * 3000,
]


@pytest.fixture(scope="module")
def sides():
    return ByteLevel(A), Pieces(B)


def plain(text, sides):
    """n_a, n_b, digest and links from the offsets where both end."""
    spaced = f" {text}"
    a, b = (s.encode(spaced) for s in sides)
    if not text or any(s.bytes_of(x) != spaced.encode() for s, x in zip(sides, (a, b), strict=True)):
        return 0, 0, "", []
    ends = [np.cumsum([len(s.entries[i]) for i in x]).tolist() for s, x in zip(sides, (a, b), strict=True)]
    place = [{e: k + 1 for k, e in enumerate(own)} for own in ends]
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = place[0][end], place[1][end]
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        links.append((a[x - 1], b[y - 1]))
        i, j = x, y
    return len(a), len(b), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def test_entries_are_those_of_the_tokenizers(sides):
    assert sides[0].entries[sides[0].encode(" x")[0]] == b" x"
    assert sides[0].bytes_of(sides[0].encode(" é世\x00\n")) == " é世\x00\n".encode()
    assert sides[1].bytes_of(sides[1].encode(" é世\x00\n")) == " é世\x00\n".encode()


def test_run_skipping_against_common_ends():
    draw = random.Random(0)
    for _ in range(300):
        total = draw.randint(1, 400)
        density = draw.choice([0.02, 0.3, 0.9, 1.0])
        both = {i for i in range(1, total) if draw.random() < density}
        sides = [np.array(sorted({i for i in both if draw.random() < draw.choice([0.8, 1.0])} | {total}), np.int64) for _ in range(2)]
        last = group_ends(*sides)
        common = np.intersect1d(*sides)
        assert all((s[flag] == common).all() for s, flag in zip(sides, last, strict=True))
        for a, b, c, d in irregular_groups(*sides).tolist():
            assert (b - a, d - c) != (1, 1) and sides[0][b - 1] == sides[1][d - 1]


def test_texts_one_by_one(sides, monkeypatch):
    """Whatever white space or odd character a text holds, remembered or not, the tokens are those of the libraries."""
    texts = [t for t in sample_texts() if len(t) < 5000] + ODD
    aligner = Aligner(A, B)
    for remembered in (10**6, 0):
        monkeypatch.setattr(alignment, "REMEMBERED", remembered)
        got = aligner.aligned(texts)
        at = 0
        for i, text in enumerate(texts):
            n_a, n_b, digest, links = plain(text, sides)
            pairs = got["pairs"][at : at + got["n_groups"][i]]
            at += got["n_groups"][i]
            assert (got["n_a"][i], got["n_b"][i], got["groups_sha256"][i]) == (n_a, n_b, digest), text
            assert [(int(p) >> 16, int(p) & 0xFFFF) for p in pairs] == links


def test_against_brute_force(spark, sides, nothing):
    rows = rows_of([t for t in sample_texts() if len(t) < 5000] + ODD)
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    found = [plain(r[1] or "", sides) for r in rows]
    counts = Counter(link for *_, links in found for link in links)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = Counter(
        (r[0], n_a, n_b, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest)
        for r, (n_a, n_b, digest, links) in zip(rows, found, strict=True)
    )
    got = token_alignment(docs, A, B)
    assert Counter(map(tuple, got.collect())) == want
    assert token_alignment(nothing, A, B).count() == 0
