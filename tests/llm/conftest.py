import random
import re

import pytest

SPACE = r"\x20\x09-\x0D"
WORD = re.compile(f"[^{SPACE}]+")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, size string, part int, shard int, ids string, root string"


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sample_texts(seed=5, n=60):
    """Invented texts with copies, near copies, shared passages, repeated lines, odd characters and one long text."""
    draw = random.Random(seed)
    vocab = ["".join(draw.choice("abdeiklmnorstuéßñ世") for _ in range(draw.randint(1, 9))) for _ in range(180)]

    def text(k):
        return "".join(draw.choice(vocab) + draw.choice([" ", " ", " ", ", ", ". ", "\n", "\t"]) for _ in range(k))

    base = [text(draw.randint(1, 160)) for _ in range(n)]
    passage = text(60)
    for i in range(0, n, 5):
        base.append(base[i])
    for i in range(1, n, 4):
        parts = base[i].split(" ")
        parts[len(parts) // 2] = "Edited"
        base.append(" ".join(parts))
    for i in range(2, n, 6):
        base.append(base[i] + passage + base[i + 1])
    line = text(9).replace("\n", " ")
    base += ["\n".join([line] * 6 + [text(30)]), "x" * 700, "ab" * 500, text(4000), "", " ", "\n\t ", "Ünïcode 😀 '' don't #*$", "one two three"]
    return base


def rows_of(texts):
    odd = lambda i: (f"k{i % 3}", f"s{i}", i % 4, i % 5, "x", "r")
    rows = [(i, t, "en", f"src{i % 4}" if i % 11 else None, len(t), *odd(i)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (len(rows), None, None, "src1", None, *odd(1)), (None, "an unknown id has a text", "en", "src2", 3, *odd(2)), (None, None, None, None, None, *odd(3))]
    return rows


@pytest.fixture(scope="session")
def sample(spark):
    rows = rows_of(sample_texts())
    return rows, spark.createDataFrame(rows, COLUMNS).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
