import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from filecover.llm.common import crc_rest
from filecover.llm.language_model import discounts, score, train

from .conftest import lowered, words


class Plain:
    """The same model from dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.raw = Counter(w for t in texts for w in [*words(lowered(t)), "</s>"])
        grams = Counter()
        for t in texts:
            tokens = ["<s>"] * (order - 1) + [*words(lowered(t)), "</s>"]
            grams.update(tuple(tokens[i - order + 1 : i + 1]) for i in range(order - 1, len(tokens)))
        self.counts = {order: grams}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.sums, self.contexts = {}, {}
        for k, counts in self.counts.items():
            of = Counter(counts.values())
            self.sums[k] = [0, 0, 0, of[1], of[2], of[3], of[4], 0]
            self.contexts[k] = defaultdict(lambda: [0, 0, 0, 0])
            for g, c in counts.items():
                row = self.contexts[k][g[:-1]]
                row[0] += c
                row[min(c, 3)] += 1

    def probability(self, gram):
        p = 1 / (len(self.raw) + 1)
        for k in range(1, self.order + 1):
            own = gram[-k:]
            total, *kinds = self.contexts[k][own[:-1]]
            if total:
                gives = discounts(self.sums[k])
                c = self.counts[k][own]
                p = (max(c - gives[min(c, 3) - 1], 0) if c else 0) / total + sum(g * n for g, n in zip(gives, kinds, strict=True)) / total * p
        return p

    def score(self, text):
        tokens = ["<s>"] * (self.order - 1) + [*words(lowered(text)), "</s>"]
        return sum(math.log10(self.probability(tuple(tokens[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(tokens)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_dictionaries(sample, order):
    rows, docs = sample
    marked = docs.withColumn("held", crc_rest("doc_id", 7) == 2)
    held = {(r.doc_id, r.text): r.held for r in marked.select("doc_id", "text", "held").collect()}
    plain = Plain([r[1] for r in rows if not held[r[0], r[1]]], order)
    n, v = sum(plain.raw.values()), len(plain.raw)
    model = train(marked.where(~F.col("held")), order)
    assert (model.train_tokens, model.vocabulary) == (n, v)
    texts = {(r[0]): r[1] for r in rows}
    got = score(marked, model, flag="held").collect()
    assert len(got) == len(rows)
    for r in got:
        tokens = [*words(lowered(texts[r.doc_id] if r.doc_id is not None else ("an unknown id has a text" if r.n_tokens > 1 else None))), "</s>"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(plain.raw[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((plain.raw[t] + 1) / (n + v + 1)) for t in tokens))
        assert r.score == pytest.approx(plain.score(" ".join(tokens[:-1])))
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))


def test_probabilities_sum_to_one(sample):
    rows, _ = sample
    plain = Plain([r[1] for r in rows], 2)
    for context in ["<s>", *list(plain.raw)[:5], "never seen"]:
        total = sum(plain.probability((context, w)) for w in plain.raw) + plain.probability((context, "never seen"))
        assert total == pytest.approx(1)


def test_nothing_to_learn(sample, nothing):
    _, docs = sample
    model = train(nothing.select("text"), 2)
    assert (model.train_tokens, model.vocabulary) == (0, 0)
    assert {(r.n_known, r.score) for r in score(docs, model).collect()} == {(0, 0.0)}
    assert score(nothing, model).count() == 0
