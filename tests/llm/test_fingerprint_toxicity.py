import hashlib
import random

import numpy as np
import xxhash

from filecover.llm.phrase_fingerprint import SIZE, likeness, parse, phrase_fingerprints
from filecover.llm.toxicity import VOTERS, LabelModel, op10_toxicity, toxicity

SF = "/root/testdata/sf0.01"


def phrases(text):
    seen, own = set(), ""
    for c in text:
        own += c
        if own not in seen:
            seen.add(own)
            own = ""
    return seen


def printed(text):
    return "".join(f"{h:08x}" for h in sorted({xxhash.xxh3_64_intdigest(p) >> 32 for p in phrases(text)})[:SIZE])


def test_parse_goes_on_where_it_stopped():
    draw = random.Random(2)
    for _ in range(500):
        text = "".join(draw.choice("abß ") for _ in range(draw.randint(0, 80)))
        cut, seen = draw.randint(0, len(text)), set()
        at, front = parse(text, 0, cut, seen)
        _, rest = parse(text, at, len(text), seen)
        assert set(front + rest) == phrases(text) == seen


def test_fingerprints(sample, nothing, spark):
    rows, docs = sample
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    got = {}
    for r in phrase_fingerprints(docs).collect():
        got.setdefault((r.doc_id, r.n_chars), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, row in enumerate(order):
        text, after = row[1] or "", order[(i + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        want = (hashlib.sha256(edited.encode()).hexdigest(), printed(text), printed(edited))
        found = [r for r in got[row[0], len(text)] if (r.edited_sha256, r.fingerprint, r.edited_fingerprint) == want]
        assert found and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert phrase_fingerprints(nothing).count() == 0
    alone = phrase_fingerprints(spark.createDataFrame([(5, "abcabd")], "doc_id bigint, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and alone.near_next == 1


def test_likeness_estimates_the_share():
    draw = np.random.default_rng(0)
    for share in (0.0, 0.3, 0.8, 1.0):
        found = []
        for _ in range(60):
            both = draw.integers(0, 1 << 32, 2000, np.uint64).astype(np.uint32)
            n = int(2000 * share)
            rest = (2000 - n) // 2
            a, b = np.concatenate([both[:n], both[n : n + rest]]), np.concatenate([both[:n], both[n + rest :]])
            found.append(likeness(np.unique(a)[:SIZE], np.unique(b)[:SIZE]))
        assert abs(np.mean(found) - share) < 0.03


def test_label_model_finds_accuracies_without_labels():
    """Voters of known accuracy, two of them copies of one: the copies are modelled together, and not counted twice."""
    draw = np.random.default_rng(3)
    n, truth = 20_000, np.random.default_rng(4).random(20_000) < 0.2
    votes = np.zeros((n, len(VOTERS)), np.int8)
    for j, (hit, false) in enumerate([(0.8, 0.02), (0.7, 0.05), (0.6, 0.1), (0.7, 0.02), (0.5, 0.05)]):
        votes[:, j] = draw.random(n) < np.where(truth, hit, false)
    votes[:, 5] = votes[:, 2]
    patterns, back, weight = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = LabelModel(0.2).fit(patterns, weight.astype(float))
    assert any({2, 5} <= set(g) for g in model.groups)
    p = model.posterior(patterns)[back.ravel()]
    assert ((p >= 0.5) == truth).mean() > 0.95
    assert abs(p[(p > 0.2) & (p < 0.8)].mean() - truth[(p > 0.2) & (p < 0.8)].mean()) < 0.15


def test_toxicity(spark):
    rows = op10_toxicity(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    known = rows.merge(labels, on="doc_id")
    held = known[known.held_out]
    assert len(rows) == 1000 and len(held) > 50
    assert (held.predicted == held.toxic).mean() > 0.9
    # Better than calling every text clean: most toxic ones are found, and what is found is toxic.
    caught = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert caught >= 0.5 * (held.toxic == 1).sum() and caught >= 0.8 * (held.predicted == 1).sum()
    assert ((known.predicted == 1) & (known.toxic == 0)).sum() <= 3
    assert ((rows.score >= 0.5) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()


def test_toxicity_of_odd_rows(sample, nothing, spark):
    rows, docs = sample
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60, 3)] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    assert toxicity(docs, labels).count() == len(rows)
    low = toxicity(docs, labels.where("false")).collect()
    assert len(low) == len(rows) and all(r.predicted == 0 for r in low)
    assert toxicity(nothing, labels).count() == 0


def predicted(spark, docs, toxic, labelled=None):
    """Texts by id, the ids of toxic ones, and of those with a label (all): the ids that are predicted as toxic."""
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in labelled or docs], "doc_id bigint, toxic int")
    rows = toxicity(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4), labels)
    return {r.doc_id for r in rows.where("predicted = 1").collect()}


def test_near_copies_of_one_text_hide_no_others(spark):
    draw = random.Random(8)
    common, bad = [f"w{i}" for i in range(300)], [f"x{i}z" for i in range(30)]
    docs = {i: " ".join(draw.choices(common, k=30) + (draw.sample(bad, 4) if i < 150 else [])) for i in range(900)}
    toxic = set(range(150))
    copied = [f"y{i}z" for i in range(40)]
    for i in range(1000, 5000):
        docs[i] = " ".join(w for w in copied if draw.random() > 0.1)
        toxic.add(i)
    found = predicted(spark, docs, toxic)
    assert len(found & set(range(150))) >= 145 and len(found & set(range(150, 900))) <= 5


def test_rare_toxic_terms_behind_many_frequent_words(spark):
    """24,000 words stand in more toxic texts than the toxic terms do."""
    draw = random.Random(9)
    letters = "abcdefghijklmnopqrst"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters][::6][:24_000]
    docs = {i: " ".join(draw.sample(words, 14_000) + (["zzz1", "zzz2"] if i < 15 else [])) for i in range(230)}
    for i in range(300, 360):
        docs[i] = " ".join([*draw.sample(words, 20), "zzz1", "zzz2"] if i < 312 else draw.sample(words, 20))
    found = predicted(spark, docs, set(range(60)), range(230))
    assert found >= set(range(300, 312)) and not found & set(range(312, 360))


def test_rows_of_the_fit_at_any_size():
    """About as many hashes lie below the bound as are wanted, also where they are one in ten billion."""
    from filecover.llm.toxicity import _below

    for wanted, total in ((10, 10**11), (50_000, 60_000), (50_000, 10**15)):
        share = (_below(wanted, total) + (1 << 63)) / 2**64
        assert share > 0 and abs(share * total - wanted) < 1e-3 * wanted


def test_remembered_words_have_the_terms_of_new_ones(monkeypatch):
    """Terms by slice are the same whether a worker remembers all words, has just met them, or forgets at every slice."""
    import pyarrow as pa

    from filecover.llm import toxicity as module

    slices = [pa.array(t, pa.large_string()) for t in (["Words, and (more) WORDS!", "", "... -"], ["more other words", "länger längere"], ["words"])]

    def found():
        out = []
        for text in slices:
            terms = module.Terms(text)
            hashes, codes = terms.named()
            doc, code = terms.pairs(codes)
            out.append((terms.n.tolist(), sorted(zip(doc.tolist(), hashes[code].tolist(), strict=True))))
        return out

    for remembered in (10**6, 0):
        monkeypatch.setattr(module, "REMEMBERED", remembered)
        got = found()
        for text, (_, pairs) in zip(slices, got, strict=True):
            want = set()
            for doc, t in enumerate(text.to_pylist()):
                for w in t.lower().split():
                    bare = w.strip(module.MARKS)
                    for term in [bare, *(f"{n}:{bare[:n]}" for n in module.BEGINNINGS if len(bare) > n)] if bare else []:
                        want.add((doc, xxhash.xxh3_64_intdigest(term)))
            assert set(pairs) == want


def test_terms_are_hashed_as_arrays(monkeypatch):
    """Hashing a slice's words one at a time was most of the work: only terms of more than 16 bytes are, and once per worker."""
    import pyarrow as pa

    from filecover.llm import common
    from filecover.llm import toxicity as module

    alone = []
    plain = module.term_hash
    monkeypatch.setattr(module, "term_hash", lambda term: alone.append(term) or plain(term))
    monkeypatch.setattr(common.sys, "_filecover_held", {}, raising=False)
    words = [f"word{i}"[: 1 + i % 12] for i in range(3000)] + ["ünïcödé", "漢字漢字漢字漢字"] + 2 * ["x" * 17, "z" * 129]
    for _ in range(2):
        terms = module.Terms(pa.array([" ".join(words), "x" * 17]))
        hashes, codes = terms.named()
        doc, code = terms.pairs(codes)
        want = {t for w in words for t in (w, *(f"{n}:{w[:n]}" for n in module.BEGINNINGS if len(w) > n))}
        assert set(hashes[code[doc == 0]].tolist()) == {xxhash.xxh3_64_intdigest(t) for t in want}
        assert {xxhash.xxh3_64_intdigest(t) for t in ("x" * 17, "4:xxxx", "5:xxxxx", "6:xxxxxx")} == set(hashes[code[doc == 1]].tolist())
    long = {t.encode() for t in want if len(t.encode()) > 16}
    assert set(alone) == long and len(alone) == len(long) + 1  # the longest is not remembered


def test_hashes_of_terms_of_all_lengths():
    import pyarrow as pa

    from filecover.llm.toxicity import term_hashes

    terms = ["".join(chr(33 + (7 * i + 11 * k * k + n) % 90) for k in range(n)) for n in range(40) for i in range(50)]
    terms += [c * n for c in "é漢😀\x00" for n in range(1, 20)] + ["y" * n for n in (128, 129, 240, 241, 5000)]
    want = [xxhash.xxh3_64_intdigest(t) for t in terms]
    assert term_hashes(pa.array(terms, pa.large_string())).tolist() == want
    assert term_hashes(pa.array(terms, pa.large_string()).slice(60, 30)).tolist() == want[60:90]
    assert term_hashes(pa.array([], pa.large_string())).tolist() == []
