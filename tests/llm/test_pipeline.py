from collections import Counter

import corpus_pipeline
import public_tokenizers
import pyarrow as pa

from filecover.llm.byte_bpe import encoder, vocabulary
from filecover.session import BATCH_BYTES

from .test_near_dedup import expected as grouped
from .test_repetition import judged
from .test_suffix_dedup import removed

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, [tuple(r) for r in docs.collect()]
    assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "MinHash near-dedup", "suffix-array dedup", "mixing to target weights", "byte-level BPE",
    ]

    rows = [r for r in rows if judged(r[1], 6, 0.3, 100)[6]]
    docs = corpus_pipeline.written(stages["quality rules"](spark, docs, SF), "test")
    assert Counter(map(tuple, docs.collect())) == Counter(rows)

    kept = {d for d, _, _, k in grouped(rows, 5, 80) if k}
    rows = sorted(r for r in rows if r[0] in kept)
    docs = corpus_pipeline.written(stages["MinHash near-dedup"](spark, docs, SF), "test")
    assert sorted(map(tuple, docs.collect())) == rows

    cut = []
    for row, gone in zip(rows, removed(rows, 100), strict=True):
        left, at = "", 0
        for c in row[1]:
            size = len(c.encode())
            left += "" if all(gone[at : at + size]) else c
            at += size
        if left:
            cut.append((row[0], left, row[2], row[3], len(left)))
    docs = corpus_pipeline.written(stages["suffix-array dedup"](spark, docs, SF), "test")
    assert docs.columns == columns and sorted(map(tuple, docs.collect())) == cut

    mixed = corpus_pipeline.written(stages["mixing to target weights"](spark, docs, SF), "test")
    before = {r[0]: r for r in cut}
    repeats = Counter()
    for r in mixed.collect():
        assert before[r.doc_id][1].startswith(r.text) and r.n_chars == len(r.text)
        repeats[r.doc_id] += 1
    assert mixed.columns == columns and max(repeats.values()) == 2

    bpe = encoder(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = Counter((r.doc_id, bpe.encode(r.text)) for r in mixed.collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in stages["byte-level BPE"](spark, mixed, SF).collect()) == want
    assert Counter((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_batches_are_bounded_by_bytes(spark):
    """24 MB of texts in one partition reach Python in batches of 8 MB or so, though the session allows 64."""
    docs = spark.range(1200).selectExpr("id as doc_id", "repeat('twenty bytes, text. ', 1000) as text").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    for _, stage in corpus_pipeline.STAGES[:3]:
        spark.conf.set(BATCH_BYTES, "64m")
        stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(3), SF)
        assert max(r.bytes for r in docs.mapInArrow(sizes, "bytes long").collect()) < 9 << 20
