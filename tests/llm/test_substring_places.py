"""Places of passages travel once, and a passage found everywhere makes one entry a lot."""

import random

import pyarrow as pa

from lexiloom.llm import substring_dedup


def texts(n):
    rng = random.Random(7)
    common = "".join(rng.choice("abcdefghij ") for _ in range(400))
    own = ["".join(rng.choice("abcdefghij ") for _ in range(300)) for _ in range(n)]
    return [common + own[i] + (own[i - 1][:250] if i % 3 == 0 else "") for i in range(n)]


def test_a_common_passage_is_asked_for_once_a_lot():
    batch = pa.record_batch([pa.array(range(200)), pa.array(texts(200))], names=["doc", "text"])
    rows = pa.Table.from_batches(list(substring_dedup._places(substring_dedup.Chunking(), 4)([batch])))
    asked = rows.filter(rows.column("d1").is_valid())
    keys = list(zip(asked.column("d1").combine_chunks().flatten().to_pylist(), asked.column("d2").combine_chunks().flatten().to_pylist()))
    known = rows.filter(rows.column("d1").is_null()).column("x").combine_chunks().flatten()
    assert len(set(keys)) == len(keys) and len(known) > 199 * 5


def test_small_lots_and_few_buckets_change_nothing(spark, monkeypatch):
    rows = [*enumerate(texts(60)), (3, texts(60)[3]), (None, texts(60)[5]), (70, None), (71, "x" * 3000), (72, "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    show = lambda: sorted(map(repr, substring_dedup.dedup_substrings(df).collect()))
    whole = show()
    monkeypatch.setattr(substring_dedup, "LOT_BYTES", 1000)
    assert show() == whole
    kept = {r.doc_id: r for r in substring_dedup.dedup_substrings(df).where("doc_id > 0").collect()}
    assert kept[1].n_dropped >= 300 and kept[6].n_dropped >= 450 and kept[72].n_dropped > kept[71].n_dropped
