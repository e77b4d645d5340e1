import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(500)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, item = [], say(40)
    for i in range(40):
        rows.append((i, say(60), "en", "s", 0))
    rows.append((100, rows[3][1], "en", "s", 0))
    rows.append((101, rows[5][1] + " extra", "en", "s", 0))
    rows.append((102, say(30) + " " + item + " " + say(30), "en", "s", 0))
    rows.append((103, say(20) + " token = \"f33e61083db5dbdf4bd2369d2f80176e57f7fda2\" " + say(9), "en", "s", 0))
    rows += [(104, None, "en", "s", 0), (105, "", None, None, None), (None, say(50), "en", "s", 0), (None, say(50), "en", "s", 0), (7, say(50), "en", "s", 0)]
    # Equal in all columns, and without an id: one of them stays.
    rows.append(rows[-2])
    rows = [(a, t, c, d, len(t or "")) for a, t, c, d, _ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == columns
        ids.append(sorted((-1 if r.doc_id is None else r.doc_id) for r in docs.collect()))
    # Rows without an id of their own are judged like others: that without an id stays (as -1), and both with the id 7.
    every = sorted(-1 if r[0] is None else r[0] for r in rows)
    assert every.count(-1) == 3 and every.count(7) == 2
    assert ids[0] == [x for x in every if x not in (104, 105)]
    assert ids[1] == sorted([x for x in ids[0] if x not in (-1, 100, 101)] + [-1, -1])
    assert ids[2] == ids[3] == [x for x in ids[1] if x != 102]
    masked = {r.doc_id: r for r in docs.collect()}[103]
    assert "f33e" not in masked.text and "[SECRET]" in masked.text and masked.n_chars == len(masked.text)
    packed = corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()
    assert sorted({-1 if r.doc_id is None else r.doc_id for r in packed}) == sorted(set(ids[3]))
    assert {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()} == {(r.doc_id, r.start, r.length, r.ids_crc32) for r in packed}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
