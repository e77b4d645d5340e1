import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from condensa.llm.packing import min_bin_slack, pack_documents
from condensa.llm.sstable import Shard, read_shards, write_shards
from condensa.llm.tokens import default_path, encoder

TEXTS = [None, "", " ", "a", "  two  spaces ", "line\n\n next \n\t x", "déjà vu, naïve café", "tab\tand nbsp here   z", "日本 語 text", "x <|endoftext|> y", "don't stop it's", "a\n b \n c", "é ́x", "word " * 3000, "😀 ok 😀😀", "\u0000 \x1c \x1d a"]


def ids_of(text):
    model = Tokenizer.from_file(default_path())
    model.encode_special_tokens = True
    return model.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("remembered", [3, 100_000])
def test_encoder_equals_whole_texts(remembered):
    model = encoder(default_path(), remembered)
    for _ in range(2):
        got = [np.frombuffer(b, model.dtype).tolist() for b in model.encode(TEXTS)]
        assert got == [ids_of(t) for t in TEXTS]


def docs_of(spark):
    rows = [(i * 7 - 20, t, i, "s") for i, t in enumerate(TEXTS)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, start int, n_tokens string")


def test_shards_round_trip(spark, tmp_path):
    rows, docs = docs_of(spark)
    docs = docs.union(spark.createDataFrame([(None, "no key", 1, "")], docs.schema))
    manifest = write_shards(docs, f"file://{tmp_path}", default_path(), shards=3, shard_bytes=400)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_shards(manifest).collect()}
    at, want = 0, {}
    for doc_id, text, *_ in sorted(rows):
        ids = ids_of(text) + [0]
        want[doc_id] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want
    names = [r.shard for r in manifest.collect()]
    assert len(names) > 1
    found = [ids.tolist() for n in names for ids in Shard(n).get(1)]
    assert found == [ids_of(TEXTS[3]) + [0]]
    assert all(Shard(n).get(5) == [] for n in names)


def test_repeated_keys_over_blocks(tmp_path):
    from condensa.llm.sstable import ShardWriter, key_of

    writer = ShardWriter("<u2", block_bytes=32)
    for key in (1, 2, 2, 2, 2, 2, 2, 2, 9):
        writer.add(key_of(key), np.arange(key, key + 6, dtype="<u2").tobytes())
    writer.close(f"file://{tmp_path}/x.sst")
    shard = Shard(f"file://{tmp_path}/x.sst")
    assert [len(shard.get(k)) for k in (1, 2, 9, 3)] == [1, 7, 1, 0]
    assert [k for k, _ in shard] == [1, 2, 2, 2, 2, 2, 2, 2, 9]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert read_shards(write_shards(docs, f"file://{tmp_path}", default_path())).collect() == []
    assert pack_documents(docs).collect() == []


def test_min_bin_slack():
    patterns = min_bin_slack({60: 3, 40: 2, 30: 4, 10: 2, 7: 1}, 100)
    left = {60: 3, 40: 2, 30: 4, 10: 2, 7: 1}
    for pattern, times in patterns:
        assert sum(n * c for n, c in pattern.items()) <= 100
        for n, c in pattern.items():
            left[n] -= c * times
    assert not any(left.values())
    assert patterns[0] == ({60: 1, 40: 1}, 2)
    # The fill is the best there is.
    assert min_bin_slack({9: 1, 5: 1, 4: 1}, 10) == [({9: 1}, 1), ({5: 1, 4: 1}, 1)]


def test_packing(spark):
    rows, docs = docs_of(spark)
    more = spark.createDataFrame([(1000 + i, "copy of one text", 0, None) for i in range(300)] + [(None, "no id", 0, None)], docs.schema)
    docs = docs.union(more).union(docs.filter("doc_id = 1"))
    capacity = 64
    got = pack_documents(docs, capacity=capacity).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in [(r[0], r[1]) for r in rows if r[0] != 1] + [(1005, "copy of one text"), (None, "no id")]:
        ids = ids_of(text) + [1]
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length]) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    assert len(by_doc[1]) == 2
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    used = sum(r.length for r in got)
    assert len(by_sequence) <= 1.05 * used / capacity + 2
