"""SentencePiece ids and token files against the libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from concordat.llm import queries, sentencepieces, tokenfile
from tests.llm.data import documents, frame


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_library(spark, tmp_path, pieces):
    docs, rows = documents(spark, tmp_path / "d")
    got = sentencepieces.decode(sentencepieces.encode(docs, queries.PIECES, end_id=2, bundle_bytes=3000), queries.PIECES)
    assert sorted(c for c in got.columns) == sorted([*docs.columns, "decoded"])
    want = sorted((str(i), t or "", pieces.encode(t or "") + [2]) for i, t in rows)
    found = got.collect()
    assert sorted((str(r["doc_id"]), r["text"] or "", list(r["ids"])) for r in found) == want
    assert all(r["decoded"] == pieces.decode(list(r["ids"])) for r in found)


def test_empty_table_and_no_text(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "e"))
    docs = spark.read.parquet(str(tmp_path / "e"))
    assert sentencepieces.encode(docs, queries.PIECES, keep_text=False).collect() == []
    path = str(tmp_path / "files")
    tokenfile.write(docs, path, queries.byte_bpe())
    assert tokenfile.read(spark, path).collect() == []


def test_decoding_of_null_and_empty_lists(spark, pieces, monkeypatch):
    """Also in a batch that is cut off in front."""
    lists = [[5, 6], None, [], [7], [1000, 2, 31000]]
    run = []
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ids array<int>")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: run.append(f))
    sentencepieces.decode(df, queries.PIECES)
    batch = pa.record_batch({"ids": pa.array([[9], *lists], pa.list_(pa.int32()))}).slice(1)
    monkeypatch.setattr(sentencepieces, "load", lambda model: pieces)
    got = next(run[0](iter([batch]))).column("decoded").to_pylist()
    assert got == [pieces.decode(x or []) for x in lists]


def test_changed_input_is_an_error():
    join = sentencepieces._join_back("ids", None, ["ids"])
    texts = pa.table({"_llm_bundle": [b"x"], "_llm_codes": [sentencepieces.pack(np.array([0, 1]))]})
    none = pa.table({"_llm_bundle": pa.array([], pa.binary()), "_llm_codes": pa.array([], pa.binary()), "lens": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})
    with pytest.raises(RuntimeError):
        join((b"x",), texts, none)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
@settings(max_examples=50, deadline=None)
def test_packed_numbers(values):
    a = np.array(values, np.int64)
    assert sentencepieces.unpack(sentencepieces.pack(a)).tolist() == values
    control, data = tokenfile.pack(a)
    assert tokenfile.unpack(control, data, len(a)).tolist() == values


@given(st.text(max_size=40), st.text(alphabet=" \n\tab.'é▁", max_size=40))
@settings(max_examples=150, deadline=None)
def test_any_text(a, b):
    texts = pa.array([a.encode("utf-8", "ignore").decode(), b, None])
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids, counts = tokenfile.encode_batch(texts, queries.byte_bpe())
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    batch = pa.record_batch({"t": texts})
    name, words, codes, lens = sentencepieces._bundle(batch, "t")
    seen = [sp.encode(w.replace("▁", " ")) if w else [sp.piece_to_id("▁")] for w in words.to_pylist()]
    at = 0
    for t, n in zip(texts.to_pylist(), lens, strict=True):
        assert sum((seen[c] for c in codes[at:at + n]), []) == sp.encode(t or "")
        at += n


def test_token_files(spark, tmp_path, bpe):
    docs, rows = documents(spark, tmp_path / "d")
    path = str(tmp_path / "files")
    tokenfile.write(docs, path, queries.byte_bpe(), end_id=0)
    got = tokenfile.crc_of_ids(tokenfile.read(spark, path), ["doc", "start"]).collect()
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = bpe.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(str, ((r["doc"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got))) == sorted(map(str, want))


def test_texts_are_encoded_once(spark, tmp_path):
    """Texts are read for the bounds of the shards and for their ids, and blocks are read without a shuffle."""
    docs, rows = documents(spark, tmp_path / "d")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    path = str(tmp_path / "files")
    tokenfile.write(docs.mapInArrow(counted, docs.schema), path, queries.byte_bpe())
    assert seen.value <= 2 * len(rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tokenfile.read(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_blocks_in_order(monkeypatch):
    """Several blocks in a shard, their counts, and ids wider than two bytes."""
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 8)
    texts = pa.array(["a b c d", None, "the end of it", "x " * 30, ""])
    ids, counts = tokenfile.with_end(*tokenfile.encode_batch(texts, queries.byte_bpe()), 0)
    assert tokenfile._numbers(tokenfile._plain(ids), len(ids)).tolist() == ids.tolist()
    wide = np.array([0, 70_000, 255], np.int64)
    assert tokenfile._numbers(tokenfile._plain(wide), 3).tolist() == wide.tolist()
    monkeypatch.setattr(tokenfile.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    batch = pa.record_batch({"doc": pa.array(range(5), pa.int64()), "text": texts})
    blocks = list(tokenfile._encoded(queries.byte_bpe(), 0)(iter([batch, batch])))
    assert len(blocks) > 2 and [b["block"][0].as_py() for b in blocks] == list(range(len(blocks)))
    assert [b["before"][0].as_py() for b in blocks] == (np.cumsum([b["n_ids"][0].as_py() for b in blocks]) - [b["n_ids"][0].as_py() for b in blocks]).tolist()
    got = np.concatenate([tokenfile._numbers(b["ids"][0].as_py(), b["n_ids"][0].as_py()) for b in blocks])
    assert got.tolist() == ids.tolist() * 2
    found = list(tokenfile._counts(iter(pa.Table.from_batches(blocks).combine_chunks().to_batches())))[0]
    assert dict(zip(found["id"].to_pylist(), found["n"].to_pylist(), strict=True)) == {i: 2 * n for i, n in enumerate(np.bincount(ids)) if n}


def test_queries(spark, sf, pieces, bpe):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()))
    got = {r["doc_id"]: r for r in queries.op1_sentencepiece(spark, sf).collect()}
    files = {r["doc_id"]: r for r in queries.op10_token_files(spark, sf).collect()}
    at = 0
    for i, t in docs:
        ids = pieces.encode(t) + [2]
        sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), sha)
        assert got[i]["decoded_sha256"] == hashlib.sha256(pieces.decode(ids).encode()).hexdigest()
        ids = bpe.encode(t, add_special_tokens=False).ids + [0]
        assert (files[i]["start"], files[i]["n_tokens"]) == (at, len(ids))
        at += len(ids)
