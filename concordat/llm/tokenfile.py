"""Token ids of whole texts in binary blocks, in order of document id.

Ids are replaced by their frequency rank over all documents, so that the ids
seen most take one byte. A block holds the ranks of consecutive documents in
two streams: control bytes with the byte lengths of four ranks each (two bits
per rank, first rank lowest), and the ranks' bytes, little-endian. Both are
read back by table lookup in numpy. A file is a Parquet file of such blocks; their
shard and block numbers give the order, their id lists and lengths the documents,
and each block says how many ids of its shard stand before it. The rank table is
a Parquet file beside them. Texts are encoded once: their ids stand in a table in
between until the ranks are known.

Texts are cut at single blanks between other characters, where no token
crosses, so each distinct word of a batch is encoded once. Texts with other
white space, special tokens or rare characters go to the tokenizer whole.

Null and empty texts have no ids but the end id. Rows with equal ids stand in
order of their text; null ids stand first.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.arrow import int_lists, slices, spread
from concordat.session import materialize, scratch_path, scratch_scope

SLICE_BYTES = 3_000_000
BLOCK_IDS = 1 << 20
#: White space but single blanks and line feeds, and characters whose class may differ between Unicode versions.
_WHOLE = r"^\s|\s$|\s\s|[\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{10000}-\x{10ffff}]"


@lru_cache(1)
def _tokenizers(json: str, ranks: bytes, pattern: str):
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(json)
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    words = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    blank = np.zeros(max(table.values()) + 1, bool)
    blank[[i for b, i in table.items() if b.startswith(b" ")]] = True
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    return whole, words, blank, special


class Coded:
    """The words of a batch's texts as numbers, each word's ids, and the ids of
    the texts that are encoded whole."""

    def __init__(self, text: pa.Array, tokenizer: tuple[str, bytes, str]):
        whole, words, blank, special = _tokenizers(*tokenizer)
        text = pc.fill_null(text.cast(pa.string()), "")
        odd = pc.or_(pc.match_substring_regex(text, _WHOLE), pc.equal(text, ""))
        for s in special:
            odd = pc.or_(odd, pc.match_substring(text, s))
        self.odd = np.asarray(odd)
        lists = pc.split_pattern(text.filter(pa.array(~self.odd)), " ")
        coded = pc.dictionary_encode(lists.flatten())
        self.codes, n = np.array(coded.indices, dtype=np.int32), np.asarray(pc.list_value_length(lists), dtype=np.int64)
        self.first = np.cumsum(n) - n
        known = coded.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known), " ")[0].as_py()
        flat = words.encode_to_numpy(" " + joined, disallowed_special=()).astype(np.int64) if len(known) else np.zeros(0, np.int64)
        starts = np.flatnonzero(blank[flat]) if len(flat) else np.zeros(0, np.int64)
        if len(starts) != len(known):
            raise RuntimeError("a token crosses a blank")
        lens = np.diff(np.append(starts, len(flat)))
        leading, at = np.unique(self.codes[self.first], return_inverse=True)
        heads = [words.encode_ordinary(w) for w in known.take(pa.array(leading)).to_pylist()]
        self.codes[self.first] = len(known) + at
        head_lens = np.array([len(h) for h in heads], np.int64)
        self.starts = np.concatenate([starts, len(flat) + np.cumsum(head_lens) - head_lens])
        self.lens = np.concatenate([lens, head_lens])
        self.flat = np.concatenate([flat, np.array([i for h in heads for i in h], np.int64)]).astype(np.int32)
        self.others = [e.ids for e in whole.encode_batch(text.filter(odd).to_pylist(), add_special_tokens=False)] if self.odd.any() else []

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        per_word = self.lens[self.codes]
        ids = self.flat[spread(self.starts[self.codes], per_word)]
        counts = np.zeros(len(self.odd), np.int64)
        counts[~self.odd] = np.add.reduceat(per_word, self.first) if len(self.first) else 0
        if not self.odd.any():
            return ids, counts
        ends, pieces, k = np.cumsum(counts), [], 0
        for i, got in zip(np.flatnonzero(self.odd), self.others, strict=True):
            pieces += [ids[k:ends[i]], np.array(got, np.int32)]
            k = ends[i]
            counts[i] = len(got)
        return np.concatenate([*pieces, ids[k:]]), counts


def encode_batch(text: pa.Array, tokenizer: tuple[str, bytes, str]) -> tuple[np.ndarray, np.ndarray]:
    return Coded(text, tokenizer).ids()


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    lens = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    two = np.zeros(-len(ranks) % 4 + len(ranks), np.uint8)
    two[:len(ranks)] = lens - 1
    control = two[0::4] | two[1::4] << 2 | two[2::4] << 4 | two[3::4] << 6
    at = np.cumsum(lens) - lens
    data = np.empty(int(lens.sum()), np.uint8)
    for k in range(4):
        used = lens > k
        if not used.any():
            break
        data[at[used] + k] = ranks[used] >> 8 * k & 0xFF
    return control.tobytes(), data.tobytes()


#: The four byte lengths behind each control byte.
_LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lens = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(lens) - lens
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.int64)
    for k in range(1, int(lens.max(initial=1))):
        out |= np.where(lens > k, raw[at + k], 0).astype(np.int64) << 8 * k
    return out


def _schema(kind: T.DataType, *data: str) -> T.StructType:
    """A block of documents, whose ids have type ``kind``, with its token ids in columns ``data``."""
    return T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()),
                         T.StructField("before", T.LongType()), T.StructField("n_ids", T.LongType()),
                         T.StructField("docs", T.ArrayType(kind)), T.StructField("lens", T.ArrayType(T.IntegerType())),
                         *(T.StructField(c, T.BinaryType()) for c in data)])


def _plain(ids: np.ndarray) -> bytes:
    """Ids, at least one, in as many bytes each as the largest needs."""
    return ids.astype(np.min_scalar_type(ids.max()).newbyteorder("<")).tobytes()


def _numbers(plain: bytes, n: int) -> np.ndarray:
    return np.frombuffer(plain, f"<u{len(plain) // n}")


def _encoded(tokenizer: tuple[str, bytes, str], end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for part in slices(iter([batch]), "text", SLICE_BYTES):
                ids, counts = with_end(*encode_batch(part.column("text"), tokenizer), end_id)
                ends = np.cumsum(counts)
                run_of = (ends - counts) // BLOCK_IDS
                cuts = [0, *(np.flatnonzero(np.diff(run_of)) + 1).tolist(), len(counts)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    n = int(counts[a:b].sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()),
                         pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), part.column("doc").slice(a, b - a)),
                         int_lists(counts[a:b], np.array([b - a]), pa.int32()), pa.array([_plain(ids[ends[a] - counts[a]:ends[b - 1]])], pa.binary())],
                        names=["shard", "block", "before", "n_ids", "docs", "lens", "ids"])
                    block, before = block + 1, before + n
    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in batches:
        for plain, n in zip(batch.column("ids"), batch.column("n_ids").to_pylist(), strict=True):
            got = np.bincount(_numbers(plain.as_py(), n), minlength=len(total))
            got[:len(total)] += total
            total = got
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])


def _blocks(rank_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                control, data = pack(rank_of[_numbers(row.column("ids")[0].as_py(), row.column("n_ids")[0].as_py())])
                yield pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                                                 names=[*row.schema.names[:-1], "control", "data"])
    return run


def write(docs: DataFrame, path: str, tokenizer: tuple[str, bytes, str], end_id: int = 0, doc: str = "doc_id", text: str = "text") -> None:
    """Write ``path/blocks`` and ``path/ranks``. ``tokenizer`` is the tokenizer's
    JSON, its vocabulary as ranks, and the pattern that goes with them."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType
    with scratch_scope(spark):
        encoded = materialize(rows.repartitionByRange("doc").sortWithinPartitions("doc", "text")
                              .mapInArrow(_encoded(tokenizer, end_id), _schema(kind, "ids")), "ids", compression="zstd")
        counted = encoded.select("n_ids", "ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        known = counted.orderBy(F.desc("n"), "id").collect()  # one row per entry of the vocabulary at most
        rank_of = np.zeros(max((r["id"] for r in known), default=0) + 1, np.int64)
        rank_of[[r["id"] for r in known]] = np.arange(len(known))
        spark.createDataFrame([(i, r["id"]) for i, r in enumerate(known)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
        encoded.mapInArrow(_blocks(rank_of), _schema(kind, "control", "data")).write.option("compression", "zstd").parquet(f"{path}/blocks")


def _read(id_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lens = np.asarray(batch.column("lens")[i].values, dtype=np.int64)
                n = int(lens.sum())
                ids = id_of[unpack(batch.column("control")[i].as_py(), batch.column("data")[i].as_py(), n)].astype(np.int32)
                starts = batch.column("start")[i].as_py() + np.cumsum(lens) - lens
                yield pa.RecordBatch.from_arrays(
                    [batch.column("docs")[i].values, pa.array(starts), int_lists(ids, lens, pa.int32())], names=["doc", "start", "ids"])
    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc, start, ids`` of every document, from the files alone."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").collect()
    id_of = np.array([r["id"] for r in ranks] or [0], np.int64)
    blocks = spark.read.parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(  # one row per shard
        "shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    placed = blocks.join(F.broadcast(shards), "shard").withColumn("start", F.col("shard_start") + F.col("before"))
    kind = blocks.schema["docs"].dataType.elementType
    return placed.select("start", "docs", "lens", "control", "data").mapInArrow(
        _read(id_of), T.StructType([T.StructField("doc", kind), T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def crc_of_ids(df: DataFrame, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` and ``n_tokens, ids_crc32`` (over little-endian unsigned 32-bit ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.asarray(x.values).astype("<u4").tobytes() for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([len(x) // 4 for x in lists], pa.int64()), pa.array([zlib.crc32(x) for x in lists], pa.int64())],
                names=[*keep, "n_tokens", "ids_crc32"])
    return df.mapInArrow(run, T.StructType([df.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


def scratch(spark: SparkSession) -> str:
    return scratch_path(spark, "token_files")
