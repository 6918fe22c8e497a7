"""SentencePiece ids of whole texts through a table of distinct marked words.

No piece of the vocabulary holds a word marker (U+2581) after another
character, so merges never cross from one marked word into the next and a text
can be cut before each run of markers. The steps:

1. Each run of rows (a *bundle*, about 16 MB of text) lists its distinct words
   and keeps its texts as word numbers.
2. The lists are dealt by word; each part meets every distinct word once,
   whatever the number of bundles that have it, and segments it once.
3. The ids go back to their bundles, where the word numbers of each text are
   replaced by ids, position by position.

A frequent word travels once per bundle, so no key is hot. Bundles are found
twice (once for words, once for texts) and are named after their content: the
input must give the same rows in the same order each time, which holds for
files. If a bundle finds no ids the job fails rather than return other rows.

Null and empty texts have no ids but the end id. Repeated rows stay. An
existing column with the name of an output is replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from concordat.llm.arrow import added, int_lists, offsets, partitions, slices, spread, with_columns

MARK = "▁"
BUNDLE_BYTES = 6_000_000
#: Ids that a task keeps for words seen before.
KNOWN_IDS = 4_000_000
_BUNDLE, _CODES = "_llm_bundle", "_llm_codes"


def load(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def read_model(path: str) -> bytes:
    """The model's bytes travel with the job; executors need no file."""
    with open(path, "rb") as f:
        return f.read()


def check_cuts(model: bytes) -> None:
    """Refuse a vocabulary or a normaliser for which words can't be cut at markers."""
    sp = load(model)
    if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())):
        raise ValueError("the vocabulary has pieces that cross word markers")
    for text in ("a  b ", " a", "ﬁ　é"):
        if sp.decode(sp.encode(text)) != text:
            raise ValueError("the model's normaliser changes texts")


def pack(values: np.ndarray) -> bytes:
    """Numbers below 2^32, low and high halves apart."""
    low, high = (values & 0xFFFF).astype("<u2"), (values >> 16).astype("<u2")
    return zstandard.compress(low.tobytes() + high.tobytes() if high.any() else low.tobytes() + b"\0", 1)


def unpack(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    if len(raw) % 2:
        return np.frombuffer(raw[:-1], "<u2").astype(np.int64)
    low, high = np.frombuffer(raw, "<u2").reshape(2, -1)
    return low.astype(np.int64) + (high.astype(np.int64) << 16)


def _cuttable(text: pa.Array) -> pa.Array:
    """Texts in which each single space starts a word; further spaces of a run
    are markers that belong to it. Empty texts become null."""
    odd = pc.or_(pc.match_substring_regex(text, f"^ |  |{MARK}"), pc.equal(text, ""))
    if not pc.any(odd).as_py():
        return text
    whole = text.to_pylist()
    for i in np.flatnonzero(np.asarray(pc.fill_null(odd, False))):
        whole[i] = re.sub("(?<= ) +", lambda m: MARK * len(m[0]), " " + whole[i].replace(MARK, " "))[1:] if whole[i] else None
    return pa.array(whole, pa.string())


def _place(number: int) -> bytes:
    return f"{TaskContext.get().partitionId()} {number}".encode()


def _bundle(batch: pa.RecordBatch, text: str, place: bytes = b"") -> tuple[bytes, pa.Array, np.ndarray, np.ndarray]:
    """Name, distinct words, word numbers of all texts, and words per text. The
    name covers the content and the bundle's place, so equal bundles stay apart."""
    words = pc.split_pattern(_cuttable(batch.column(text).cast(pa.string())), " ")
    coded = pc.dictionary_encode(words.flatten())
    lens = np.asarray(pc.fill_null(pc.list_value_length(words), 0), dtype=np.int64)
    codes = np.asarray(coded.indices, dtype=np.int64)
    name = xxhash.xxh3_128(place)
    name.update(codes.astype("<u4").tobytes())
    name.update(lens.tobytes())
    name.update("\n".join(coded.dictionary.to_pylist()).encode())
    return name.digest(), coded.dictionary, codes, lens


def _deal(words: pa.Array, parts: int) -> np.ndarray:
    """A part for each word, from a weighted sum of its bytes."""
    n = len(words)
    lens = np.asarray(pc.binary_length(words), dtype=np.int64)
    data = np.frombuffer("".join(words.to_pylist()).encode(), np.uint8)
    at = np.arange(len(data)) - np.repeat(np.cumsum(lens) - lens, lens)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = (data.astype(np.uint64) + np.uint64(1)) * ((at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))
        full = np.flatnonzero(lens)
        if len(full):
            h[full] = np.add.reduceat(mixed, (np.cumsum(lens) - lens)[full])
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _words(text: str, parts: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(slices(batches, text, size)):
            name, words, _, _ = _bundle(batch, text, _place(number))
            if not len(words):
                continue
            part = _deal(words, parts)
            order = np.argsort(part, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)]
            taken = words.take(pa.array(order))
            lists = taken.to_pylist()  # no word holds a blank
            lists = [zstandard.compress(" ".join(lists[a:b]).encode(), 3) for a, b in zip(cuts, cuts[1:], strict=False)]
            codes = [pack(np.diff(order[a:b], prepend=0)) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[order[cuts[:-1]]].astype(np.int32)), pa.array([name] * len(codes), pa.binary()),
                 pa.array(codes, pa.binary()), pa.array(lists, pa.binary())], names=["part", _BUNDLE, _CODES, "words"])
    return run


def _segment(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(model)
        mark = sp.piece_to_id(MARK)
        part, known, ids, starts = None, {}, array("i"), array("q")
        for batch in batches:
            rows = []
            for now, name, codes, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now != part or len(ids) > KNOWN_IDS:
                    part, known, ids, starts = now, {}, array("i"), array("q", [0])
                words = zstandard.decompress(words).decode().split(" ")
                new = [w for w in words if w not in known]
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                for w, got in zip(new, sp.encode([w.replace(MARK, " ") for w in new], num_threads=1), strict=True):
                    ids.extend(got if w else (mark,))
                    starts.append(len(ids))
                at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                ends = np.array(starts, np.int64)
                lens = ends[at + 1] - ends[at]
                flat = np.array(ids, np.int32)[spread(ends[at], lens)].astype(np.int64)
                rows.append((name, codes, pack(lens), pack(flat)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*rows, strict=True)],
                                             names=[_BUNDLE, _CODES, "lens", "ids"])
    return run


def _texts(text: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(slices(batches, text, size)):
            name, _, codes, lens = _bundle(batch, text, _place(number))
            ends = np.cumsum(lens)
            packed = [pack(codes[a:b]) for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True)]
            yield with_columns(batch, **{_BUNDLE: pa.array([name] * len(packed), pa.binary()),
                                         _CODES: pa.array(packed, pa.binary())})
    return run


def _join_back(out: str, end_id: int | None, names: list[str]):
    def run(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
        codes = [unpack(x) for x in texts.column(_CODES).to_pylist()]
        n = max((int(c.max()) + 1 for c in codes if len(c)), default=0)
        lens, starts, flat, at = np.full(n, -1, np.int64), np.zeros(n, np.int64), [], 0
        for c, k, ids in zip(*(words.column(x).to_pylist() for x in (_CODES, "lens", "ids")), strict=True):
            c, k, ids = np.cumsum(unpack(c)), unpack(k), unpack(ids)
            lens[c], starts[c] = k, at + np.cumsum(k) - k
            flat.append(ids.astype(np.int32))
            at += len(ids)
        if (lens < 0).any():
            raise RuntimeError("the rows of the input changed between two reads; write it to files first")
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        end = np.array([] if end_id is None else [end_id], np.int32)
        got = []
        for c in codes:
            got += [flat[spread(starts[c], lens[c])], end]
        counts = np.array([len(a) + len(b) for a, b in zip(got[::2], got[1::2], strict=True)], np.int64)
        texts = texts.drop_columns([_CODES, _BUNDLE]).append_column(
            out, int_lists(np.concatenate(got) if got else np.zeros(0, np.int32), counts, pa.int32()))
        return texts.select(names)
    return run


def encode(docs: DataFrame, model_path: str, text: str = "text", out: str = "ids", end_id: int | None = None,
           keep_text: bool = True, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """``docs`` with the column ``out``: the ids that the sentencepiece library
    gives for each whole text, with ``end_id`` behind them if it is set.
    ``keep_text=False`` leaves the texts out of the shuffle and of the result."""
    model = read_model(model_path)
    check_cuts(model)
    parts = partitions(docs)
    words = (docs.select(text).mapInArrow(_words(text, parts, bundle_bytes), f"part int, {_BUNDLE} binary, {_CODES} binary, words binary")
             .repartition(parts, "part").sortWithinPartitions("part")
             .mapInArrow(_segment(model), f"{_BUNDLE} binary, {_CODES} binary, lens binary, ids binary"))
    coded = docs.mapInArrow(_texts(text, bundle_bytes), added(docs.schema, **{_BUNDLE: T.BinaryType(), _CODES: T.BinaryType()}))
    kept = [c for c in docs.columns if c.lower() != out.lower() and (keep_text or c != text)]
    coded = coded.select(*(f"`{c}`" for c in kept), _BUNDLE, _CODES)
    schema = added(docs.select(*(f"`{c}`" for c in kept)).schema, **{out: T.ArrayType(T.IntegerType())})
    return (coded.groupBy(_BUNDLE).cogroup(words.groupBy(_BUNDLE))
            .applyInArrow(_join_back(out, end_id, schema.names), schema))


def decode(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of each id list; null lists give an empty text."""
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(model)
        for batch in batches:
            lists = batch.column(ids)
            flat = np.asarray(lists.flatten())
            at = offsets(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)).tolist()
            texts = [sp.decode(flat[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)]
            yield with_columns(batch, **{out: pa.array(texts, pa.string())})

    return df.mapInArrow(run, added(df.schema, **{out: T.StringType()}))
