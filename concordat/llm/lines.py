"""Near-duplicate lines across documents by a deletion-neighbourhood join.

Lines are split at line feeds and compared as words (white space between them,
A-Z lowered). Two lines are near when one word substituted, inserted or deleted
turns one into the other (an edit distance of at most 1 over words). A line goes
when an earlier line, in order of (document id, line number), is equal or near
to it, whether or not that one stays.

Where one of two lines has fewer than MIN_WORDS words, they are near at an edit
distance of at most 1 over characters (words with one blank between them) if both
have MIN_CHARACTERS, and only equal ones go if one is shorter still. Lines of
scripts without blanks are compared this way. A ``min_words`` that is given leaves
all lines of fewer words alone instead.

* Words and characters go the same way; below, words stand for both.
* A line and its near line agree in their first or in their last h words, h
  being half the shortest length of their length band. Only lines that share
  one of these two keys with another line go on.
* Those emit the hashes of all variants with one word deleted in the part that
  may differ, with the deleted position, and the hash of the whole line.
* Equal variants meet. The edit distance follows from the positions: the same
  position in both is a substitution, and a whole line that equals the other's
  variant is an insertion; anything else is farther apart. Variants are equal
  when 96 bits of hash agree.
* Minima of positions replace pairs, so a variant that a third of all lines
  share costs one pre-aggregated row.

Joins are merge joins at every size: their smaller sides grow with the input.

Rows with a null id keep all lines. Rows that share an id are one document: a
line number that goes, goes in all of them. A null text stays null. Documents
stay even if no line is left (their text is then empty).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.arrow import added, slices, spread, with_columns
from concordat.llm.grams import SPACES, U, mix, word_hashes
from concordat.session import materialize, scratch_scope

MIN_WORDS, MIN_CHARACTERS = 8, 16
#: Bytes of text that a task takes apart at once, whatever the size of its batches.
SLICE_BYTES = 500_000
KEYS = ("p0", "s0", "p1", "s1", "p2", "s2")
_BASES = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))
_INVERSES = tuple(U(pow(int(b), -1, 1 << 64)) for b in _BASES)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, base, U)]))


class Runs:
    """Runs of hashes, as polynomials over prefixes."""

    def __init__(self, h: np.ndarray, start: np.ndarray, size: np.ndarray):
        """``start, size``: runs that cover ``h`` one after another."""
        self.first, self.size = start, size
        longest = int(size.max(initial=1))
        place = np.arange(len(h)) - np.repeat(start, size)
        self.inverse = [_powers(b, longest) for b in _INVERSES]
        with np.errstate(over="ignore"):
            self.sums = [np.concatenate([[U(0)], np.cumsum(h * _powers(b, longest)[place], dtype=U)]) for b in _BASES]

    def part(self, k: int, of: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of words a..b-1 of the lines ``of``, as if they stood at the start."""
        with np.errstate(over="ignore"):
            return (self.sums[k][self.first[of] + b] - self.sums[k][self.first[of] + a]) * self.inverse[k][a]

    def without(self, k: int, of: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Hash of the lines ``of`` without their word i."""
        s, f = self.sums[k], self.first[of]
        with np.errstate(over="ignore"):
            return s[f + i] - s[f] + (s[f + self.size[of]] - s[f + i + 1]) * self.inverse[k][1]


class Lines:
    """Lines of a batch: their words, and the characters of those of at most
    MIN_WORDS words (one more than short lines have, since a blank makes one more)."""

    def __init__(self, text: pa.Array, min_words: int | None):
        text = pc.fill_null(text.cast(pa.string()), "")
        h, counts, at = word_hashes(text)
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
        raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
        ends = ends - ends[0]
        feeds = np.flatnonzero(raw == 10)
        doc = np.repeat(np.arange(len(text)), counts)
        line = np.searchsorted(feeds, at) - np.searchsorted(feeds, ends[doc])
        new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(line, prepend=-1) != 0)) if len(h) else np.zeros(0, np.int64)
        self.words = Runs(h, new, np.diff(np.append(new, len(h))))
        keep = self.words.size >= (min_words or 1)
        self.words.first, self.words.size, self.doc, self.line = new[keep], self.words.size[keep], doc[new][keep], line[new][keep]
        if min_words:
            self.by_characters = np.zeros(0, np.int64)
        else:
            some = np.flatnonzero(self.words.size <= MIN_WORDS)
            begin = at[new[some]]
            stop = np.minimum(np.append(feeds, len(raw))[np.searchsorted(feeds, begin)], ends[1:][self.doc[some]])
            blank = np.delete(at, new) - 1  # the last white space before a word inside a line
            h, size = _characters(raw, begin, stop, blank)
            long = size >= MIN_CHARACTERS
            self.by_characters = some[long]
            self.characters = Runs(h[np.repeat(long, size)], np.cumsum(size[long]) - size[long], size[long])


def _characters(raw: np.ndarray, begin: np.ndarray, stop: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the characters of the lines at these bytes, and how many each has.
    White space counts only at ``blank``, and all white space is the same."""
    i = spread(begin, stop - begin)
    wide = np.concatenate([raw, np.zeros(3, np.uint8)])
    is_blank = np.zeros(len(raw), bool)
    is_blank[blank] = True
    unit = (raw[i] & 0xC0) != 0x80
    unit &= (SPACES[raw[i]] != 0) | is_blank[i]
    size = np.diff(np.concatenate([[0], np.cumsum(unit)])[np.concatenate([[0], np.cumsum(stop - begin)])])
    i = i[unit]
    value, more = np.where(is_blank[i], 0, SPACES[raw[i]]).astype(U), np.ones(len(i), bool)
    for k in (1, 2, 3):
        more &= (wide[i + k] & 0xC0) == 0x80
        value |= np.where(more, wide[i + k], 0).astype(U) << U(9 * k)
    with np.errstate(over="ignore"):
        return mix(value + U(1)), size


def _bands(min_words: int, top: int) -> np.ndarray:
    out = [min_words]
    while out[-1] <= top:
        out.append(out[-1] * 5 // 4 + 1)
    return np.array(out)


def _halves(runs: Runs, low: int) -> list[pa.Array]:
    """Keys of the first and the last half of each run in its own band, and in the
    band below where the run is the shortest of its own."""
    every, zero = np.arange(len(runs.size)), np.zeros(len(runs.size), np.int64)
    lows = _bands(low, int(runs.size.max(initial=1)))
    own = np.searchsorted(lows, runs.size, side="right") - 1
    keys = []
    for band, used in ((own, own >= 0), (np.maximum(own - 1, 0), (own > 0) & (runs.size == lows[own]))):
        half = np.minimum(lows[band] // 2, runs.size)
        with np.errstate(over="ignore"):
            tag = band.astype(U) * U(0x165667B19E3779F9)
            for side, key in enumerate((runs.part(0, every, zero, half), runs.part(0, every, runs.size - half, runs.size))):
                key = mix(mix(key) + tag + U(side)).view(np.int64)
                keys.append(pa.array(key, mask=~used))
    return keys


def _scan(min_words: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "text", SLICE_BYTES):
                x = Lines(part.column("text"), min_words)
                every, zero = np.arange(len(x.doc)), np.zeros(len(x.doc), np.int64)
                h1, h2 = (mix(x.words.part(k, every, zero, x.words.size)).view(np.int64) for k in (0, 1))
                keys = _halves(x.words, min_words or MIN_WORDS)
                keys += [pa.nulls(len(x.doc), pa.int64())] * 2
                if len(x.by_characters):
                    # lines of MIN_WORDS words have no second key over words
                    place = np.full(len(x.doc), -1)
                    place[x.by_characters] = np.arange(len(x.by_characters))
                    more = [k.take(pa.array(place, mask=place < 0)) for k in _halves(x.characters, MIN_CHARACTERS)]
                    short = pa.array(x.words.size < MIN_WORDS)
                    both = pa.array(x.words.size == MIN_WORDS)
                    keys = [pc.if_else(short, a, pc.if_else(both, b, c)) for a, b, c in
                            zip(more + keys[4:], keys[:2] + more, keys, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(pa.array(x.doc)), pa.array(x.line.astype(np.int32)), pa.array(x.words.size.astype(np.int32)),
                     pa.array(h1), pa.array(h2), *keys], names=["doc", "line", "n", "h1", "h2", *KEYS])
    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Runs of rows with their texts, about SLICE_BYTES of them; a longer text
    ends its run."""
    for batch in batches:
        texts, held, first = [], 0, 0
        for i, packed in enumerate(batch.column("packed")):
            raw = zstandard.decompress(packed.as_py()) if packed.is_valid else None
            texts.append(None if raw is None else raw.decode())
            held += len(raw or b"")
            if held >= SLICE_BYTES or i + 1 == batch.num_rows:
                yield batch.slice(first, len(texts)), texts
                texts, held, first = [], 0, i + 1


def _variants(min_words: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _unpacked(batches):
            wanted = batch.column("wanted").to_pylist()
            x = Lines(pa.array(texts, pa.string()), min_words)
            at = {(d, n): i for i, (d, n) in enumerate(zip(x.doc.tolist(), x.line.tolist(), strict=True))}
            of, sides = [], []
            for d, lines in enumerate(wanted):
                for w in lines:
                    if (d, w["line"]) in at:
                        of.append(at[d, w["line"]])
                        sides.append(w["sides"])
            of, sides = np.array(of, np.int64), np.array(sides, np.int64)
            place = np.full(len(x.doc), -1)
            place[x.by_characters] = np.arange(len(x.by_characters))
            for runs, low, used, open_sides in ((x.words, min_words or MIN_WORDS, sides & 3, lambda s: of[s]),
                                                (getattr(x, "characters", None), MIN_CHARACTERS, sides >> 2, lambda s: place[of[s]])):
                some = np.flatnonzero(used)
                if not len(some):
                    continue
                line, run_of, used = of[some], open_sides(some), used[some]
                size = runs.size[run_of]
                lows = _bands(low, int(runs.size.max(initial=1)))
                band = np.searchsorted(lows, size, side="right") - 1
                half = lows[np.where((size == lows[band]) & (band > 0), band - 1, band)] // 2
                first = np.where(used & 2, 0, half)
                last = np.where(used & 1, size, size - half)
                many = np.repeat(run_of, last - first)
                i = spread(first, last - first)
                one, two = (np.concatenate([runs.without(k, many, i), runs.part(k, run_of, run_of * 0, size)]) for k in (0, 1))
                line = np.concatenate([np.repeat(line, last - first), line])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(one).view(np.int64)), pa.array((mix(two) >> U(32)).astype(np.uint32).view(np.int32)),
                     pa.array(np.concatenate([i, np.full(len(some), -1)]).astype(np.int32)),
                     batch.column("doc").take(pa.array(x.doc[line])), pa.array(x.line[line].astype(np.int32))],
                    names=["k1", "k2", "at", "doc", "line"])
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        c = zstandard.ZstdCompressor(level=1)
        yield with_columns(batch, packed=pa.array([None if t is None else c.compress(t.encode()) for t in batch.column("text").to_pylist()],
                                                  pa.binary())).drop_columns(["text"])


def near_lines(lines: DataFrame, first: DataFrame, docs: DataFrame, min_words: int | None) -> DataFrame:
    """``doc, line``: first places of the lines that are near an earlier one.
    ``lines`` has all lines, ``first`` the first place of each distinct one."""
    # sides 1 and 2 are halves over words, 4 and 8 those over characters
    above = [F.lit(False)] * 3 if min_words else [F.col("n") < MIN_WORDS, F.col("n") <= MIN_WORDS, F.lit(True)]
    keys = lines.select("h1", F.explode(F.array(*(F.struct(F.col(c).alias("key"), F.when(above[i // 2], 4 << i % 2).otherwise(1 << i % 2).alias("side"))
                                                  for i, c in enumerate(KEYS)))).alias("k")).select("h1", "k.*").where("key is not null")
    shared = keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a < b").select("key")
    open_lines = keys.join(shared.hint("merge"), "key", "left_semi").groupBy("h1").agg(F.bit_or("side").alias("sides"))
    wanted = (first.select("h1", "place.*").join(open_lines.hint("merge"), "h1").groupBy("doc")
              .agg(F.collect_set(F.struct("line", "sides")).alias("wanted")))
    kind = docs.schema["doc"].dataType
    packed = docs.where("doc is not null and text is not null").mapInArrow(_pack, T.StructType([T.StructField("doc", kind), T.StructField("packed", T.BinaryType())]))
    rows = materialize(packed.join(wanted.hint("merge"), "doc").mapInArrow(_variants(min_words), T.StructType(
        [T.StructField("k1", T.LongType()), T.StructField("k2", T.IntegerType()), T.StructField("at", T.IntegerType()),
         T.StructField("doc", kind), T.StructField("line", T.IntegerType())])), "variants")
    place = F.struct("doc", "line")
    ranges = rows.groupBy("k1").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("k1")
    rows = materialize(rows.join(ranges.hint("merge"), "k1", "left_semi").select("k1", "k2", "at", place.alias("place")), "equal_variants")
    least = rows.groupBy("k1", "k2", "at").agg(F.min("place").alias("first"))
    same = rows.join(least, ["k1", "k2", "at"]).where("place > first").select("place")
    whole = least.where("at < 0").select("k1", "k2", F.col("first").alias("whole"))
    cut = least.where("at >= 0").groupBy("k1", "k2").agg(F.min("first").alias("cut"))
    shorter = whole.join(cut, ["k1", "k2"]).where("whole > cut").select(F.col("whole").alias("place"))
    longer = rows.where("at >= 0").join(whole, ["k1", "k2"]).where("place > whole").select("place")
    return same.union(shorter).union(longer).distinct().select("place.*")


def _cut(text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, wholes in _unpacked(batches):
            texts, counts, gone = [], [], []
            for whole, g in zip(wholes, batch.column("gone").to_pylist(), strict=True):
                lines = [] if whole is None else whole.split("\n")
                drop = set(g or ())
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop and lines else whole)
                counts.append(len(lines))
                gone.append(len(drop & set(range(len(lines)))))
            yield with_columns(batch, **{text: pa.array(texts, pa.string()), "n_lines": pa.array(counts, pa.int32()),
                                         "n_dropped": pa.array(gone, pa.int32())}).select(names)
    return run


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int | None = None) -> DataFrame:
    """``docs`` with the repeated lines out of ``text``, and ``n_lines``, ``n_dropped``.
    ``min_words`` leaves lines of fewer words alone; by default every line takes part."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    with scratch_scope(docs.sparkSession):
        gone = materialize(_gone(rows, min_words), "gone", result=True)
    clash = [c for c in docs.columns if c.lower() in ("n_lines", "n_dropped", "packed", "gone", "_llm_doc")]
    docs = docs.drop(*clash)
    schema = added(docs.schema, **{text: T.StringType(), "n_lines": T.IntegerType(), "n_dropped": T.IntegerType()})
    whole = docs.withColumnRenamed(text, "text").mapInArrow(
        _pack, T.StructType([f for f in docs.schema.fields if f.name != text] + [T.StructField("packed", T.BinaryType())]))
    return (whole.join(gone.hint("merge"), whole[doc] == gone["_llm_doc"], "left").drop("_llm_doc")
            .mapInArrow(_cut(text, schema.names), schema))


def _gone(rows: DataFrame, min_words: int | None) -> DataFrame:
    """``_llm_doc, gone``: the lines that go out of each document with any."""
    kind, long, int_ = rows.schema["doc"].dataType, T.LongType(), T.IntegerType()
    found = materialize(rows.where("doc is not null").mapInArrow(_scan(min_words), T.StructType(
        [T.StructField("doc", kind), T.StructField("line", int_), T.StructField("n", int_)]
        + [T.StructField(c, long) for c in ("h1", "h2", *KEYS)])), "lines")
    place = F.struct("doc", "line")
    first = materialize(found.groupBy("h1", "h2", "n").agg(F.min(place).alias("place"), F.count("*").alias("copies")), "distinct_lines")
    near = near_lines(found, first, rows, min_words).withColumn("near", F.lit(True))
    marked = (first.select("h1", "h2", "n", "copies", "place", F.col("place.doc").alias("doc"), F.col("place.line").alias("line"))
              .join(near, ["doc", "line"], "left").where("copies > 1 or near")
              .select("h1", "h2", "n", F.col("place").alias("kept"), F.coalesce("near", F.lit(False)).alias("near")))
    return (found.select("h1", "h2", "n", "doc", "line").join(marked.hint("merge"), ["h1", "h2", "n"])
            .where(F.col("near") | (place != F.col("kept")))
            .groupBy("doc").agg(F.collect_set("line").alias("gone")).withColumnRenamed("doc", "_llm_doc"))
