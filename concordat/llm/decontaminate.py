"""Benchmark items that training documents quote, by a BM25 index with
block-max WAND.

The index holds the items; the passages of every training document query it.
Passages are windows of twice the longest item of a shard, half overlapping, so
an item that stands anywhere in a text lies whole in one of them. A score is the
BM25 weight of the item's terms that the passage has, as a share of the weight
of all its terms, and every item at or above ``min_score`` is retrieved.

For each batch numpy first sums block maxima per passage and block of items,
then, in blocks that can reach the threshold, the weights per item (terms that
many items have count in full for every passage); other passages end there. The
rest run block-max WAND.
What is retrieved is verified on the words: the item's last sentence is its
answer, what stands before it the question (items of one sentence have no
question), and the shares of their word shingles that the passage has must
reach ``min_overlap``.

Number of items, mean length and document frequencies are those of all items,
counted in Spark; each shard looks up the frequencies of its own words.

The items are read in shards of at most ``SHARD_WORDS`` words and of like
lengths; each shard is broadcast and answered in one pass over the documents,
without a shuffle. Words are runs of ASCII letters, digits and other
characters beyond ASCII, A-Z lowered. Null and wordless texts and items have no
hits. Repeated rows give repeated hits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from concordat.llm.arrow import offsets, slices, spread
from concordat.llm.grams import byte_table, shingles, word_hashes
from concordat.session import materialize

SHARD_WORDS = 200_000
BLOCK = 8
K1, B = 1.2, 0.75
MIN_SCORE, MIN_OVERLAP = 0.5, 0.5
SLICE_BYTES = 500_000
QUESTION_WORDS, ANSWER_WORDS = 5, 3
#: Words are runs of ASCII letters and digits and of what is beyond ASCII.
WORDS = byte_table(bytes(i for i in range(128) if not chr(i).isalnum()))


def _hashes(text: str) -> np.ndarray:
    return word_hashes(pa.array([text], pa.string()), WORDS)[0]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last sentence with a word."""
    ends = [i + 1 for i, c in enumerate(text) if c in ".!?\n"]
    for cut in reversed([0, *ends]):
        if len(_hashes(text[cut:])):
            return text[:cut], text[cut:]
    return "", text


class Statistics(NamedTuple):
    """What BM25 weights take from all items."""

    n: int
    mean: float
    df: dict[int, int]


class Index:
    """Postings of one shard of items, in order of item, with block maxima. Without
    ``stats`` the shard is all there is."""

    def __init__(self, items: list[tuple[object, str]], kind: pa.DataType | None = None, stats: Statistics | None = None):
        self.kind = kind or pa.int64()
        self.ids = [i for i, _ in items]
        words = [_hashes(t) for _, t in items]
        parts = [split_item(t) for _, t in items]
        self.question = [shingles(_hashes(q), QUESTION_WORDS) for q, _ in parts]
        self.answer = [shingles(_hashes(a), ANSWER_WORDS) for _, a in parts]
        self.answer_words = [min(ANSWER_WORDS, len(_hashes(a))) for _, a in parts]
        self.question_words = [min(QUESTION_WORDS, len(_hashes(q))) for q, _ in parts]
        lens = np.array([len(w) for w in words], float)
        self.window = 2 * int(lens.max())
        item = np.repeat(np.arange(len(items)), lens.astype(int))
        self.terms, term = np.unique(np.concatenate(words), return_inverse=True)
        pair, tf = np.unique(term.astype(np.int64) * len(items) + item, return_counts=True)
        term, item = pair // len(items), pair % len(items)
        df = np.bincount(term, minlength=len(self.terms))
        n_all, mean, of_all = (len(items), lens.mean(), df) if stats is None else (
            stats.n, stats.mean, np.array([stats.df[w] for w in self.terms.tolist()]))
        idf = np.log1p((n_all - of_all + 0.5) / (of_all + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[item] / mean))
        weight /= np.bincount(item, weight, len(items))[item]
        self.start, self.item, self.weight = offsets(df), item, weight
        self.most = np.maximum.reduceat(weight, self.start[:-1])
        self.n_blocks = -(-len(items) // BLOCK)
        block, owner = np.unique(term * self.n_blocks + item // BLOCK, return_inverse=True)
        top = np.zeros(len(block))
        np.maximum.at(top, owner, weight)
        self.block_of, self.block_max = block % self.n_blocks, top
        self.block_start = np.searchsorted(block // self.n_blocks, np.arange(len(self.terms) + 1))
        self.first_in_block = np.searchsorted(owner, np.arange(len(block) + 1))
        self.items, self.blocks = item.tolist(), self.block_of.tolist()
        self.common = df > max(BLOCK, len(items) // 8)
        often = np.bincount(item[self.common[term]], weight[self.common[term]], len(items))
        self.often = np.pad(often, (0, self.n_blocks * BLOCK - len(items))).reshape(-1, BLOCK)

    def search(self, terms: np.ndarray, least: float) -> Iterator[tuple[int, float]]:
        """Items whose weights of these distinct terms sum to ``least`` or more."""
        end = {t: int(self.start[t + 1]) for t in terms.tolist()}
        at = {t: int(self.start[t]) for t in end}
        live = list(end)
        while live:
            live.sort(key=lambda t: self.items[at[t]])
            bound, pivot = 0.0, -1
            for i, t in enumerate(live):
                bound += self.most[t]
                if bound >= least - 1e-12:
                    pivot = i
                    break
            if pivot < 0:
                return
            item = self.items[at[live[pivot]]]
            while pivot + 1 < len(live) and self.items[at[live[pivot + 1]]] == item:
                pivot += 1
            head, block = live[:pivot + 1], item // BLOCK
            bound = 0.0
            for t in head:
                a, b = int(self.block_start[t]), int(self.block_start[t + 1])
                k = bisect_left(self.blocks, block, a, b)
                if k < b and self.blocks[k] == block:
                    bound += self.block_max[k]
            if bound < least - 1e-12:  # nothing in this block before the next list comes in
                target = (block + 1) * BLOCK
                if pivot + 1 < len(live):
                    target = min(target, self.items[at[live[pivot + 1]]])
            else:
                score = sum(self.weight[at[t]] for t in head if self.items[at[t]] == item)
                behind = [t for t in head if self.items[at[t]] < item]
                if behind:
                    for t in behind:
                        at[t] = bisect_left(self.items, item, at[t], end[t])
                    live = [t for t in live if at[t] < end[t]]
                    continue
                if score >= least - 1e-12:
                    yield item, min(1.0, float(score))
                target = item + 1
            for t in head:
                at[t] = bisect_left(self.items, target, at[t], end[t])
            live = [t for t in live if at[t] < end[t]]

    def overlap(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and the answer's shingles that stand in the passage."""
        out = []
        for want, n in ((self.question[item], self.question_words[item]), (self.answer[item], self.answer_words[item])):
            out.append(float(np.isin(want, shingles(passage, n)).mean()) if len(want) and len(passage) >= n else float(not len(want)))
        return out[0], out[1]


def _query(index, doc: str, text: str, min_score: float, min_overlap: float, drop: bool = False):
    """Hits, or with ``drop`` the rows that have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Index = index.value
        stride = x.window // 2
        for batch in batches:
            for part in slices(iter([batch]), text, SLICE_BYTES):
                h, counts, _ = word_hashes(part.column(text), WORDS)
                found = np.minimum(np.searchsorted(x.terms, h), len(x.terms) - 1)
                known = x.terms[found] == h
                firsts = np.cumsum(counts) - counts
                windows = np.maximum(1, -(-counts // stride) - 1) * (counts > 0)  # of each text
                base = offsets(windows)
                word_doc = np.repeat(np.arange(len(counts)), counts)
                used = np.flatnonzero(known & ~x.common[found])
                d = word_doc[used]
                step = (used - firsts[d]) // stride
                inside = []
                for shift in (0, 1):  # the windows that start here and one stride before
                    w = step - shift
                    ok = (w >= 0) & (w < windows[d])
                    inside.append((base[d[ok]] + w[ok]) * len(x.terms) + found[used[ok]])
                inside = np.unique(np.concatenate(inside))  # a term counts once in a passage
                window, t = inside // len(x.terms), inside % len(x.terms)
                n = x.block_start[t + 1] - x.block_start[t]
                k = spread(x.block_start[t], n)
                cell = np.repeat(window * x.n_blocks, n) + x.block_of[k]
                bounds = np.bincount(cell, x.block_max[k], int(base[-1]) * x.n_blocks).reshape(-1, x.n_blocks)
                open_cells = (bounds + x.often.max(1) >= min_score - 1e-9).ravel()
                place = np.cumsum(open_cells) - 1
                cells = np.flatnonzero(open_cells)
                sums = x.often[cells % x.n_blocks]
                # within the open blocks, by item
                cell, k = cell[open_cells[cell]], k[open_cells[cell]]
                n = x.first_in_block[k + 1] - x.first_in_block[k]
                posting = spread(x.first_in_block[k], n)
                at = np.repeat(place[cell] * BLOCK, n) + x.item[posting] % BLOCK
                sums = sums + np.bincount(at, x.weight[posting], sums.size).reshape(sums.shape)
                open_windows = np.unique(cells[(sums >= min_score - 1e-9).any(1)] // x.n_blocks)
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                for w in open_windows.tolist():
                    i = int(np.searchsorted(base, w, side="right")) - 1
                    a = int(firsts[i] + (w - base[i]) * stride)
                    b = int(min(a + x.window, firsts[i] + counts[i]))
                    terms = np.unique(found[a:b][known[a:b]])
                    for item, score in x.search(terms, min_score):
                        q, r = x.overlap(item, h[a:b])
                        if q >= min_overlap and r >= min_overlap:
                            best[i, item] = max(best.get((i, item), (0.0, 0.0, 0.0)), (score, q, r))
                if drop:
                    keep = np.ones(part.num_rows, bool)
                    keep[[i for i, _ in best]] = False
                    yield part.filter(pa.array(keep))
                    continue
                rows = sorted(best.items())
                yield pa.RecordBatch.from_arrays(
                    [part.column(doc).take(pa.array([k[0] for k, _ in rows], pa.int64())), pa.array([x.ids[k[1]] for k, _ in rows], x.kind),
                     *(pa.array([v[j] for _, v in rows], pa.float64()) for j in range(3))],
                    names=["doc", "item", "score", "question_overlap", "answer_overlap"])
    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each item with the item's length at the first of them."""
    for batch in batches:
        for part in slices(iter([batch]), "text", SLICE_BYTES):
            h, counts, _ = word_hashes(part.column("text"), WORDS)
            owner = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            first = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[:len(h)]
            h, owner = h[first], owner[first]
            lead = np.append(True, owner[1:] != owner[:-1])[:len(h)]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.where(lead, counts[owner], 0).astype(np.int64)),
                                              pa.array(lead.astype(np.int64))], names=["word", "length", "items"])


def shards(items: DataFrame, item: str, item_text: str, shard_words: int) -> Iterator[Index]:
    """Indexes of bounded size over items of like lengths, weighed by all items."""
    spark = items.sparkSession
    counted = materialize(
        items.where(F.col(item_text).isNotNull()).select(F.col(item_text).alias("text")).mapInArrow(_item_words, "word long, length long, items long")
        .groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("length").alias("length"), F.sum("items").alias("items")), "item_words")
    n_all, length = counted.agg(F.sum("items"), F.sum("length")).first()

    def built(shard: list) -> Index:
        own = np.unique(np.concatenate([_hashes(t) for _, t in shard])).view(np.int64)
        rows = counted.join(spark.createDataFrame(pa.table({"word": own})), "word", "left_semi").select("word", "df").collect()  # one shard's words
        df = {r["word"] % (1 << 64): r["df"] for r in rows}
        return Index(shard, kind, Statistics(n_all, length / n_all, df))

    shard, words, low = [], 0, 0
    kind = to_arrow_type(items.schema[item].dataType)
    for r in items.where(F.col(item_text).isNotNull()).select(item, item_text).orderBy(F.length(item_text), item).toLocalIterator():
        n = len(_hashes(r[1]))
        if not n:
            continue
        if shard and (words + n > shard_words or n > max(2 * low, 64)):
            yield built(shard)
            shard, words = [], 0
        low = low if shard else n
        shard.append((r[0], r[1]))
        words += n
    if shard:
        yield built(shard)


def contaminated(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                 min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc, item, score, question_overlap, answer_overlap`` of every document and
    item that it quotes, with the best passage's figures."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    kind = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), T.StructField("item", items.schema[item].dataType),
                         *(T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap"))])
    out = docs.sparkSession.createDataFrame([], kind)
    for n, index in enumerate(shards(items, item, item_text, shard_words)):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        found = rows.mapInArrow(_query(sent, "doc", "text", min_score, min_overlap), kind)
        out = out.unionByName(found) if n else found
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
          min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of ``docs`` that quote no item, in one pass over them."""
    for index in shards(items, item, item_text, shard_words):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.mapInArrow(_query(sent, "", text, min_score, min_overlap, drop=True), docs.schema)
    return docs
