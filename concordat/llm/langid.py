"""Language of words in code-switched text by a linear-chain conditional random
field.

A word's features are the byte n-grams of its lower-cased letters between word
borders (those at a border are its affixes) and its entry in a lexicon of words
seen in training. Transitions between the languages of neighbouring words are
learned with the feature weights. Forward-backward over the whole text gives
the probability of each language for each word.

Only the training set is bounded: ``docs_per_lang`` documents of each language,
chosen by a hash, with ``windows`` windows of ``SPAN`` words spread over each.
Half of the training sequences join windows of two languages, so that switches
are learned. Prediction reads every word of every text.

Null texts and texts without a letter are ``und`` with score 0. With no labelled
text at all every text is ``und``. A text's score is the mean probability of its
language over the words that have letters. Ties go to the language that sorts
first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.arrow import added, offsets, slices, spread, with_columns

SPAN = 40
GRAMS = (2, 3, 4)
BUCKETS = 1 << 17
SLICE_BYTES = 2_000_000
#: Words whose features are held at a time.
RUN_WORDS = 4096
UNKNOWN = "und"

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("lang", T.StringType())]))


@dataclass
class Model:
    langs: list[str]
    lexicon: list[str]
    weights: np.ndarray  # (BUCKETS + lexicon, languages)
    switch: np.ndarray  # log transition scores
    start: np.ndarray


def letters(words: pa.Array) -> pa.Array:
    """Lower-cased words without anything but letters."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}]+", "")


def _features(words: pa.Array, lexicon: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, and how many each has."""
    sizes = np.asarray(pc.binary_length(words), dtype=np.int64)
    data = np.frombuffer(("^" + "$^".join(words.to_pylist()) + "$").encode(), np.uint8).astype(np.uint32)
    lens = np.where(sizes > 0, sizes + 2, 0)
    first = np.cumsum(sizes + 2) - (sizes + 2)
    found, owner = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint32)
        for k in range(n):
            h = (h ^ data[k:len(data) - n + 1 + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        count = np.maximum(lens - n + 1, 0)
        found.append(h[spread(first, count)] % np.uint32(BUCKETS))
        owner.append(np.repeat(np.arange(len(words)), count))
    known = pc.index_in(words, value_set=lexicon) if len(lexicon) else pa.nulls(len(words), pa.int32())
    hit = np.flatnonzero(np.asarray(pc.is_valid(known)) & (sizes > 0))
    found.append((np.asarray(pc.fill_null(known, 0))[hit] + BUCKETS).astype(np.uint32))
    owner.append(hit)
    feats, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return feats[order].astype(np.int64), np.bincount(owner, minlength=len(words))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; empty runs give 0."""
    out = np.zeros((len(counts), values.shape[1]), values.dtype)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full])
    return out


def _emissions(words: pa.Array, lexicon: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Scores of all words, a run of words at a time: a word has some twenty
    features, so those of all words together would outweigh the texts."""
    e = np.empty((len(words), weights.shape[1]), weights.dtype)
    for i in range(0, len(words), RUN_WORDS):
        feats, per = _features(words.slice(i, RUN_WORDS), lexicon)
        e[i:i + RUN_WORDS] = _sums(weights[feats], per)
    return e


def _windows(text: str, lang: str, windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, name in zip(batch.column(text).to_pylist(), batch.column(lang).to_pylist(), strict=True):
                words = letters(pa.array(t.split() or [""], pa.string())).to_pylist()
                words = [w for w in words if w]
                n = min(windows, -(-len(words) // SPAN))
                for k in range(n):
                    at = k * (len(words) - SPAN) // max(n - 1, 1) if len(words) > SPAN else 0
                    rows.append((name, words[at:at + SPAN]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["lang", "words"])
    return run


def training_windows(docs: DataFrame, text: str, lang: str, key: Column, docs_per_lang: int, windows: int) -> DataFrame:
    """``lang, words``: windows of a bounded number of documents of each language."""
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(key, F.lit(4)).alias("h"))
    counts = labelled.groupBy("lang").count()  # one row per class of the model
    near = (labelled.join(F.broadcast(counts), "lang")
            .where(F.pmod("h", F.lit(1 << 30)) < F.lit(2.0 * docs_per_lang * (1 << 30)) / F.col("count"))
            .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
            .where(F.col("n") <= docs_per_lang).select("text", "lang"))
    return near.mapInArrow(_windows("text", "lang", windows), "lang string, words array<string>")


def _forward_backward(e: np.ndarray, a: np.ndarray, start: np.ndarray):
    """Marginals and summed pair marginals of equally long sequences, e: (S, T, L)."""
    s, t, k = e.shape
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = start * e[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        alpha[:, i] = (alpha[:, i - 1] @ a) * e[:, i]
        alpha[:, i] /= alpha[:, i].sum(1, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        right = e[:, i + 1] * beta[:, i + 1]
        beta[:, i] = right @ a.T
        both = alpha[:, i, :, None] * a * right[:, None, :]
        pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
        beta[:, i] /= beta[:, i].sum(1, keepdims=True)
    gamma = alpha * beta
    return gamma / gamma.sum(2, keepdims=True), pairs


def train(samples: list[tuple[str, list[str]]], rounds: int = 40, rate: float = 0.15, decay: float = 1e-4) -> Model:
    """Fit by Adam on the likelihood of all training sequences."""
    samples = sorted(samples)
    langs = sorted({lang for lang, _ in samples})
    k = len(langs)
    if not k:
        return Model([], [], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    rng = np.random.default_rng(0)
    of = {lang: i for i, lang in enumerate(langs)}
    order = rng.permutation(len(samples))
    seqs, tags = [], []
    for i, j in zip(order, np.roll(order, 1), strict=True):
        (la, a), (lb, b) = samples[i], samples[j]
        cut = int(rng.integers(1, SPAN)) if rng.random() < 0.5 else SPAN
        words = [*a[:cut], *b[:SPAN - min(cut, len(a))]] if cut < SPAN else a
        marks = [of[la]] * min(cut, len(a)) + [of[lb]] * SPAN
        seqs.append(words[:SPAN] + [""] * (SPAN - len(words[:SPAN])))
        tags.append((marks[:len(words)] + [marks[min(len(words), len(marks)) - 1]] * SPAN)[:SPAN])
    flat = pa.array([w for s in seqs for w in s], pa.string()).dictionary_encode()
    words, codes = flat.dictionary, np.asarray(flat.indices)
    counts = np.bincount(codes, minlength=len(words))
    lexicon = [w for w, n in zip(words.to_pylist(), counts, strict=True) if n >= 3 and w]
    feats, per = _features(words, pa.array(lexicon, pa.string()))
    owner, y = np.repeat(np.arange(len(words)), per), np.array(tags)
    seen = (codes != words.to_pylist().index("")).reshape(-1, SPAN) if "" in words.to_pylist() else np.ones_like(y, bool)
    want = np.eye(k)[y]
    want_pairs = np.zeros((k, k))
    np.add.at(want_pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    params = [np.zeros((BUCKETS + len(lexicon), k)), np.zeros((k, k)), np.zeros(k)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n = len(seqs)
    for step in range(1, rounds + 1):
        w, switch, start = params
        e = _sums(w[feats], per)[codes].reshape(n, SPAN, k)
        e = np.exp(e - e.max(2, keepdims=True))
        gamma, pairs = _forward_backward(e, np.exp(switch), np.exp(start))
        off = ((want - gamma) * seen[:, :, None]).reshape(-1, k)
        by_word = np.stack([np.bincount(codes, off[:, i], len(words)) for i in range(k)], 1)
        grads = [np.stack([np.bincount(feats, by_word[owner, i], len(w)) for i in range(k)], 1) / n - decay * w,
                 (want_pairs - pairs) / n - decay * switch, (want[:, 0] - gamma[:, 0]).mean(0) - decay * start]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] + rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-8)
    return Model(langs, lexicon, params[0].astype(np.float32), params[1], params[2])


def _marginals(e: np.ndarray, codes: np.ndarray, lens: np.ndarray, a: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals of all words of sequences of any length. Sequences are laid out
    by position, the longest first, so that one step works on all that reach it."""
    order = np.argsort(-lens, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    longest = int(lens.max())
    active = len(lens) - np.searchsorted(np.sort(lens), np.arange(longest), side="right")
    at = offsets(active)
    place = at[spread(np.zeros(len(lens)), lens)] + np.repeat(rank, lens)
    packed = np.empty((len(codes), e.shape[1]), np.float32)
    packed[place] = e[codes]
    alpha, a = np.empty_like(packed), a.astype(np.float32)
    alpha[:active[0]] = start.astype(np.float32) * packed[:active[0]]
    alpha[:active[0]] /= alpha[:active[0]].sum(1, keepdims=True)
    for t in range(1, longest):
        now = alpha[at[t - 1]:at[t - 1] + active[t]] @ a
        now *= packed[at[t]:at[t + 1]]
        now /= now.sum(1, keepdims=True)
        alpha[at[t]:at[t + 1]] = now
    right = np.empty((0, e.shape[1]), np.float32)
    back = np.ascontiguousarray(a.T)
    for t in range(longest - 1, -1, -1):
        beta = np.ones((active[t], e.shape[1]), np.float32)
        if len(right):
            got = right @ back
            beta[:len(got)] = got / got.sum(1, keepdims=True)
        alpha[at[t]:at[t + 1]] *= beta
        right = packed[at[t]:at[t + 1]] * beta
    alpha /= alpha.sum(1, keepdims=True)
    return alpha[place]


def _label(model: Model, text: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = pa.array(model.lexicon, pa.string())
        names = pa.array(model.langs, pa.string())
        a, start = np.exp(model.switch), np.exp(model.start)
        for batch in slices(batches, text, size):
            lists = pc.utf8_split_whitespace(pc.fill_null(batch.column(text).cast(pa.string()), ""))
            coded = pc.dictionary_encode(lists.flatten())
            codes, lens = np.asarray(coded.indices, dtype=np.int64), np.asarray(pc.list_value_length(lists), dtype=np.int64)
            words = letters(coded.dictionary)
            lettered = (np.asarray(pc.binary_length(words)) > 0)[codes] if len(words) else np.zeros(0, bool)
            docs = np.repeat(np.arange(batch.num_rows), lens)
            n = np.bincount(docs[lettered], minlength=batch.num_rows)
            if model.langs and len(codes):
                e = _emissions(words, lexicon, model.weights)
                p = _marginals(np.exp(e - e.max(1, keepdims=True)), codes, lens, a, start)
                sums = np.stack([np.bincount(docs[lettered], p[lettered, i], batch.num_rows) for i in range(len(names))], 1)
                best = sums.argmax(1)
                score = np.clip(sums.max(1) / np.maximum(n, 1), 0, 1)
                tags = p.argmax(1)
            else:
                n, best, score, tags = n * 0, n * 0, n * 0.0, codes * 0
                lens = lens * 0
                docs = docs[:0]
            known = n > 0
            lang = pc.if_else(pa.array(known), names.take(pa.array(np.where(known, best, 0))) if len(names) else UNKNOWN, UNKNOWN)
            cut = np.flatnonzero(np.diff(tags[:len(docs)], prepend=-1) | (np.diff(docs, prepend=-1) != 0)) if len(docs) else np.zeros(0, np.int64)
            inside = cut - (np.cumsum(lens) - lens)[docs[cut]]
            last = np.append(cut[1:], len(docs)) - (np.cumsum(lens) - lens)[docs[cut]] if len(cut) else cut
            spans = pa.StructArray.from_arrays(
                [pa.array(inside.astype(np.int32)), pa.array(last.astype(np.int32)),
                 names.take(pa.array(tags[cut])) if len(cut) else pa.array([], pa.string())], names=["start", "end", "lang"])
            runs = pa.ListArray.from_arrays(
                pa.array(offsets(np.bincount(docs[cut], minlength=batch.num_rows)).astype(np.int32)), spans)
            yield with_columns(batch, lang_pred=lang.cast(pa.string()), score=pa.array(np.where(known, score, 0.0).astype(np.float64)), lang_spans=runs)
    return run


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: Column | None = None,
        docs_per_lang: int = 300, windows: int = 6) -> Model:
    """A model from a bounded number of labelled documents. ``key`` only orders
    the documents for the choice."""
    sample = training_windows(docs, text, lang, F.col(text) if key is None else key, docs_per_lang, windows)
    return train([(r["lang"], r["words"]) for r in sample.toLocalIterator()])


def label(docs: DataFrame, model: Model, text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``lang_spans`` (runs of words,
    split at white space, in one language)."""
    return docs.mapInArrow(_label(model, text, slice_bytes),
                           added(docs.schema, lang_pred=T.StringType(), score=T.DoubleType(), lang_spans=SPANS))
