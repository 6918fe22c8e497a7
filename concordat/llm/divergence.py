"""How the term shares of text sources differ, by pair tasks over sorted arrays.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lowered. A
language keeps the terms that stand in at least ``min_docs`` of its documents;
each gets a number in order of (language, term). A group, the documents of a
language from one source, is a sorted array of (term number, count), cut into
ranges of ``BLOCK`` numbers, so that no array grows with the vocabulary.

For each unordered pair of a language's sources and each range, the two arrays
meet in a co-group. The shorter one gallops through the longer one by binary
search. Terms of both are priced together, terms of one against the other's
share of an absent term, and terms of neither by their number alone, once for
the whole pair. Both directions get the sum.

A term's share in a group with ``n`` occurrences of kept terms is
``1 + floor(10^9 * (count + 5) / (n + 5 * V))``, in whole numbers of any size.

Counting is combined in each task before rows are shuffled. Null texts, languages and
sources are empty ones; a group without terms takes part with zero counts, and a
language without kept terms has pairs of value 0. Repeated rows count as
documents of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.operators.ordered import with_position
from concordat.session import materialize

MIN_DOCS = 30
SCALE, PRIOR = 1_000_000_000, 5
TOP_TERMS = 50
#: Term numbers of one array.
BLOCK = 1 << 16
#: Counts that a task holds before it hands them on.
ENTRIES = 300_000
#: Bytes of a text that are split into words at once.
PIECE = 4_000_000

_LETTERS = set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _LETTERS else 0x20 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text in UTF-8, in pieces cut between terms."""
    if len(text) <= PIECE:
        yield text.translate(_FOLD).split()
        return
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        part = text[at:end].translate(_FOLD)
        if end < len(text):
            last = part.rfind(b" ")
            while last < 0 and end < len(text):  # one term longer than a piece
                end = min(end + PIECE, len(text))
                part = text[at:end].translate(_FOLD)
                last = part.rfind(b" ")
            if end < len(text):
                part = part[:last + 1]
        yield part.split()
        at += len(part)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` summed over parts of the task; a row
    without term for each group that was seen."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            size = len(n) + 1
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array([*n, None], pa.binary()).cast(pa.string()),
                pa.array([*n.values(), 0], pa.int64()), pa.array([*(docs[t] for t in n), 0], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            if (lang, source) not in held:
                held[lang, source] = (Counter(), Counter())
                entries += 1
            n, docs = held[lang, source]
            before, seen = len(n), set()
            for words in terms(text.as_py() or b""):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            entries += len(n) - before
            if entries > ENTRIES:
                yield from flush()
                entries = 0
    yield from flush()


def shares(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """Shares of counts in a group, exact for counts of any size."""
    if len(count) and int(count.max()) + PRIOR > (1 << 62) // SCALE:
        count = count.astype(object)
    return 1 + SCALE * (count + PRIOR) // (total + PRIOR * kept)


def sparse_distance(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, total_a: int, total_b: int, kept: int) -> tuple[int, int]:
    """Sum of differences over the terms of either array, and their number.
    ``a`` and ``b`` are sorted term numbers with counts ``na`` and ``nb``."""
    if len(a) > len(b):
        return sparse_distance(b, nb, a, na, total_b, total_a, kept)
    pa_, pb_ = shares(na, total_a, kept), shares(nb, total_b, kept)
    none = np.zeros(1, np.int64)
    zero_a, zero_b = shares(none, total_a, kept)[0], shares(none, total_b, kept)[0]
    at = np.searchsorted(b, a)
    shared = np.zeros(len(a), bool)
    inside = at < len(b)
    shared[inside] = b[at[inside]] == a[inside]
    others = np.ones(len(b), bool)
    others[at[shared]] = False
    value = (sum(np.abs(pa_[shared] - pb_[at[shared]]).tolist()) + sum(np.abs(pa_[~shared] - zero_b).tolist())
             + sum(np.abs(pb_[others] - zero_a).tolist()))
    return int(value), int(len(a) + others.sum())


def _pair_task(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Two groups' arrays over one range of term numbers."""
    given = left if left.num_rows else right
    total_a, total_b, kept = (given.column(c)[0].as_py() for c in ("total_a", "total_b", "kept"))
    side = lambda t, c: np.asarray(t.column(c)[0].values, np.int64) if t.num_rows else np.zeros(0, np.int64)
    value, seen = sparse_distance(side(left, "ids"), side(left, "counts"), side(right, "ids"), side(right, "counts"), total_a, total_b, kept)
    return pa.table({"lang": [key[0].as_py()], "a": [key[1].as_py()], "b": [key[2].as_py()], "value": pa.array([value], pa.int64()), "seen": pa.array([seen], pa.int64())})


def _share(count: str, total: str, kept: str = "kept") -> Column:
    """What :func:`shares` gives, for columns."""
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({count} + {PRIOR} as decimal(20,0)) div cast({total} + {PRIOR} * {kept} as decimal(20,0))")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has the distance
    to each other source of the language, part ``term`` the terms whose share in
    the group exceeds their share in the language most."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    counts = materialize(rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
                         .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    words = counts.where("term is not null")
    kept = words.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= min_docs)
    kept = materialize(with_position(kept.select("lang", "term", "n_lang"), [F.col("lang"), F.col("term")], "id"), "kept")
    coded = materialize(words.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "coded")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("total_lang"))
    groups = (counts.where("term is null").select("lang", "source")
              .join(coded.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
              .join(langs, "lang", "left").na.fill(0, ["total", "kept", "total_lang"]))
    groups = materialize(groups, "groups")

    first, second = (groups.select("lang", F.col("source").alias(x), F.col("total").alias(f"total_{x}"), "kept") for x in "ab")
    pairs = materialize(first.join(second.drop("kept"), "lang").where("a < b"), "pairs")
    arrays = coded.groupBy("lang", "source", F.expr(f"id div {block}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("m")).select(
        "lang", "source", "block", F.col("m.id").alias("ids"), F.col("m.n").alias("counts"))
    arrays = materialize(arrays, "arrays")
    keys = ["lang", "a", "b", "block"]
    sides = [*keys, "total_a", "total_b", "kept", "ids", "counts"]
    left, right = (pairs.join(arrays.withColumnRenamed("source", x), ["lang", x]).select(*(F.col(c).alias(c) for c in sides)) for x in "ab")
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_pair_task, "lang string, a string, b string, value long, seen long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    zero = lambda x: _share("0L", f"total_{x}")
    absent = F.when(F.col("kept") > 0, (F.col("kept") - F.coalesce("seen", F.lit(0))) * F.abs(zero("a") - zero("b"))).otherwise(F.lit(0))
    distances = materialize(pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "a", "b", (F.coalesce("value", F.lit(0)) + absent).cast("long").alias("value")), "distances")
    both = distances.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        distances.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_part = both.withColumn("rank", F.row_number().over(order))

    p, q = _share("n", "total"), _share("n_lang", "total_lang")
    over = coded.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    term_part = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    tagged = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return tagged(pair_part, "pair").unionByName(tagged(term_part, "term"))


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0)::HUGEINT AS total
      FROM (SELECT DISTINCT lang, source FROM d) x),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR}) // (g.total + {PRIOR} * l.v) AS p,
        1 + {SCALE}::HUGEINT * (k.n + {PRIOR}) // (l.total + {PRIOR} * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
