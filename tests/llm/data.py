"""Small documents with the cases that every operator must bear."""

from __future__ import annotations

import random

from pyspark.sql import types as T

ODD = [None, "", " ", "\n\n", "a", "  two  blanks ", " lead", "trail ", "tab\tand\r\nfeed", "▁mark ▁▁ x", "<|endoftext|> special </s> <unk>",
       "é́ combining ﬁ　wide 𝒳 😀", "x\x00y\x0bz\x1cw", "!!! ???", "123 456", "A" * 3000, "don't you'll we've 12a3"]


def words(rng: random.Random, n: int, pool: int = 300) -> list[str]:
    return ["".join(rng.choice("abcdefgh") for _ in range(2)) + str(rng.randrange(pool)) for _ in range(n)]


def texts(seed: int = 0, n: int = 60) -> list[str | None]:
    """Odd texts, random ones, exact and near copies, one very long text."""
    rng = random.Random(seed)
    out = list(ODD)
    base = [words(rng, rng.randrange(5, 90)) for _ in range(n)]
    for w in base:
        out.append(" ".join(w))
        if rng.random() < 0.5:
            out.append(" ".join(w))
        for _ in range(rng.randrange(3)):
            v = list(w)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(v))
                kind = rng.randrange(3)
                v[i:i + (kind != 1)] = [] if kind == 0 else words(rng, 1)
            out.append(" ".join(v))
    lines = [" ".join(words(rng, rng.randrange(1, 25), 3)) for _ in range(30)]
    for _ in range(n // 2):
        picked = [rng.choice(lines) for _ in range(rng.randrange(1, 6))]
        for i in range(len(picked)):
            if rng.random() < 0.4:
                v = picked[i].split()
                v[rng.randrange(len(v))] = "changed"
                picked[i] = " ".join(v)
        out.append("\n".join(picked))
    out.append(" ".join(words(rng, 20_000)))
    return out


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       *(T.StructField(c, T.StringType()) for c in ("ids", "score", "key", "packed", "n", "c", "lang"))])


def frame(spark, rows, parts: int = 3):
    """Documents with further columns whose names operators use themselves."""
    full = [(i, t, "i", "s", "k", "p", "n", "c", None) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts, "doc_id").sortWithinPartitions("doc_id", "text")


def documents(spark, path, seed: int = 0, nulls: bool = True, repeats: bool = True):
    """The texts as a table in files, with a null id and repeated rows."""
    rows = list(enumerate(texts(seed)))
    if nulls:
        rows.append((None, "a row without an id a row without an id"))
    if repeats:
        rows += rows[20:24]
    frame(spark, rows).write.parquet(str(path))
    return spark.read.parquet(str(path)), rows
