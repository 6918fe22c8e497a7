"""Column functions on literal tables."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordat.functions import blocks as B
from concordat.functions import fingerprints as FP
from concordat.functions import paths as P
from concordat.functions import patterns as M
from concordat.functions import props as PR
from concordat.functions import text as TX
from concordat.operators import listings as L
from concordat.sources.remote import decode_name, parse_time
from suite import records  # noqa: F401
from suite.registry import QUERIES

# (pattern, path, matches)
PATTERN_CASES = [
    ("Name *.tmp", "a/b.tmp", True), ("Name *.tmp", "a.tmp/b", False), ("*.tmp", "x.tmp", True),
    ("Path .git", ".git", True), ("Path .git", "a/.git", False), ("Path a/*", "a/b", True),
    ("Path a/*", "a/b/c", False), ("Regex .*~$", "dir/x~", True), ("Regex ^a", "ba", False),
    ("Name {CVS,.svn,.git}", "x/.svn", True), ("Name {CVS,.svn,.git}", "x/svn", False),
    ("Name [!abc].txt", "d.txt", True), ("Name [!abc].txt", "a.txt", False), ("Name [a-c]", "b", True),
    ("{CVS,*.cmo}", "m.cmo", True), ("Name {a,{b,c}}d", "cd", True), ("Name a?c", "abc", True),
    ("Name a?c", "a/c", False), ("Name \\*", "*", True), ("Name \\*", "x", False),
    ("BelowPath a/b", "a/b", True), ("BelowPath a/b", "a/b/c/d", True), ("BelowPath a/b", "a/bc", False),
    ("Name a+b(1).txt", "a+b(1).txt", True), ("Name *.txt", "a.txt\n", False),
    ("Name file,1", "file,1", True), ("Name x}", "x}", True), ("Name\t*.o", "k.o", True),
]


def test_patterns(spark):
    df = spark.createDataFrame([(i, p) for i, (_, p, _) in enumerate(PATTERN_CASES)], "i int, path string")
    tests = F.coalesce(*[F.when(F.col("i") == i, M.any_of(F.col("path"), [s])) for i, (s, _, _) in enumerate(PATTERN_CASES)])
    for r in df.select("i", tests.alias("hit")).collect():
        assert r["hit"] == PATTERN_CASES[r["i"]][2], PATTERN_CASES[r["i"]]


def test_ignored_self_and_below(spark):
    rows = [("",), ("a",), ("a/b",), ("a/keep.txt",), ("x/y.tmp",), ("x/y.tmp/z",), (".concordat.x",), ("q/r.concordat.tmp",)]
    df = spark.createDataFrame(rows, "path string")
    p = F.col("path")
    got = {r[0]: r[1:] for r in df.select(
        p, M.ignored(p, ["Path a", "Name *.tmp"], ["Name keep.txt"]),
        M.ignored_or_below(p, ["Path a", "Name *.tmp"]),
        M.ignored_or_below(p, ["Path a", "Name *.tmp"], ["Name keep.txt"])).collect()}
    assert got == {
        "": (False, False, False), "a": (True, True, True), "a/b": (False, True, True),
        "a/keep.txt": (False, True, True), "x/y.tmp": (True, True, True), "x/y.tmp/z": (False, True, True),
        ".concordat.x": (True, True, True), "q/r.concordat.tmp": (True, True, True)}


def test_fast_and_general_ignore_agree(spark):
    names = ["a", "b.tmp", "src", "é", "x-y", "keep"]
    rnd = random.Random(3)
    rows = [("/".join(rnd.choice(names) for _ in range(rnd.randint(1, 5))),) for _ in range(400)]
    df = spark.createDataFrame(rows, "path string").distinct()
    specs = ["Name *.tmp", "Path a/src", "BelowPath x-y/*", "Name [!a-z]"]
    p = F.col("path")
    slow = F.exists(P.ancestors(p), lambda a: M.ignored(a, specs))
    assert df.where(M.ignored_or_below(p, specs) != slow).isEmpty()


def test_paths(spark):
    df = spark.createDataFrame([("",), ("a",), ("a/b/c.txt",)], "path string")
    p = F.col("path")
    got = [tuple(r) for r in df.select(P.depth(p), P.parent(p), P.name(p), P.first(p), P.rest(p),
                                       F.size(P.segments(p)), F.size(P.ancestors(p))).collect()]
    assert got == [(0, None, "", None, None, 0, 0), (1, "", "a", "a", "", 1, 1),
                   (3, "a/b", "c.txt", "a", "b/c.txt", 3, 3)]


def test_case_modes():
    assert P.pair_case_mode("sensitive", "insensitive") == "insensitive"
    assert P.pair_case_mode("sensitive", "sensitive") == "sensitive"
    assert P.pair_case_mode("unicode", "insensitive") == "unicode_insensitive"


def test_nfc(spark):
    df = spark.createDataFrame([("ä",), ("ä",), ("plain",), (None,)], "s string")
    assert [r[0] for r in df.select(P.nfc(F.col("s"))).collect()] == ["ä", "ä", "plain", None]
    assert df.select(P.nfd(F.col("s"))).first()[0] == "ä"


def test_resolve_dots(spark):
    df = spark.createDataFrame([("a/../b",), ("a/./b",), ("../x",), ("a/b/../../c",), ("a/b",), ("a/..",)], "p string")
    assert [r[0] for r in df.select(L.resolve_dots(F.col("p"))).collect()] == ["b", "a/b", None, "c", "a/b", ""]


@pytest.mark.parametrize("seconds,fat,same", [(0.9, False, True), (1, False, False), (2, True, True), (2.9, True, True), (3, True, False)])
def test_times(spark, seconds, fat, same):
    a = F.timestamp_millis(F.lit(1_700_000_000_000))
    b = F.timestamp_millis(F.lit(1_700_000_000_000 + int(seconds * 1000)))
    row = spark.range(1).select(PR.times_similar(a, b, fat), PR.times_similar(b, a, fat)).first()
    assert tuple(row) == (same, same)


def test_pseudo_fp(spark):
    # 'LEN', size 258 little endian, hash of "ab" = 97*31+98, closing zero byte.
    fp = spark.range(1).select(FP.pseudo_fp(F.lit("ab"), F.lit(258))).first()[0]
    assert fp == "4c454e" + "0201000000000000" + f"{97 * 31 + 98:08x}" + "00"
    assert spark.range(1).select(FP.path_hash(F.lit("")), FP.path_hash(F.lit("😀"))).first() == (0, 0xD83D * 31 + 0xDE00)


def test_row_fp_separates(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("\\N", "x"), ("a\\", "b"), ("a", "\\b")], "x string, y string")
    assert df.select(FP.row_fp(df, ["x", "y"])).distinct().count() == 6


def test_known_md5(spark):
    got = spark.range(1).select(FP.content_fp(F.lit(b"")), FP.content_fp(F.lit(b"hello")), FP.range_fp(F.lit(b"xhellox"), 1, 5)).first()
    assert tuple(got) == ("d41d8cd98f00b204e9800998ecf8427e", "5d41402abc4b2a76b9719d911017c592", "5d41402abc4b2a76b9719d911017c592")


def test_weak_hash_against_definition():
    def slow(data):
        s = 0
        for c in data:
            s = (s * B.WEAK_BASE + c) & (2 ** 31 - 1)
        return s
    data = np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8).tobytes()
    assert B.weak_of(data) == slow(data)
    for w in (1, 2, 700, 5000):
        rolled = B.weak_at_every_offset(data, w)
        assert len(rolled) == len(data) - w + 1
        for off in {0, len(rolled) // 2, len(rolled) - 1}:
            assert rolled[off] == slow(data[off:off + w])
    assert len(B.weak_at_every_offset(b"abc", 4)) == 0


@pytest.mark.parametrize("n,size", [(0, 700), (-5, 700), (10_000, 700), (1 << 20, 1024), (100_000_000, 8192), (1 << 40, 131072)])
def test_block_size(spark, n, size):
    assert spark.range(1).select(B.block_size(F.lit(n))).first()[0] == size


def test_formats(spark):
    row = spark.range(1).select(
        TX.format_bytes(F.lit(1023)), TX.format_bytes(F.lit(1536)), TX.format_bytes(F.lit(5 * 1024 ** 3)),
        TX.format_rate(F.lit(10.0)), TX.format_rate(F.lit(2_097_152.0)), TX.format_eta(F.lit(None).cast("long")),
        TX.format_eta(F.lit(59)), TX.format_eta(F.lit(61)), TX.format_eta(F.lit(7260))).first()
    assert tuple(row) == ("1023 B", "1.5 KB", "5.0 GB", "10 B/s", "2.0 MB/s", "--:--", "59s", "1m 1s", "2h 1m")


def test_formats_of_products_beyond_64_bits(spark, tmp_path):
    """Keys of large tables: their product is still exact."""
    keys = [(1, 1023), (32, 1), (3_000_000, 3_000_000), (90_000_123, 599_999), (0, 5), (None, 1), (-7, 40)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderkey"]: r["text"] for r in QUERIES["format_bytes"](spark, str(tmp_path)).collect()}
    assert got == {1: "1023 B", 32: "1.0 KB", 3_000_000: "25145709514.6 GB",
                   90_000_123: f"{Decimal(90_000_123 ** 2 * 599_999 / 1024 ** 3).quantize(Decimal('0.1'))} GB",
                   0: "0 B", None: None, -7: "1.9 KB"}


def test_remote_texts(spark):
    row = spark.range(1).select(
        F.date_format(parse_time(F.lit("Sun, 06 Nov 1994 08:49:37 GMT")), "yyyy-MM-dd HH:mm:ss"),
        F.date_format(parse_time(F.lit("2024-02-03T04:05:06Z")), "yyyy-MM-dd HH:mm:ss"),
        parse_time(F.lit("whenever")), decode_name(F.lit("a%20b+c")), decode_name(F.lit("100%"))).first()
    assert tuple(row) == ("1994-11-06 08:49:37", "2024-02-03 04:05:06", None, "a b+c", "100%")
