"""Remote listings that arrive as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Date formats of listings (weekday and zone name cut off first).
HTTP_DATE = "dd MMM yyyy HH:mm:ss"


def parse_time(text: Column) -> Column:
    """ISO or HTTP date; anything else is null."""
    http = F.regexp_extract(text, r"\A[A-Za-z]+, (.+) GMT\z", 1)
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.nullif(http, F.lit("")), F.lit(HTTP_DATE)))


def decode_name(text: Column) -> Column:
    """Percent-decoded; a plus sign stays a plus sign, bad escapes stay as
    they are."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def url_path(href: Column) -> Column:
    """Path part of a reference, with a trailing slash."""
    bare = F.regexp_replace(href, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    bare = F.regexp_replace(bare, r"[?#].*\z", "")
    return F.concat(F.rtrim(bare, F.lit("/")), F.lit("/"))


def remote_listing(df: DataFrame, request_url: str) -> DataFrame:
    """Listing rows from (href, is_directory, size, last_modified, etag): the
    requested directory itself drops out, paths are relative to it and
    decoded, bad dates and sizes become null and 0."""
    request = url_path(F.lit(request_url))
    here = url_path(F.col("href"))
    inside = F.substring(here, F.length(request) + 1, F.length(here))
    path = decode_name(F.rtrim(inside, F.lit("/")))
    size = F.coalesce(F.col("size").cast("string").try_cast("long"), F.lit(0).cast("long"))
    return (df.where(here.startswith(request) & (here != request))
            .select(path.alias("path"),
                    F.when(F.col("is_directory"), "directory").otherwise("file").alias("kind"),
                    F.when(F.col("is_directory"), F.lit(0)).otherwise(size).alias("length"),
                    parse_time(F.col("last_modified")).alias("mtime"), "etag")
            .where(F.col("path") != ""))
