"""Web pages: addresses, the page cache and comments in HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reviewlens import fixed_values as fixed
from reviewlens.session import stage
from reviewlens.sources.tables import replace_partitions


def page_plan(products: DataFrame, template: str) -> DataFrame:
    """The addresses of all full review pages of each product.

    ``products`` has pId, callback and maxsize.
    """
    pages = F.floor(F.col("maxsize") / fixed.PAGE_SIZE).cast("int")
    url = F.replace(F.lit(template), F.lit("@"), F.col("callback"))
    url = F.replace(url, F.lit("#"), F.col("pId").cast("string"))
    return (
        products.filter(pages > 0)
        .withColumn("page", F.explode(F.sequence(F.lit(0), pages - 1)))
        .select("pId", "page", F.replace(url, F.lit("$"), F.col("page").cast("string")).alias("url"))
    )


def set_query_parameter(url: Column, name: str, value: Column) -> Column:
    """The address with one parameter set; parameters without a value are dropped."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.+)$", 1)
    kept = F.filter(
        F.split(query, "&"), lambda p: p.rlike("^[^=]*=.") & ~p.startswith(f"{name}=")
    )
    new = F.concat(F.lit(f"{name}="), F.url_encode(value.cast("string")))
    return F.concat(base, F.lit("?"), F.array_join(F.array_append(kept, new), "&"), fragment)


def latest_pages(cache: DataFrame, now: Column, days: int = fixed.CACHE_DAYS) -> DataFrame:
    """The newest unexpired entry of each address."""
    return newest_pages(cache.filter(F.col("fetched_at") >= now - F.expr(f"interval {days} days")))


def newest_pages(cache: DataFrame) -> DataFrame:
    """The newest entry of each address.

    Addresses and times alone find the newest; its page is joined back, so no other page
    body is shuffled. Of entries with equal times the one with the larger other columns counts.
    """
    rest = [c for c in cache.columns if c not in ("url", "fetched_at")]
    entries = cache.withColumn("_tie", F.xxhash64(*rest))
    newest = entries.groupBy("url").agg(F.max(F.struct("fetched_at", "_tie")).alias("_newest"))
    found = entries.join(
        newest.select("url", "_newest.fetched_at", "_newest._tie"), ["url", "fetched_at", "_tie"]
    )
    return found.dropDuplicates(["url", "_tie"]).select("url", *rest, "fetched_at")


def upsert_pages(spark: SparkSession, path: str, delivery: DataFrame, buckets: int = 64) -> None:
    """Bring ``delivery`` (url, ..., fetched_at) into the stored cache: the newest of each address.

    The cache is kept in buckets of addresses. Only the buckets that the delivery touches are
    read, merged and written, and each replaces itself, so a delivery may be run again.
    """
    new = stage(delivery.withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")), "delivery")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
    stored = read_pages(spark, path, new.schema).filter(F.col("bucket").isin(touched))
    merged = newest_pages(stored.unionByName(new))
    replace_partitions(stage(merged, "merged").repartition("bucket"), path, ["bucket"])


def read_pages(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored cache with its ``bucket``; empty before the first delivery."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def cached(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """The addresses that the cache holds."""
    return urls.join(cache.select("url"), "url", "left_semi")


def fetch_plan(urls: DataFrame, cache: DataFrame, retries: int = 1) -> DataFrame:
    """The addresses to fetch: not cached, failed on the server, or empty.

    ``cache`` has one row per address; only its code and whether it has a page are joined.
    """
    known = cache.select(
        "url",
        F.col("code").alias("_code"),
        (F.coalesce(F.length("html"), F.lit(0)) == 0).alias("_empty"),
    )
    reason = F.when(F.col("_empty").isNull(), "uncached")
    if retries > 0:
        reason = reason.when(F.col("_code").between(500, 599), "server error")
    reason = reason.when(F.col("_empty"), "empty")
    return (
        urls.join(known, "url", "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .drop("_code", "_empty")
    )


def _with_class(tag: str, name: str) -> str:
    return rf'<{tag}\b[^>]*\bclass="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>'


# Named character references resolved in text.
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}
_PIECES = r"(?s)&#[0-9]+;|&#[xX][0-9a-fA-F]+;|&[a-z]+;|[^&]+|&"
_LAST_CODE_POINT = 0x10FFFF


def _resolved(piece: Column) -> Column:
    """The character of one reference; plain text and references to none stay as they are."""
    digits = F.regexp_extract(piece, r"^&#([0-9]+);$", 1)
    hexed = F.regexp_extract(piece, r"^&#[xX]0*([0-9a-fA-F]{1,6});$", 1)
    code = F.coalesce(digits.try_cast("int"), F.conv(hexed, 16, 10).try_cast("int"))
    # halves of surrogate pairs are no characters
    good = code.between(1, 0xD7FF) | code.between(0xE000, _LAST_CODE_POINT)
    character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    named = F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in (f"&{pair[0]};", pair[1])])
    return F.when(good, character).otherwise(F.coalesce(F.try_element_at(named, piece), piece))


def text_content(html: Column) -> Column:
    """Text without tags. Each character reference is resolved once, so what it stands for is not
    read again."""
    bare = F.regexp_replace(html, r"<[^>]*>", "")
    pieces = F.regexp_extract_all(bare, F.lit(_PIECES), F.lit(0))
    return F.when(bare.contains("&"), F.array_join(F.transform(pieces, _resolved), "")).otherwise(bare)


def html_comments(pages: DataFrame, html: str) -> DataFrame:
    """Votes, rating and text of every comment in the comment list of a page.

    The rating is the last but one character of the first class name of the rating mark,
    and 0 for a comment without one.
    """
    listing = F.regexp_extract(F.col(html), r'(?s)<div\b[^>]*\bid="comments"[^>]*>(.*)$', 1)
    blocks = F.split(listing, _with_class("div", "comment"))
    block = F.col("block")
    votes = F.regexp_extract(block, f"(?s){_with_class('span', 'votes')}(.*?)</span>", 1)
    marks = F.regexp_extract(
        block, r'<span\b[^>]*\bclass="((?:[^"]*\s)?rating(?:\s[^"]*)?)"', 1
    )
    paragraph = F.regexp_extract(block, r"(?s)<p(?:\s[^>]*)?>(.*?)</p>", 1)
    keys = [c for c in pages.columns if c != html]
    return (
        pages.select(*keys, F.posexplode(blocks).alias("pos", "block"))
        .filter(F.col("pos") > 0)
        .select(
            *keys,
            (F.col("pos") - 1).alias("pos"),
            F.trim(votes).try_cast("int").alias("votes"),
            F.coalesce(
                F.substring(F.split(marks, " ")[0], -2, 1).try_cast("int"), F.lit(0)
            ).alias("rating"),
            text_content(paragraph).alias("text"),
        )
    )
