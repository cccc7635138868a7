"""Main texts of web pages by wrappers that are inferred for each host from all its pages."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_tree import parse
from .html_wrapper import Wrapper, bounded, digest, merged, of_page
from .shared import settled, written
from .words import runs, texts_of

#: Wrappers that a task holds while it reads; wrappers that one merge takes.
HELD, FAN = 2000, 32
#: Bytes of all wrappers up to which they are broadcast; pages of a host that meet one copy of its wrapper beyond that.
BROADCAST_BYTES, ROWS = 32 << 20, 1_000_000

_WRAPPERS = "host string, wrapper string, pages long, part int"


def host(url: Column) -> Column:
    """The host of a URL in lower case, an empty string where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host of a task's pages."""
    found: dict[str, tuple[list, int]] = {}
    part = TaskContext.get().partitionId()

    def out() -> pa.RecordBatch:
        rows = [{"host": h, "wrapper": json.dumps(w, separators=(",", ":")), "pages": n, "part": part} for h, (w, n) in sorted(found.items())]
        found.clear()
        return pa.RecordBatch.from_pylist(rows, pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("pages", pa.int64()), ("part", pa.int32())]))

    for batch in batches:
        for h, text in zip(batch.column("host").to_pylist(), texts_of(batch, "html"), strict=True):
            page = of_page(parse(text), digest(text))
            before, n = found.get(h, (None, 0))
            found[h] = (bounded(merged(before, page)) if before else page, n + 1)
            if len(found) >= HELD:
                yield out()
    yield out()


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["part", "wrapper"])
    whole = None
    for w in frame["wrapper"]:
        whole = json.loads(w) if whole is None else bounded(merged(whole, json.loads(w)))
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [json.dumps(whole, separators=(",", ":"))], "pages": [int(frame["pages"].sum())], "part": [int(frame["part"].iloc[0]) // FAN]})


def infer(pages: DataFrame, column: str = "html", url: str = "url") -> DataFrame:
    """host, wrapper, pages, part: one wrapper for each host, aligned from all its pages.

    A task aligns the pages that it reads, host by host; the tasks' wrappers of a host are
    aligned FAN at a time, level by level, so no task ever holds a host's pages. Pages
    without a host share one wrapper; null pages are empty.
    """
    level = written(pages.select(host(F.col(url)).alias("host"), F.col(column).alias("html")).mapInArrow(_own, _WRAPPERS), "wrappers")
    parts = 1 + (level.agg(F.max("part")).first()[0] or 0)
    while True:
        level = level.groupBy("host", F.floor(F.col("part") / FAN).alias("group")).applyInPandas(_merged, _WRAPPERS)
        if parts <= FAN:
            return level
        parts = -(-parts // FAN)


@lru_cache(maxsize=64)
def _wrapper(text: str) -> Wrapper:
    return Wrapper(json.loads(text))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, wrappers = texts_of(batch, "html"), batch.column("wrapper").to_pylist()
        for lo, hi in runs(texts):
            made = [_wrapper(w).text(parse(t)) for t, w in zip(texts[lo:hi], wrappers[lo:hi], strict=True)]
            columns = {c: batch.column(c).slice(lo, hi - lo) for c in ("key", "url")}
            yield pa.RecordBatch.from_pydict(columns | {"text": pa.array(made, pa.string()), "n_chars": pa.array(list(map(len, made)), pa.int64())})


def extract(pages: DataFrame, key: str = "page_id", column: str = "html", url: str = "url") -> DataFrame:
    """key, url, text, n_chars: the main text of every page, one row for each row of `pages`.

    The page is matched with its host's wrapper, and each text is judged where the wrapper
    has it: inside an article, else inside a main region, else data of the page, that is
    neither a constant of the host's pages (known from PAGES different ones) nor a list of
    links; never inside menus, headers, footers, sidebars, notices, adverts, forms or
    comments. The best of these three levels that holds any text is the page's text. Blocks
    come in page order, one a line; character references are decoded and white space
    inside a block is one space (a line break too). A null page is an empty one and has an
    empty text; null and repeated keys keep a row each; an empty table gives an empty
    result; other columns are not read.

    Wrappers are broadcast if they are small together; beyond BROADCAST_BYTES pages and
    wrappers meet by host, with a copy of the wrapper for each ROWS pages of a hot host.
    """
    spark = pages.sparkSession
    wrappers = settled(lambda: infer(pages, column, url), spark, "host-wrappers")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(column).alias("html"), host(F.col(url)).alias("host"))
    kind = rows.schema["key"].dataType.simpleString()
    if (wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(wrappers.select("host", "wrapper")), "host", "left")
    else:
        copies = wrappers.select("host", "wrapper", F.ceil(F.col("pages") / ROWS).cast("int").alias("copies"))
        hot = copies.where("copies > 1").select("host", "copies")  # as many rows as pages / ROWS at most
        salt = F.pmod(F.xxhash64("key", "html"), F.coalesce("copies", F.lit(1))).cast("int").alias("salt")
        rows = rows.join(F.broadcast(hot), "host", "left").select("key", "url", "html", "host", salt)
        met = rows.join(copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))), ["host", "salt"], "left")
    out = met.select("key", "url", "html", "wrapper").mapInArrow(_texts, f"key {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("key", key)
