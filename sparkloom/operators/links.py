"""Pages to a graph: links out of HTML, resolved against the page and matched with the pages there are."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.urls import resolved
from sparkloom.sources.tables import materialize

#: A comment, an element whose content is no markup, or the tag of a link; quotes may hold any sign.
_TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)|<a(?=[\s/])((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S | re.I)
_HREF = re.compile(r"""[\s/]*+([^\s=/>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.S)


def hrefs(page: str) -> list[str]:
    """The targets of a page's <a> elements, in order, as written but for character references. Of several href in one tag the first counts."""
    found = []
    for tag in _TAG.finditer(page):
        for name, *values in _HREF.findall(tag.group(2) or ""):
            if name.lower() == "href":
                found.append(html.unescape(next((v for v in values if v), "")))
                break
    return found


def links(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) to a row for each link: page_id, pos (from 0), href, target (absolute, without fragment; null if it is none).

    A null html has no links, a link of a page with a null url has a target only if it is absolute. Repeated pages have
    their links each. A tag whose quotes do not end is no link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [hrefs(p or "") for p in part.column(2).to_pylist()]
                rows = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array([j for x in found for j in range(len(x))], pa.int32()), pa.array([h for x in found for h in x], pa.string())], names=["page_id", "url", "pos", "href"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = plain.mapInArrow(run, "page_id long, url string, pos int, href string")
    return found.select("page_id", "pos", "href", resolved(F.col("href"), F.coalesce("url", F.lit(""))).alias("target"))


def nodes(pages: DataFrame) -> DataFrame:
    """url, page_id: each URL of the pages in the spelling of `links`, with the smallest id of the pages that have it."""
    url = resolved(F.col("url"), F.col("url"))
    return pages.select(url.alias("url"), F.col("page_id").cast("long").alias("page_id")).filter("url is not null").groupBy("url").agg(F.min("page_id").alias("page_id"))


def targets(pages: DataFrame, skip: str | None = None) -> DataFrame:
    """target, n_links, n_pages, page_id: every URL that is linked to, and the page at it, null where the end dangles.

    Links are counted by (target, page) and by target before the join with the pages, so that a target of very many
    links is one row there, and neither side is broadcast unless Spark finds it small. `skip`: a condition on links that do not count.
    """
    found = links(pages).filter("target is not null")
    found = found.filter(~F.expr(skip)) if skip else found
    counted = found.groupBy("target", "page_id").agg(F.count("*").alias("n")).groupBy("target").agg(F.sum("n").alias("n_links"), F.count("*").alias("n_pages"))
    return counted.join(nodes(pages).withColumnRenamed("url", "target"), "target", "left").select("target", "n_links", "n_pages", "page_id")


def edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between pages that exist, by page id, repeated links counted; loops count as well.

    The nodes are written before the join, so that Spark can split a page that very many link to.
    """
    ends = links(pages).filter("target is not null").groupBy("page_id", "target").agg(F.count("*").alias("n"))
    known = materialize(nodes(pages).select(F.col("url").alias("target"), F.col("page_id").alias("dst")), "nodes")
    return ends.join(known, "target").groupBy(F.col("page_id").alias("src"), "dst").agg(F.sum("n").alias("n"))
