"""Fields and links of raw pages, and batched calls of a function."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import canonical_url, canonical_urls
from ..sources.io import scratch


def extract_fields(pages: DataFrame, key: str, col: str) -> DataFrame:
    """title, lang, n_links, n_paragraphs and the first heading of each page."""

    def one(page: str | None) -> tuple:
        page = page or ""
        find = lambda p: html.unescape(m.group(1)).strip() if (m := re.search(p, page, re.S | re.I)) else None
        return find(r"<title[^>]*>(.*?)</title"), find(r"<html[^>]*\blang=[\"']?([\w-]+)"), find(r"<h1[^>]*>(.*?)</h1"), len(re.findall(r"<a\s[^>]*href", page, re.I)), len(re.findall(r"<p[\s>]", page, re.I))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [one(p) for p in f[col]]
            out = pd.DataFrame(rows, columns=["title", "lang", "heading", "n_links", "n_paragraphs"])
            out.insert(0, key, f[key].values)
            yield out

    return pages.select(key, col).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, title string, lang string, heading string, n_links long, n_paragraphs long")


class _Fields(HTMLParser):
    """Title, language, first heading, link and paragraph counts, and label/value pairs: <dt> with its <dd>s, <th> with the
    <td>s of its row, and `label: value` texts of <li> and <p>."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title = self.lang = self.heading = None
        self.links = self.paragraphs = 0
        self.pairs: list[tuple[str, str]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.label = self.skip = None

    def handle_starttag(self, tag, attrs):
        if tag == "html" and self.lang is None:
            self.lang = dict(attrs).get("lang")
        self.links += tag == "a" and any(k == "href" for k, _ in attrs)
        self.paragraphs += tag == "p"
        if tag in ("script", "style"):
            self.skip = tag
        if tag in ("dt", "dd", "th", "td", "li", "p", "tr"):  # these end one another
            while self.open and self.open[-1][0] in ("dt", "dd", "th", "td", "li", "p"):
                self._end(self.open[-1][0])
        if tag in ("tr", "dl", "table", "ul", "ol"):
            self.label = None
        if tag in ("title", "h1", "dt", "dd", "th", "td", "li", "p"):
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag == self.skip:
            self.skip = None
        if any(t == tag for t, _ in self.open):
            while self._end(self.open[-1][0]) != tag:
                pass
        if tag in ("tr", "dl", "table", "ul", "ol"):
            while self.open and self.open[-1][0] in ("dt", "dd", "th", "td", "li", "p"):
                self._end(self.open[-1][0])
            self.label = None

    def handle_data(self, data):
        if self.open and not self.skip:
            for _, held in self.open:
                held.append(data)

    def close(self):
        super().close()
        while self.open:
            self._end(self.open[-1][0])

    def _end(self, tag: str) -> str:
        _, held = self.open.pop()
        text = " ".join("".join(held).split())
        if tag == "title" and self.title is None:
            self.title = text
        elif tag == "h1" and self.heading is None:
            self.heading = text
        elif tag in ("dt", "th"):
            self.label = text
        elif tag in ("dd", "td") and self.label:
            self.pairs.append((self.label, text))
        elif tag in ("li", "p") and (m := re.fullmatch(r"([^:]{1,40}):\s+(.+)", text)):
            self.pairs.append((m.group(1).strip(), m.group(2)))
        return tag


def page_fields(pages: DataFrame, key: str, col: str) -> DataFrame:
    """key, title, lang, heading, n_links, n_paragraphs and pairs (label, value) of each page, by a parser."""

    def one(page: str | None) -> tuple:
        p = _Fields()
        p.feed(page or "")
        p.close()
        return p.title, p.lang, p.heading, p.links, p.paragraphs, [{"label": a, "value": b} for a, b in p.pairs]

    pair = pa.struct([("label", pa.string()), ("value", pa.string())])
    kinds = [("title", pa.string()), ("lang", pa.string()), ("heading", pa.string()), ("n_links", pa.int64()), ("n_paragraphs", pa.int64()), ("pairs", pa.list_(pair))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*map(one, b.column(1).to_pylist()), strict=True)) or [()] * len(kinds)
            yield pa.record_batch([b.column(0), *[pa.array(list(c), t) for c, (_, t) in zip(rows, kinds, strict=True)]], [key, *[n for n, _ in kinds]])

    return pages.select(key, col).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, title string, lang string, heading string, n_links long, n_paragraphs long, pairs array<struct<label: string, value: string>>")


def typed_fields(fields: DataFrame, key: str, spec: dict[str, tuple[str, str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """The key, columns to `keep` (so that pages needn't be parsed again for a join), and columns of named labels (compared without case): column -> (label, type). The first value of a label counts. Numbers may have
    blanks between digits, a decimal comma and a percent sign; dates are year-month-day or day.month.year. What can't be read is null."""

    def value(label: str, kind: str) -> Column:
        found = F.get(F.filter("pairs", lambda p: F.lower(p["label"]) == label.lower()), 0)["value"]
        if kind == "date":
            swapped = F.regexp_replace(found, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3-$2-$1")
            return F.when(swapped.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), swapped.try_cast("date"))
        if kind in ("double", "int", "long") or kind.startswith("decimal"):
            return F.replace(F.regexp_replace(found, r"[\s\u00a0%]", ""), F.lit(","), F.lit(".")).try_cast(kind)
        return found.cast(kind)

    return fields.select(key, *keep, *[value(label, kind).alias(c) for c, (label, kind) in spec.items()])


def frontier(pages: DataFrame, url: str, col: str, seeds: DataFrame, pattern: str, base: str, most_rounds: int = 1000) -> DataFrame:
    """All links that can be reached from the seeds (url): url, level (links away from a seed) and parent (the least url of
    the level before that links to it). Pages are parsed once, into a row of links each; each round joins only the links found
    new in the last one with the pages' links, and ends when none is new. Every round is a written table, which the next one reads."""
    spark = pages.sparkSession
    parent = F.get(canonical_urls(F.array(url), base), 0)
    urls = canonical_urls(F.array_distinct(F.regexp_extract_all(col, F.lit(r'href="([^"#]+)"'), 1)), base)
    # no filter or explode before the table is written: Spark would copy the expressions into them
    edges = pages.select(parent.alias("parent"), F.array_distinct(F.filter(urls, lambda x: x.rlike(pattern))).alias("urls"))
    top = scratch(spark)
    edges.write.parquet(f"{top}/edges")
    edges = spark.read.schema(edges.schema).parquet(f"{top}/edges")
    found = seeds.select(canonical_url("url", base).alias("url"), F.lit(None).cast("string").alias("parent")).distinct()
    schema = found.schema
    for level in range(most_rounds):
        path = f"{top}/seen/level={level}"
        found.write.parquet(path)
        last = spark.read.schema(schema).parquet(path)
        if last.isEmpty():
            break
        seen = spark.read.schema(schema).option("basePath", f"{top}/seen").parquet(f"{top}/seen")
        met = edges.join(last.select(F.col("url").alias("parent")), "parent").select("parent", F.explode("urls").alias("url"))
        new = met.groupBy("url").agg(F.min("parent").alias("parent"))
        found = new.join(seen.select("url"), "url", "left_anti").select("url", "parent")
    else:
        raise RuntimeError(f"links go on beyond {most_rounds} levels")
    return spark.read.schema("url string, parent string, level int").option("basePath", f"{top}/seen").parquet(f"{top}/seen")


def links(pages: DataFrame, col: str, base: str) -> DataFrame:
    """Distinct canonical links of all pages."""
    found = pages.select(F.explode(F.regexp_extract_all(col, F.lit(r'href="([^"#]+)"'), 1)).alias("href"))
    return found.select(canonical_url("href", base).alias("url")).distinct()


def new_links(pages: DataFrame, col: str, seen: DataFrame, pattern: str, base: str) -> DataFrame:
    """Links that match a pattern and haven't been seen (seen: url)."""
    return links(pages, col, base).filter(F.col("url").rlike(pattern)).join(seen, "url", "left_anti")


def batched_apply(df: DataFrame, fn: Callable[[list[dict]], list], size: int, out: str = "answer", kind: str = "string") -> DataFrame:
    """Calls fn with `size` rows at a time, inside the tasks; fn returns a value for each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got: list = []
            for i in range(0, len(f), size):
                got += fn(f.iloc[i : i + size].to_dict("records"))
            yield f.assign(**{out: got})

    return df.mapInPandas(run, df.schema.simpleString()[7:-1] + f",{out}:{kind}")


def page_host(col: str) -> Column:
    return F.parse_url(F.col(col), F.lit("HOST"))
