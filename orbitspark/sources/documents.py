"""JSON, HTML and paged-report sources."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import group_ids, latest_per_key


# ------------------------------------------------------------------ JSON
def read_elements(spark: SparkSession, path: str, source: str) -> tuple[DataFrame, DataFrame]:
    """An array of element sets whose numbers may be strings: (typed rows that have id and epoch, a row with the number skipped)."""
    kinds = {"NORAD_CAT_ID": "long", "EPOCH": "timestamp", "MEAN_MOTION": "double", "ECCENTRICITY": "double", "INCLINATION": "double", "RA_OF_ASC_NODE": "double", "ARG_OF_PERICENTER": "double", "MEAN_ANOMALY": "double", "BSTAR": "double", "REV_AT_EPOCH": "long", "CREATION_DATE": "timestamp"}
    raw = spark.read.schema(", ".join(f"{k} string" for k in kinds)).json(path, multiLine=True)
    names = {"NORAD_CAT_ID": "norad_id"}
    rows = raw.select(*(F.col(k).try_cast(t).alias(names.get(k, k.lower())) for k, t in kinds.items()), F.lit(source).alias("source"))
    ok = F.col("norad_id").isNotNull() & F.col("epoch").isNotNull()
    return rows.where(ok), rows.agg(F.count_if(~ok).alias("skipped"))


def read_known_keys(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """API records by a declared schema: unknown keys are dropped, absent ones null, a bad value null. A list, or pages with results."""
    text = spark.read.text(path, wholetext=True)
    paged = F.from_json("value", f"results array<struct<{_struct(schema)}>>")["results"]
    plain = F.from_json("value", f"array<struct<{_struct(schema)}>>")
    return text.select(F.inline(F.when(F.ltrim("value").startswith("["), plain).otherwise(paged)))


def _struct(schema: str) -> str:
    return ", ".join(f"{n.strip().split()[0]}:{n.strip().split()[1]}" for n in schema.split(","))


def is_error_stub(body: Column) -> Column:
    """A response that came as success and says error in its first element."""
    first = F.coalesce(F.get_json_object(body, "$[0].error"), F.get_json_object(body, "$.error"))
    return first.isNotNull()


class _Links(list):
    """Links found below a node, without a date yet or with one of their own."""


def _gathered(value) -> _Links:
    return value if isinstance(value, _Links) else _Links(x for v in value for x in _gathered(v)) if isinstance(value, list) else _Links()


def links_in(body: str, name: str = "name", url: str = "url", date: str = "date") -> list[tuple[str, str, str | None]]:
    """(name, url, date) of the nodes that have both, at any depth. The decoder hands each node over after what is inside it, so a
    node's date is given to the links below it that have none: the nearest one holds. A date may be a node with a display value."""

    def node(pairs: list[tuple[str, object]]) -> object:
        here = dict(pairs)
        shown = {k: v for k, v in here.items() if k in ("display_value", "value") and isinstance(v, str)}
        if shown and not any(isinstance(v, _Links) for v in here.values()):
            return shown.get("display_value") or shown.get("value")
        when = here.get(date) if isinstance(here.get(date), str) else None
        below = _Links((n, u, d or when) for v in here.values() for n, u, d in _gathered(v))
        own = [(str(here[name]), here[url], when)] if here.get(name) and isinstance(here.get(url), str) and here[url] else []
        return _Links(own + below)

    return list(_gathered(json.loads(body, object_pairs_hook=node)))


def walk_json(df: DataFrame, key: str, body: str, name: str = "name", url: str = "url", date: str = "date") -> DataFrame:
    """key, id, name, url, date for every named link in body; id is the last part of the url's path. One row per (key, id): the
    smallest by url, name and date. Malformed JSON gives none; a date is its first ten characters where these are a day."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, b in zip(pdf[key], pdf[body], strict=True):
                try:
                    out += [(k, *x) for x in links_in(b, name, url, date)]
                except (TypeError, ValueError):
                    continue
            yield pd.DataFrame(out, columns=[key, "name", "url", "date"])

    links = df.select(key, body).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, name string, url string, date string")
    plain = F.regexp_replace("url", r"\?.*$", "")
    day = F.regexp_extract("date", r"^\s*(\d{4}-.{5})", 1)
    links = links.select(key, F.regexp_extract(F.rtrim(plain, F.lit("/")), r"([^/]*)$", 1).alias("id"), F.trim("name").alias("name"), plain.alias("url"), F.nullif(day, F.lit("")).alias("date"))
    return latest_per_key(links, [key, "id"], [F.col("url").asc(), F.col("name").asc(), F.col("date").asc_nulls_last()])


# ------------------------------------------------------------------ HTML
class _Text(HTMLParser):
    """Collects links with their texts, table rows and plain text in one pass."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[tuple[str, str]] = []
        self.rows: list[list[str]] = []
        self.text: list[str] = []
        self._href, self._label, self._cell, self._skip = None, "", None, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self._skip += 1
        elif tag == "a":
            self._href, self._label = dict(attrs).get("href"), ""
        elif tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self._cell = ""

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self._skip = max(0, self._skip - 1)
        elif tag == "a" and self._href is not None:
            self.links.append((self._href, " ".join(self._label.split())))
            self._href = None
        elif tag in ("td", "th") and self._cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join(self._cell.split()))
            self._cell = None

    def handle_data(self, data):
        if self._skip:
            return
        self.text.append(data)
        if self._href is not None:
            self._label += data
        if self._cell is not None:
            self._cell += data


def parse_html(html: str | None) -> _Text:
    p = _Text()
    p.feed(html or "")
    p.close()
    return p


class StructureChanged(ValueError):
    """A page no longer has what is scraped from it."""


def badges(html: str, anchor: str) -> dict[str, int]:
    """Numbers shown inside links whose target holds `anchor`: target → number. A page without any has changed its structure."""
    out = {href: int(label) for href, label in parse_html(html).links if href and anchor in href and label.isdigit()}
    if not out:
        raise StructureChanged("no badges")
    return out


def code_table(html: str) -> dict[str, str]:
    """The code → meaning map of a page's two-column table."""
    return {r[0]: r[1] for r in parse_html(html).rows if len(r) == 2 and r[0] and not r[0].lower().startswith("code")}


def page_facts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, links, cells, chars: what a page's markup holds. A null page holds nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [parse_html(h) for h in pdf[html]]
            yield pd.DataFrame({key: pdf[key], "links": [len(p.links) for p in got], "cells": [sum(map(len, p.rows)) for p in got], "chars": [len(" ".join("".join(p.text).split())) for p in got]})

    return pages.select(key, html).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, links long, cells long, chars long")


# ------------------------------------------------------------------ paged reports
def is_complete_pdf(content: Column) -> Column:
    """Starts as a PDF and has its end mark in the last 2048 bytes."""
    tail = F.substr(content, F.greatest(F.lit(1), F.octet_length(content) - 2047))
    return F.coalesce(F.startswith(content, F.lit(b"%PDF-")) & F.contains(tail, F.lit(b"%%EOF")), F.lit(False))


def content_key(content: Column) -> Column:
    return F.sha2(content, 256)


def is_report(pages: Column, anchors: list[str], least: int = 2) -> Column:
    """At least `least` of the anchors stand in the first three pages."""
    head = F.array_join(F.slice(pages, 1, 3), "\n")
    return sum((F.when(F.contains(head, F.lit(a)), 1).otherwise(0) for a in anchors), F.lit(0)) >= least


def scalars(reports: DataFrame, key: str, patterns: dict[str, str]) -> DataFrame:
    """First match of each pattern's group and its page: key, then NAME and NAME_page."""
    p = reports.select(key, F.posexplode("pages").alias("_p", "_t"))
    first = [F.min(F.when(F.regexp_like("_t", F.lit(rx)), F.struct((F.col("_p") + 1).alias("page"), F.trim(F.regexp_extract("_t", rx, 1)).alias("v")))).alias(n) for n, rx in patterns.items()]
    return p.groupBy(key).agg(*first).select(key, *(c for n in patterns for c in (F.col(f"{n}.v").alias(n), F.col(f"{n}.page").alias(f"{n}_page"))))


def labelled_groups(reports: DataFrame, key: str, line: str, fields: dict[str, str]) -> DataFrame:
    """Repeated blocks of labelled numbers: a block closes when any of its labels comes again. key, block, source_page, then each
    field and its page.

    line: a pattern with the label and the number as groups. Labels not in fields, and numbers that do not parse, are passed over.
    The matches become rows, relational.group_ids numbers the blocks, and an aggregate puts each block's fields side by side.
    """
    page = reports.select(key, F.posexplode("pages").alias("_page", "_text"))
    found = F.arrays_zip(F.regexp_extract_all("_text", F.lit(line), F.lit(1)).alias("label"), F.regexp_extract_all("_text", F.lit(line), F.lit(2)).alias("value"))
    rows = page.select(key, (F.col("_page") + 1).alias("_page"), F.posexplode(found).alias("_at", "_m"))
    names = F.create_map(*(F.lit(x) for kv in fields.items() for x in kv))
    rows = rows.select(key, "_page", "_at", F.try_element_at(names, F.trim("_m.label")).alias("_field"), F.col("_m.value").try_cast("double").alias("_value")).where("_field is not null and _value is not null")
    blocks = group_ids(rows, [key], ["_page", "_at"], "_field")
    mine = lambda f, c: F.max(F.when(F.col("_field") == f, F.col(c)))
    columns = [x for f in fields.values() for x in (mine(f, "_value").alias(f), mine(f, "_page").alias(f"{f}_page"))]
    return blocks.groupBy(key, F.col("group_id").alias("block")).agg(F.min("_page").alias("source_page"), *columns)
