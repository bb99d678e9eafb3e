"""Landed API responses: envelopes, GraphQL and XML payloads, paging."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranged import windowed_rows

# Keys under which an envelope holds its rows.
ROW_KEYS = ["data", "results", "items", "records"]


def _items(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def unwrap_envelope(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """A list is the rows; else the first row key holding a list; else the object itself. Rows stay JSON texts."""
    x = F.trim(F.col(payload))
    chain = F.when(x.startswith("["), _items(x))
    for key in ROW_KEYS:
        inner = F.get_json_object(x, f"$.{key}")
        chain = chain.when(inner.startswith("["), _items(inner))
    return df.select(*keep, F.explode(chain.otherwise(F.array(x))).alias("record"))


def flatten_graphql(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Lists under ``data`` are spread, objects become one row, ``errors`` gives an error row."""
    x = F.col(payload)
    errors = F.get_json_object(x, "$.errors")
    parts = F.map_values(F.from_json(F.get_json_object(x, "$.data"), "map<string,string>"))
    rows = F.flatten(F.transform(parts, lambda v: F.when(v.startswith("["), _items(v)).when(
        v.startswith("{"), F.array(v)).otherwise(F.array().cast("array<string>"))))
    out = F.when(errors.isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("record"), errors.alias("error")))).otherwise(
        F.transform(rows, lambda r: F.struct(r.alias("record"), F.lit(None).cast("string").alias("error"))))
    return df.select(*keep, F.explode(out).alias("r")).select(*keep, "r.record", "r.error")


def xml_leaves(df: DataFrame, payload: str, key: str) -> DataFrame:
    """(key, tag, text, attributes) of every element with text; payloads stream through in batches."""
    kind = df.schema[key].dataType.simpleString()

    def parse(batches):
        for pdf in batches:
            rows = []
            for k, doc in zip(pdf[key], pdf[payload]):
                for e in ElementTree.fromstring(doc).iter():
                    if e.text and e.text.strip():
                        rows.append((k, e.tag, e.text.strip(), dict(e.attrib)))
            yield pd.DataFrame(rows, columns=[key, "tag", "text", "attributes"])

    return df.select(key, payload).mapInPandas(parse, f"`{key}` {kind}, tag string, text string, attributes map<string,string>")


def next_page(payload: Column, kind: str, url: Column, key: str | None = None, param: str | None = None,
              page: Column | None = None, size: Column | None = None) -> Column:
    """Address of the next page by cursor, link or offset; null on the last page."""
    base = F.substring_index(url, "?", 1)
    if kind == "cursor":
        cursor = F.get_json_object(payload, f"$.{key or 'next_cursor'}")
        return F.when(cursor.isNotNull() & (cursor != ""), F.concat(base, F.lit(f"?{param or 'cursor'}="), cursor))
    if kind == "link":
        return F.get_json_object(payload, f"$.{key or 'next'}")
    if kind == "offset":
        total = F.coalesce(F.get_json_object(payload, f"$.{key or 'total'}").try_cast("bigint"), F.lit(0))
        at, width = page if page is not None else F.lit(1), size if size is not None else F.lit(100)
        return F.when(at * width < total, F.concat(base, F.lit("?page="), at + 1, F.lit("&size="), width))
    raise ValueError(f"unknown paging {kind!r}")


def page_gaps(df: DataFrame, source: str, page: str) -> DataFrame:
    """Places where landed pages of a source skip a number."""
    rows = windowed_rows(df.select(source, page).distinct(), [source], [page], lambda w: {"before": F.lag(page).over(w)}, before=1)
    return rows.filter(F.col(page) - F.col("before") > 1).select(
        source, (F.col("before") + 1).alias("missing_from"), (F.col(page) - 1).alias("missing_to"))
