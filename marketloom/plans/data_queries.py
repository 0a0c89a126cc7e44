"""Queries of the core data-processing operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketloom.operators import nested, timestamps, units
from marketloom.tables import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.money_in_cents(load(spark, d, "raw_listings"), load(spark, d, "fx_rates"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.instants(load(spark, d, "deal_items"), load(spark, d, "collectors"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.page_links(load(spark, d, "hardwareswap_pages"), load(spark, d, "newegg_pages"))


_ITEMS = """
    items(page_id, row_path, parent_path, ordinal, o) AS (
      SELECT page_id, '/MainItem', NULL::VARCHAR, NULL::INTEGER, json_extract(body, '$.MainItem') FROM newegg_pages WHERE json_valid(body) AND json_type(body, '$.MainItem') = 'OBJECT'
      UNION ALL
      SELECT page_id, row_path || '/ParentItem' || CASE WHEN json_type(p) = 'ARRAY' THEN '/' || i ELSE '' END, row_path, CASE WHEN json_type(p) = 'ARRAY' THEN i END::INTEGER, CASE WHEN json_type(p) = 'ARRAY' THEN json_extract(p, '$[' || i || ']') ELSE p END
      FROM (SELECT *, json_extract(o, '$.ParentItem') AS p FROM items) q, LATERAL (SELECT unnest(range(CASE WHEN json_type(p) = 'ARRAY' THEN json_array_length(p)::BIGINT WHEN json_type(p) = 'OBJECT' THEN 1 ELSE 0 END)) AS i) u
      WHERE json_type(p) = 'OBJECT' OR json_type(json_extract(p, '$[' || i || ']')) = 'OBJECT')"""
_POSTS = """
    lists(page_id, path, parent_path, l) AS (
      SELECT page_id, CASE WHEN json_type(body) = 'ARRAY' THEN '/' || i ELSE '' END, NULL::VARCHAR, CASE WHEN json_type(body) = 'ARRAY' THEN json_extract(body, '$[' || i || ']') ELSE body::JSON END
      FROM (SELECT page_id, body FROM hardwareswap_pages WHERE json_valid(body)) b, LATERAL (SELECT unnest(range(CASE WHEN json_type(body) = 'ARRAY' THEN json_array_length(body)::BIGINT ELSE 1 END)) AS i) u
      UNION ALL
      SELECT page_id, path || '/data/children/' || i || '/data/replies', path || '/data/children/' || i, json_extract(c, '$[' || i || '].data.replies')
      FROM (SELECT *, json_extract(l, '$.data.children') AS c FROM lists WHERE json_type(l) = 'OBJECT' AND json_extract_string(l, '$.kind') = 'Listing') q,
        LATERAL (SELECT unnest(range(CASE WHEN json_type(c) = 'ARRAY' THEN json_array_length(c)::BIGINT ELSE 0 END)) AS i) u
      WHERE json_type(json_extract(c, '$[' || i || '].data.replies')) = 'OBJECT')"""


def p4_items(spark: SparkSession, d: str) -> DataFrame:
    """The item table of the product pages."""
    rows = nested.related_tables(load(spark, d, "newegg_pages"), nested.PRODUCT)
    return nested.pivoted(rows, "item", {"item": "Item", "title": "Description.Title", "brand_id": "ItemManufactory.BrandId", "final_price": "FinalPrice", "stock": "Stock"})


def p4_warranties(spark: SparkSession, d: str) -> DataFrame:
    """The warranty table of the product pages."""
    rows = nested.related_tables(load(spark, d, "newegg_pages"), nested.PRODUCT)
    return nested.pivoted(rows, "warranty", {"warranty_id": "WarrantyID", "warranty_name": "WarrantyName"})


def p4_children(spark: SparkSession, d: str) -> DataFrame:
    """The table of posts and comments of the forum pages."""
    rows = nested.related_tables(load(spark, d, "hardwareswap_pages"), nested.FORUM)
    return nested.pivoted(rows, "child", {"kind": "kind", "name": "data.name", "author": "data.author", "title": "data.title", "body": "data.body"})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p3_found, p4_found, p4_items, p4_warranties, p4_children)}
SQL: dict[str, str] = {
    "p4_found": f"""
        WITH RECURSIVE {_ITEMS}, {_POSTS},
        c AS (SELECT page_id, path, parent_path, json_extract(l, '$.data.children') AS c FROM lists WHERE json_type(l) = 'OBJECT' AND json_extract_string(l, '$.kind') = 'Listing'),
        x AS (SELECT page_id, path || '/data/children/' || i AS row_path, parent_path, json_extract(c, '$[' || i || ']') AS x FROM (SELECT *, unnest(range(json_array_length(c)::BIGINT)) AS i FROM c WHERE json_type(c) = 'ARRAY')),
        child AS (SELECT page_id, row_path, parent_path, json_extract_string(x, '$.kind') AS kind, json_extract_string(x, '$.data.name') AS name, json_extract(x, '$.data') AS o FROM x WHERE json_type(x) = 'OBJECT'),
        post(page_id, above, name, o) AS (
          SELECT page_id, NULL::VARCHAR, name, o FROM child WHERE kind NOT IN ('t1', 'more') AND name IS NOT NULL
          UNION ALL
          SELECT page_id, name, json_extract_string(z, '$.name'), z FROM (
            SELECT page_id, name, unnest(json_extract(o, '$.crosspost_parent_list[*]')) AS z FROM post WHERE json_type(o, '$.crosspost_parent_list') = 'ARRAY') WHERE json_type(z) = 'OBJECT' AND json_extract_string(z, '$.name') IS NOT NULL),
        items2 AS (SELECT page_id, json_extract_string(o, '$.Item') AS item, o FROM items WHERE json_extract_string(o, '$.Item') IS NOT NULL),
        links AS (
          SELECT a.page_id, CASE WHEN a.parent_path IS NULL THEN a.page_id::VARCHAR ELSE b.name END AS parent_key, a.kind AS child_kind, a.name AS child_key
            FROM child a LEFT JOIN child b ON a.page_id = b.page_id AND a.parent_path = b.row_path
          UNION ALL SELECT page_id, above, 'crosspost', name FROM post WHERE above IS NOT NULL
          UNION ALL SELECT page_id, name, 'image', json_extract_string(i, '$.id') FROM (SELECT page_id, name, unnest(json_extract(o, '$.preview.images[*]')) AS i FROM post WHERE json_type(o, '$.preview.images') = 'ARRAY') WHERE json_type(i) = 'OBJECT'
          UNION ALL SELECT page_id, name, 'media', unnest(json_keys(o, '$.media_metadata')) FROM post WHERE json_type(o, '$.media_metadata') = 'OBJECT'
          UNION ALL SELECT page_id, item, 'warranty', json_extract_string(o, '$.Warranty.WarrantyID') FROM items2 WHERE json_type(o, '$.Warranty') = 'OBJECT'
          UNION ALL SELECT page_id, item, 'warranty', json_extract_string(w, '$.WarrantyID') FROM (SELECT page_id, item, unnest(json_extract(o, '$.Warranty[*]')) AS w FROM items2 WHERE json_type(o, '$.Warranty') = 'ARRAY') WHERE json_type(w) = 'OBJECT'
          UNION ALL SELECT page_id, item, 'image_path', json_extract_string(w, '$.Size') FROM (SELECT page_id, item, unnest(json_extract(o, '$.Image.ImagePathPattern[*]')) AS w FROM items2 WHERE json_type(o, '$.Image.ImagePathPattern') = 'ARRAY') WHERE json_type(w) = 'OBJECT')
        SELECT DISTINCT * FROM links WHERE parent_key IS NOT NULL AND child_kind IS NOT NULL AND child_key IS NOT NULL""",
    "p4_items": f"""
        WITH RECURSIVE {_ITEMS}
        SELECT page_id, row_path, parent_path, ordinal, json_extract_string(o, '$.Item') AS item, json_extract_string(o, '$.Description.Title') AS title, json_extract_string(o, '$.ItemManufactory.BrandId') AS brand_id,
          json_extract_string(o, '$.FinalPrice') AS final_price, json_extract_string(o, '$.Stock') AS stock FROM items""",
    "p4_warranties": f"""
        WITH RECURSIVE {_ITEMS},
        w AS (SELECT page_id, row_path AS parent_path, json_extract(o, '$.Warranty') AS w FROM items),
        one AS (SELECT page_id, parent_path || '/Warranty' AS row_path, parent_path, NULL::INTEGER AS ordinal, w AS x FROM w WHERE json_type(w) = 'OBJECT'
          UNION ALL SELECT page_id, parent_path || '/Warranty/' || i, parent_path, i::INTEGER, json_extract(w, '$[' || i || ']') FROM (SELECT *, unnest(range(json_array_length(w)::BIGINT)) AS i FROM w WHERE json_type(w) = 'ARRAY'))
        SELECT page_id, row_path, parent_path, ordinal, json_extract_string(x, '$.WarrantyID') AS warranty_id, json_extract_string(x, '$.WarrantyName') AS warranty_name FROM one WHERE json_type(x) = 'OBJECT'""",
    "p4_children": f"""
        WITH RECURSIVE {_POSTS},
        c AS (SELECT page_id, path, parent_path, json_extract(l, '$.data.children') AS c FROM lists WHERE json_type(l) = 'OBJECT' AND json_extract_string(l, '$.kind') = 'Listing'),
        x AS (SELECT page_id, path || '/data/children/' || i AS row_path, parent_path, i::INTEGER AS ordinal, json_extract(c, '$[' || i || ']') AS x FROM (SELECT *, unnest(range(json_array_length(c)::BIGINT)) AS i FROM c WHERE json_type(c) = 'ARRAY'))
        SELECT page_id, row_path, parent_path, ordinal, json_extract_string(x, '$.kind') AS kind, json_extract_string(x, '$.data.name') AS name, json_extract_string(x, '$.data.author') AS author,
          json_extract_string(x, '$.data.title') AS title, json_extract_string(x, '$.data.body') AS body FROM x WHERE json_type(x) = 'OBJECT'""",
}
