"""Messages and payloads within the limits of their services."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.text import escape_html, escape_markdown, truncate

# The service's limits of an embed: title, description, a field's name and value, number of fields, all together.
TITLE, DESCRIPTION, NAME, VALUE, FIELDS, TOTAL = 256, 4096, 256, 1024, 25, 6000


def embed(title: Column, url: Column, description: Column, fields: dict[str, Column]) -> Column:
    """An embed as JSON text: every part clipped to its limit, empty fields left out, the description shortened
    until the whole stays within TOTAL."""
    t = truncate(title, TITLE)
    fs = F.slice(F.filter(F.array(*(F.struct(F.lit(n[:NAME]).alias("name"), truncate(v.cast("string"), VALUE).alias("value"), F.lit(True).alias("inline")) for n, v in fields.items())), lambda f: F.coalesce(f["value"], F.lit("")) != ""), 1, FIELDS)
    used = F.length(t) + F.aggregate(fs, F.lit(0), lambda a, f: a + F.length(f["name"]) + F.length(f["value"]))
    room = F.greatest(F.lit(0), F.least(F.lit(DESCRIPTION), F.lit(TOTAL) - used))
    return F.to_json(F.struct(t.alias("title"), url.alias("url"), F.substring(escape_markdown(description), F.lit(1), room).alias("description"), fs.alias("fields")))


def fit_lines(lines: Column, priorities: Column, most: int) -> Column:
    """The lines that fit into `most` UTF-16 units with line breaks, those of higher priority first, put together
    in their order; null lines are left out."""

    @F.pandas_udf(T.StringType())
    def fit(ls: pd.Series, ps: pd.Series) -> pd.Series:
        def one(a, b) -> str:
            if a is None:
                return ""
            size = lambda s: len(s.encode("utf-16-le")) // 2
            keep, left = set(), most + 1
            for i in sorted((i for i, x in enumerate(a) if x is not None), key=lambda i: (-b[i], i)):
                if size(a[i]) + 1 <= left:
                    keep.add(i)
                    left -= size(a[i]) + 1
            return "\n".join(a[i] for i in sorted(keep))

        return pd.Series([one(a, b) for a, b in zip(ls, ps, strict=True)], dtype=object)

    return fit(lines, priorities)


def html_message(title: Column, url: Column, facts: list[tuple[int, Column]], most: int = 4096) -> Column:
    """A message with a linked headline and as many facts as fit, the weightier first."""
    head = F.concat(F.lit('<a href="'), F.replace(escape_html(url), F.lit('"'), F.lit("&quot;")), F.lit('">'), escape_html(truncate(title, 200)), F.lit("</a>"))
    return fit_lines(F.array(head, *(escape_html(c.cast("string")) for _, c in facts)), F.array(F.lit(1 << 30), *(F.lit(p) for p, _ in facts)), most)
