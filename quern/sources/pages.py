"""Pages as an encyclopedia's interface gives them: JSON with a page's title, its plain text and its links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSWER = "struct<query:struct<pages:map<string,struct<title:string,extract:string,links:array<struct<title:string>>>>>>"


def first_page(answer: Column) -> Column:
    """(title, extract, links) of the first page of an answer, links as an array of titles; null if there is none."""
    page = F.get(F.map_values(F.from_json(answer, ANSWER)["query"]["pages"]), F.lit(0))
    links = F.coalesce(F.transform(page["links"], lambda x: x["title"]), F.array().cast("array<string>"))
    return F.when(page.isNotNull(), F.struct(page["title"].alias("title"), page["extract"].alias("extract"), links.alias("links")))


def url_with(base: str, **fields: str | Column) -> Column:
    """A URL with the fields as its query, in form encoding."""
    parts = [F.concat(F.lit(k + "="), F.url_encode(v if isinstance(v, Column) else F.lit(v))) for k, v in fields.items()]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *parts))
