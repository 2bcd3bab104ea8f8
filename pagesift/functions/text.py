"""Column functions on texts, urls and user agents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_ten(values: Column) -> Column:
    return F.slice(values, 1, 10)


def content_length(text: Column) -> Column:
    return F.char_length(text).cast("long")


def is_web_url(url: Column) -> Column:
    """Whether a trimmed url starts with http:// or https://."""
    return F.trim(url).startswith("http://") | F.trim(url).startswith("https://")


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^\w+://([^/?#]*)", 1)


def value_mark(key: Column, value: Column, many: Column) -> Column:
    """``page_error``, ``list``, ``bad`` (the value speaks of an error) or ``good``."""
    return F.when(key == "error", "page_error").when(many, "list").when(F.lower(value).contains("error"), "bad").otherwise("good")


def agent_flags(agent: Column) -> dict[str, Column]:
    """What a user agent says it is; the flags overlap."""
    has = agent.contains
    return {
        "is_chrome": has("Chrome") & has("Safari"),
        "is_firefox": has("Firefox"),
        "is_safari": has("Safari") & ~has("Chrome"),
        "is_edge": has("Edg"),
        "is_mobile": has("Mobile") | has("iPhone") | has("Android"),
    }


def chrome_version(agent: Column) -> Column:
    """The major version that a Chrome or Edge agent names, else null."""
    flags = agent_flags(agent)
    found = F.nullif(F.regexp_extract(agent, r"Chrome/(\d+)", 1), F.lit(""))
    return F.when(flags["is_chrome"] | flags["is_edge"], found).cast("int")
