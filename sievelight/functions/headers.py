"""Mail headers over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelight.functions.text import let, strip

ADDRESS = r"[\p{L}\p{N}_.+\-]+@[\p{L}\p{N}_\-]+(?:\.[\p{L}\p{N}_\-]+)+"


def parse_headers(raw: Column) -> Column:
    """array<struct<name,value>> in order, repeated fields kept; folded lines joined; ends at the first empty line."""
    text = F.replace(F.coalesce(raw, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    block = F.get(F.split(text, "\n\n", 2), F.lit(0))
    lines = F.split(F.regexp_replace(block, r"\n[ \t]+", " "), "\n")
    fields = F.filter(lines, lambda line: line.rlike(r"^[^\s:][^:]*:"))
    return F.transform(fields, lambda line: F.struct(strip(F.substring_index(line, ":", 1)).alias("name"), strip(F.regexp_replace(line, r"^[^:]*:", "")).alias("value")))


def get_all(headers: Column, name: str) -> Column:
    return F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), lambda h: h["value"])


def get_first(headers: Column, name: str) -> Column:
    return F.get(get_all(headers, name), F.lit(0))


def first_address(value: Column) -> Column:

    def of(v: Column) -> Column:
        bracketed = F.regexp_extract(v, "<([^>]+)>", 1)
        return F.nullif(F.when(bracketed != "", strip(bracketed)).otherwise(F.regexp_extract(v, ADDRESS, 0)), F.lit(""))

    return let(value, of)


def display_name(value: Column) -> Column:
    name = F.regexp_replace(strip(F.substring_index(value, "<", 1)), '^"+|"+$', "")
    return F.nullif(F.when(F.instr(value, "<") > 1, name), F.lit(""))


def auth_result(top: Column, method: str) -> Column:
    """The first result of one method in the top-most Authentication-Results; 'none' if it is not named."""
    found = F.lower(F.regexp_extract(top, rf"(?i)\b{method}\s*=\s*([a-z]+)", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("none"))
