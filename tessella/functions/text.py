"""Parsing and formatting of headers, options, paths and parameters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_pairs(text: Column, between: str = ",", inside: str = "=") -> Column:
    """map of `a=1, b=2`: parts are trimmed, and cut at the first separator."""
    parts = F.filter(F.transform(F.split(text, between), lambda p: F.trim(p)), lambda p: p.contains(inside))
    entries = F.transform(
        parts,
        lambda p: F.struct(F.trim(F.substring_index(p, inside, 1)).alias("k"), F.trim(F.substr(p, F.instr(p, inside) + 1)).alias("v")),
    )
    return F.map_from_entries(entries)


def none_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit("None"))


def parse_list(text: Column) -> Column:
    """Comma-separated list; `None` is null."""
    return F.split(none_to_null(text), ",")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Extension with its dot, or the empty string."""
    return F.regexp_extract(basename(path), r"(?<=.)(\.[^.]*)$", 1)


def allowed_extension(path: Column, extensions: list[str]) -> Column:
    return F.lower(suffix(path)).isin([f".{e.lower().lstrip('.')}" for e in extensions])


def cache_key(namespace: Column, key: Column) -> Column:
    return F.concat(namespace, F.length(namespace).cast("string"), key)


def database_uri(kind: str, **part: str) -> str:
    if kind == "mysql":
        return "mysql+pymysql://{user}:{password}@{host}:{port}/{name}".format(**part)
    if kind == "sqlite":
        return "sqlite:///{path}".format(**part)
    raise ValueError(f"no database of kind {kind}")


def address(host: Column, port: Column, https: Column) -> Column:
    """host:port with the scheme's usual port where none is given."""
    usual = F.when(https, F.lit("443")).otherwise(F.lit("80"))
    return F.concat(F.lower(host), F.lit(":"), F.coalesce(F.nullif(port.cast("string"), F.lit("")), usual))


def scores_of_line(line: Column) -> tuple[Column, Column]:
    """precision and recall of a log line, null where it has none."""
    number = lambda name: F.regexp_extract(line, rf"{name}: ([0-9.]+)", 1).try_cast("double")
    return number("precision"), number("recall")
