"""Path functions on columns; only normalisation of '..' needs Python, and only where a path holds dots."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def joined(folder: str, name: str) -> str:
    """folder/name without empty, '.' and resolvable '..' parts."""
    path = posixpath.normpath("/".join(x for x in (folder, name) if x)) if folder or name else "."
    return path[1:] if path.startswith("//") else path


@F.pandas_udf(StringType())
def join_path(folder: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([None if n is None else joined(f or "", n) for f, n in zip(folder, name)])


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def dirname(path: Column) -> Column:
    found = F.regexp_extract(path, r"(?s)\A(.*[^/])/+[^/]+/*\z", 1)
    return F.when(found != "", found).when(path.startswith("/"), F.lit("/")).otherwise(F.lit("."))


def extname(path: Column) -> Column:
    """With its dot; a name that only begins with a dot has none."""
    return F.regexp_extract(basename(path), r"(?s)[^.].*?(\.[^.]*)\z", 1)


def stem(path: Column) -> Column:
    base = basename(path)
    return F.substring(base, F.lit(1), F.length(base) - F.length(extname(path)))
