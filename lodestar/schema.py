"""Schemas of the tables; SCHEMA_VERSION is part of a stored snapshot's path."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 2


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "array<string>": T.ArrayType(T.StringType())}


def _schema(text: str) -> T.StructType:
    """Column names and types; needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in text.split(", "))])


FILES = _schema("id long, path string, name string, folder string, ext string, kind string, is_dir boolean, size long, mtime double, seen long, content_mtime double, taken double")
DOCS = _schema("id long, name string, folder string, content string, extra string")
POSTINGS = _schema("term string, field string, id long, dl long, tf long")
VOCAB = _schema("word string, src int")
RELATED = _schema("word string, other string, score double")
CLICKS = _schema("term string, path string, ts double")
SEARCHES = _schema("query string, ts double")
RAW_FILES = _schema("path string, is_dir boolean, size long, mtime double, content binary")
EVENTS = _schema("kind string, path string, path2 string, query string, ts double, seq long")
PLACES = _schema("lat double, lon double, city string, state string, code string")
COUNTRIES = _schema("code string, name string")
APPS = _schema("id string, name string, exec_line string, icon string, mime_types array<string>, path string, dir_rank int")
