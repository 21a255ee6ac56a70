"""Which applications open a type: first folder wins, exact types before their parents."""

from __future__ import annotations

import re
import shlex
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def offered_apps(entries: DataFrame, desktops: Sequence[str] = (), installed: Sequence[str] | None = None) -> DataFrame:
    """Entries that are offered, one per id: the folder of least dir_rank wins, hidden ones don't shadow.

    entries has id, name, mime_types, dir_rank and optional flags no_display, hidden, terminal and lists
    only_show_in, not_show_in. With a list of installed commands, entries whose try_exec isn't among them go.
    """
    out = entries.where(F.coalesce("name", F.lit("")) != "")
    for flag in ("no_display", "hidden", "terminal"):
        if flag in entries.columns:
            out = out.where(~F.coalesce(flag, F.lit(False)))
    here = F.array(*[F.lit(d) for d in desktops])
    if desktops and "only_show_in" in entries.columns:
        out = out.where((F.coalesce(F.size("only_show_in"), F.lit(0)) <= 0) | F.arrays_overlap("only_show_in", here))
    if desktops and "not_show_in" in entries.columns:
        out = out.where(~F.coalesce(F.arrays_overlap("not_show_in", here), F.lit(False)))
    if installed is not None and "try_exec" in entries.columns:
        out = out.where(F.col("try_exec").isNull() | F.col("try_exec").isin(list(installed)))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dir_rank"))
    return out.withColumn("__r", rank).where("__r = 1").drop("__r")


def apps_for_mime(apps: DataFrame, mimes: Sequence[str]) -> DataFrame:
    """(id, name, position) of apps that take one of the types, best first: the earliest type, then the name."""
    wanted = apps.sparkSession.createDataFrame([(m, k) for k, m in enumerate(mimes)], "mime string, position int")
    handled = apps.select("id", "name", F.explode("mime_types").alias("mime")).join(F.broadcast(wanted), "mime")
    return handled.groupBy("id", "name").agg(F.min("position").alias("position")).orderBy("position", F.lower("name"), "id")


def named_like(apps: DataFrame, needle: str) -> DataFrame:
    """Apps whose name holds the text, in any case; all for an empty one."""
    return apps.where(F.contains(F.lower("name"), F.lit(needle.strip().lower())))


def command_line(exec_line: str, target: str, name: str = "", path: str = "") -> list[str]:
    """Arguments that open target with an application's command: its field codes filled in, target at the end if it
    has none for files. Unknown codes are empty, arguments that were nothing but codes without a value go."""
    filled = dict.fromkeys("fF", target) | dict.fromkeys("uU", f"file://{quote(target, safe='/')}") | {"c": name, "k": path, "%": "%"}
    asked = [(part, set(re.findall("%(.)", part))) for part in shlex.split(exec_line) if part != "%i"]
    made = [(re.sub("%(.)", lambda m: filled.get(m[1], ""), part), codes) for part, codes in asked]
    return [part for part, codes in made if part or not codes] + [target] * all(codes.isdisjoint("fFuU") for _, codes in asked)
