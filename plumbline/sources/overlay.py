"""Settings that hold for a file: those of its folder over those of the folders above, for all files at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dir_parts
from .config import parse_settings

#: Layers are broadcast up to so many characters of settings, which are counted first.
BROADCAST_CHARS = 8 << 20


def folder_of(path: Column) -> Column:
    """The folder of a path, its parts joined by ``/``; empty at the top."""
    return F.array_join(dir_parts(path), "/")


def layers(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """folder, is_root, settings (a map) of every settings file; of several lines of a key the last one counts.

    A null text is an empty file.  Of several files of one folder all lines count, in the order of the paths.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [parse_settings(t or "") for t in pdf["text"]]
            yield pd.DataFrame({"folder": pdf["folder"], "path": pdf["path"], "is_root": [root for _, root in found], "settings": [{k: v for k, v, _ in rows} for rows, _ in found]})

    rows = files.select(folder_of(F.col(path)).alias("folder"), F.col(path).alias("path"), F.col(text).alias("text"))
    each = rows.mapInPandas(parse, "folder string, path string, is_root boolean, settings map<string,string>")
    all_ = F.transform(F.array_sort(F.collect_list(F.struct("path", F.map_entries("settings").alias("entries")))), lambda x: F.map_from_entries(x["entries"]))
    return each.groupBy("folder").agg(F.max("is_root").alias("is_root"), merged(all_).alias("settings"))


def merged(maps: Column) -> Column:
    """One map of several, where the later ones win."""
    over = lambda below, above: F.map_concat(F.map_filter(below, lambda k, v: ~F.map_contains_key(above, k)), above)
    return F.aggregate(maps, F.create_map().cast("map<string,string>"), over)


def effective(files: DataFrame, layered: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ``settings``, a map: the layers (folder, is_root, settings) on the way up, the nearest winning.

    The way up ends at the first folder that says it is the root.  It is walked once a folder, not once a file: each folder meets
    those of its ancestors that have a layer.  A file without any layer has an empty map.
    """
    keyed = files.withColumn("_folder", folder_of(F.col(path)))
    parts = F.split("_folder", "/", -1)
    depth = F.when(F.col("_folder") == "", 0).otherwise(F.size(parts))
    above = F.transform(F.sequence(F.lit(0), depth), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder")))
    ways = keyed.select("_folder").distinct().filter("_folder IS NOT NULL").select("_folder", F.explode(above).alias("a")).select("_folder", "a.*")
    known = layered.select("folder", "is_root", "settings")
    chars = known.agg(F.sum(F.octet_length("folder") + F.octet_length(F.to_json("settings")))).first()[0] or 0
    met = ways.join(F.broadcast(known) if chars <= BROADCAST_CHARS else known, "folder")
    each = met.groupBy("_folder").agg(F.array_sort(F.collect_list(F.struct("depth", "is_root", F.map_entries("settings").alias("entries")))).alias("l"))
    root = F.coalesce(F.array_max(F.transform(F.filter("l", lambda x: x["is_root"]), lambda x: x["depth"])), F.lit(0))
    maps = F.transform(F.filter("l", lambda x: x["depth"] >= root), lambda x: F.map_from_entries(x["entries"]))
    per_folder = each.select("_folder", merged(maps).alias("settings"))
    return keyed.join(per_folder, "_folder", "left").withColumn("settings", F.coalesce("settings", F.create_map().cast("map<string,string>"))).drop("_folder")
