"""Registry of public photo sets.  There is no network here, so nothing is fetched."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


# Name, address, number of images, size and license of public photo sets.
KNOWN = [
    ("brighton_beach", "https://github.com/OpenDroneMap/drone_dataset_brighton_beach", 18, "~80 MB", "BSD-2-Clause"),
    ("aukerman", "https://github.com/OpenDroneMap/odm_data_aukerman", 77, "~520 MB", "CC0-1.0"),
    ("toledo", "https://github.com/OpenDroneMap/odm_data_toledo", 87, "~430 MB", "see repo"),
    ("pacifica", "https://github.com/OpenDroneMap/odm_data_pacifica", 12, "~90 MB", "see license.html"),
]


def registry(spark: SparkSession, entries: list[tuple[str, str, str]]) -> DataFrame:
    """name, url and note of each entry."""
    return spark.createDataFrame(entries, "name string, url string, note string")


def locate(entries: list[tuple[str, str, str]], name: str, root: str) -> str:
    """The folder of a set that is there already; unknown names are key errors."""
    if name not in {e[0] for e in entries}:
        raise KeyError(name)
    path = os.path.join(root, name)
    if not os.path.isdir(path):
        raise NotImplementedError("fetching needs a network")
    return path
