"""The archive's place from a JSON configuration file."""

from __future__ import annotations

import os

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Stands for the user's documents folder.
DOCUMENTS = "__USER_DOCUMENTS__"


def location_of(text: Column, documents: str) -> Column:
    """``currentSaveLocation`` of a configuration's text, with the first macro filled in; null where it names none or can't be parsed."""
    named = F.get_json_object(text, "$.currentSaveLocation")
    at = F.instr(named, DOCUMENTS)
    return F.when(at > 0, F.concat(named.substr(F.lit(1), at - 1), F.lit(documents), named.substr(at + len(DOCUMENTS), F.length(named)))).otherwise(named)


def save_location(spark: SparkSession, path: str, documents: str | None = None) -> str:
    """``currentSaveLocation`` of a configuration file."""
    folder = documents or os.path.join(os.path.expanduser("~"), "Documents")
    found = spark.read.text(path, wholetext=True).select(location_of(F.col("value"), folder).alias("at")).first()
    if found is None or found["at"] is None:
        raise ValueError(f"{path} names no currentSaveLocation")
    return found["at"]
