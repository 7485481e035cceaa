"""Notebooks: tags, configuration, outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import all_tags, cells_with_tag, missing, output_text, source_text
from ..functions.crypto import from_base64
from ..functions.strings import assignment
from ..schemas import NOTEBOOK, REQUIRED_TAGS

#: Cell logs kept of a run, and characters of each.
LOG_CELLS, LOG_CHARS = 20, 2000


def read_notebooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw) of notebook files, a row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def decode_contents(rows: DataFrame, column: str = "content") -> DataFrame:
    """``raw`` from base64 ``column``, as a contents service sends files."""
    return rows.withColumn("raw", from_base64(F.col(column)))


def parse_notebooks(raw: DataFrame, column: str = "raw") -> DataFrame:
    """``raw`` (JSON text) with ``notebook``, null if the text isn't JSON."""
    return raw.withColumn("notebook", F.when(F.try_parse_json(column).isNotNull(), F.from_json(column, NOTEBOOK)))


def check_notebooks(raw: DataFrame, column: str = "raw") -> DataFrame:
    """``raw`` with cells, missing, is_valid and error; a text that isn't JSON, or has no cells, lacks them all."""
    parsed = parse_notebooks(raw, column)
    return validate(parsed.withColumn("cells", F.col("notebook.cells"))).drop("notebook")


def nest_cells(cells: DataFrame) -> DataFrame:
    """One row a notebook from rows of cells, in order."""
    cell = F.struct(
        "cell", "cell_type", F.struct(F.when(F.col("tag").isNotNull(), F.array("tag")).alias("tags")).alias("metadata"), "source",
    )
    return cells.groupBy("notebook_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))


def validate(notebooks: DataFrame, cells: str = "cells", required: list[str] = REQUIRED_TAGS) -> DataFrame:
    """``missing`` (required tags that no cell has), ``is_valid`` and ``error``."""
    lacks = missing(required, all_tags(F.col(cells)))
    out = notebooks.withColumn("missing", lacks)
    text = F.concat(F.lit("Missing required tags: "), F.array_join("missing", ", "))
    return out.withColumns({"is_valid": F.size("missing") == 0, "error": F.when(F.size("missing") > 0, text)})


def config_of(notebooks: DataFrame, cells: str = "cells") -> DataFrame:
    """``model_name`` and ``version`` of the first configuration cell; nulls if there is none."""
    first = F.get(cells_with_tag(F.col(cells), "mlops:config"), F.lit(0))
    source = source_text(first["source"])
    return notebooks.withColumns({
        "model_name": F.when(first.isNotNull(), assignment(F.coalesce(source, F.lit("")), "MODEL_NAME", "default-model")),
        "version": F.when(first.isNotNull(), assignment(F.coalesce(source, F.lit("")), "VERSION", "1")),
    })


def cell_logs(notebooks: DataFrame, cells: str = "cells") -> DataFrame:
    """``logs``: (cell, output) of code cells with output, numbered among all cells; the first LOG_CELLS."""
    numbered = F.transform(F.coalesce(F.col(cells), F.array()), lambda c, i: F.struct(i.alias("cell"), c["cell_type"].alias("type"), output_text(c["outputs"], LOG_CHARS).alias("output")))
    kept = F.filter(numbered, lambda c: (c["type"] == "code") & (c["output"] != ""))
    return notebooks.withColumn("logs", F.slice(F.transform(kept, lambda c: F.struct(c["cell"].alias("cell"), c["output"].alias("output"))), 1, LOG_CELLS))
