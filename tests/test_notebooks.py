import json

from millrace.operators import notebooks
from millrace.schemas import REQUIRED_TAGS


def cell(tag=None, source="", kind="code", outputs=()):
    return {"cell_type": kind, "metadata": {"tags": [tag]} if tag else {}, "source": source, "outputs": list(outputs)}


def parsed(spark, *cells_lists):
    rows = [(n, json.dumps({"nbformat": 4, "cells": c} if c is not None else {"nbformat": 4})) for n, c in enumerate(cells_lists)]
    df = notebooks.parse_notebooks(spark.createDataFrame(rows, "id int, raw string"))
    return df.select("id", "notebook.cells")


def test_required_tags(spark):
    full = [cell(t) for t in REQUIRED_TAGS]
    got = notebooks.validate(parsed(spark, full, full[1:], [], None)).orderBy("id").collect()
    assert [r["is_valid"] for r in got] == [True, False, False, False]
    assert got[0]["error"] is None and REQUIRED_TAGS[0] in got[1]["error"] and all(t in got[2]["error"] for t in REQUIRED_TAGS)


def test_config(spark):
    config = lambda source: [cell("mlops:config", source)]
    got = notebooks.config_of(parsed(
        spark, config(['MODEL_NAME = "iris"\n', 'VERSION = "1"']), config("MODEL_NAME='m'\nVERSION='2'"), config('VERSION = "3"'), [cell("mlops:training")],
        config('["not json'), config('BASE_MODEL_NAME = "x"'),
    )).orderBy("id").collect()
    assert [(r["model_name"], r["version"]) for r in got] == [("iris", "1"), ("m", "2"), ("default-model", "3"), (None, None), ("default-model", "1"), ("x", "1")]


def test_cell_logs(spark):
    out = [{"text": "a"}, {"data": {"text/plain": "b"}}]
    cells = [cell(kind="markdown"), cell(outputs=out), cell(), cell(outputs=[{"text": "é" * 3000}])] + [cell(outputs=[{"text": "x"}])] * 30
    got = notebooks.cell_logs(parsed(spark, cells)).first()["logs"]
    assert got[0]["cell"] == 1 and got[0]["output"] == "ab" and len(got[1]["output"]) == 2000 and len(got) == 20
