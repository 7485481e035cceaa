"""Schemas of tables and of nested documents."""

from __future__ import annotations

DEPLOYMENTS = "id bigint, model_name string, version string, accuracy double, endpoint_url string, deployed_at timestamp, is_active boolean, pipeline_id string"
PHASE_EVENTS = "pipeline_id string, seq bigint, phase string, status string, logs string, ts timestamp"
MODEL_RUNS = "run_id string, experiment string, run_name string, tags map<string, string>, metrics map<string, double>, artifact_path string"

PUSH_EVENT = (
    "ref string, after string, repository struct<html_url: string, full_name: string>, "
    "commits array<struct<id: string, added: array<string>, modified: array<string>, removed: array<string>>>, pusher struct<name: string>"
)
#: Bodies of requests: field, type, whether it must be there. Fixed values.
BODIES = {
    "repository": [("github_url", "string", True), ("github_token", "string", False), ("branch", "string", False), ("notebook_path", "string", False)],
    "predict": [("data", "array", True)],
    "load": [("model_name", "string", True), ("version", "string", True), ("run_id", "string", True)],
    "rollback": [("version", "string", True)],
}
#: ``source`` is a string or a list of strings; it is read as text and made one string by ``arrays.source_text``.
NOTEBOOK = (
    "nbformat int, nbformat_minor int, cells array<struct<cell_type: string, metadata: struct<tags: array<string>>, source: string, "
    "outputs: array<struct<output_type: string, text: string, data: map<string, string>>>>>"
)
#: Tags that a notebook must have, in the order they are reported; and the phases of a run in order. Fixed values.
REQUIRED_TAGS = ["mlops:config", "mlops:preprocessing", "mlops:training", "mlops:export"]
PHASE_ORDER = ["download", "validate", "execute", "register", "deploy"]
TERMINAL_PHASES = ["complete", "error", "shutdown"]
