"""Schemas of the stored tables."""

from __future__ import annotations

#: Tables and their columns.
TABLES = {
    "projects": "project_id long, name string, description string, created_at timestamp",
    "repo_snapshots": "snapshot_id long, project_id long, commit_sha string, branch string, created_at timestamp",
    "code_chunks": "chunk_id long, snapshot_id long, kind string, lang string, content string, meta string, content_hash string, created_at timestamp",
    "embedding_models": "model_id string, provider_type string, dimension int, config_jsonb string, created_at timestamp",
    "chunk_embeddings": "chunk_id long, model_id string, snapshot_id long, embedding array<float>, updated_at timestamp",
    "agent_runs": "run_id string, repo_url string, ref string, task_description string, status string, created_at timestamp, updated_at timestamp",
    "agent_steps": "step_id string, run_id string, seq long, step_name string, input_json string, output_json string, ok boolean, error_msg string, created_at timestamp",
    "patches": "patch_id string, run_id string, seq long, file_path string, unified_diff string, status string, error_msg string, created_at timestamp",
    "metrics": "metric_id long, run_id string, seq long, key string, value_json string, created_at timestamp",
}
#: Fields of a chunk's metadata.
META = "file string, evidence_type string, risk_tags array<string>, constraint_tags array<string>, api_tags array<string>, symbol string, signature string, calls array<string>, origin_function string, degraded boolean, degrade_reason string, snapshot_version string, strategy_id string, strategy_title string, applies_to_risk array<string>, source_lang string"
#: Columns of the per-iteration metrics file.
ITERATION_COLUMNS = ["iteration", "unsafe_blocks", "unsafe_line_pct", "raw_ptr_count", "test_pass_rate", "timestamp_utc", "commit", "config_hash"]
