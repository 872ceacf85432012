"""Table schemas. Fixed in code, never inferred."""

from __future__ import annotations

_POSTING_FIELDS = (
    "company_name string, source_type string, external_job_id string, title string, team string, "
    "location string, employment_type string, level string, url string, description_text string, "
    "posted_at timestamp, raw_payload string"
)

COMPANIES = (
    "id bigint, name string, careers_url string, source_type string, "
    "source_config map<string,string>, enabled boolean, last_validated_at timestamp, "
    "last_validation_status string, consecutive_failures int, last_error string, "
    "created_at timestamp, updated_at timestamp"
)
JOBS = (
    "id bigint, company_id bigint, source_type string, external_job_id string, title string, "
    "team string, location string, employment_type string, level string, url string, "
    "description_text string, posted_at timestamp, first_seen_at timestamp, last_seen_at timestamp, "
    "is_active boolean, entry_level_score double, is_entry_level boolean, "
    "is_software_engineering_related boolean, fingerprint_hash string, raw_payload string, "
    "created_at timestamp, updated_at timestamp"
)
# method: api, html or rendered. Store this table partitioned by source_type so that each
# provider branch scans its own files only.
CAPTURES = (
    "company_id bigint, source_type string, cycle_ts timestamp, method string, page_ordinal int, "
    "page_url string, status_code int, content_type string, body string"
)
POSTINGS = f"company_id bigint, cycle_ts timestamp, ordinal bigint, {_POSTING_FIELDS}"
SNAPSHOTS = "company_id bigint, cycle_ts timestamp, outcome string, error string"
# rendered_*: what opening the page in a browser gave, for generic sources only.
PROBES = (
    "company_id bigint, probed_at timestamp, status_code int, body string, error string, "
    "rendered_status int, rendered_error string"
)
ANCHORS = (
    "company_id bigint, cycle_ts timestamp, page_ordinal int, page_url string, anchor_ordinal int, href string, "
    "text string, location string, selector_rank int"
)
TARGETS_CSV = (
    "name string, category string, source_list string, careers_url string, source_type string, "
    "source_config_json string, priority string, enabled string"
)

POSTING_COLUMNS = [f.split()[0] for f in _POSTING_FIELDS.split(", ")]
JOB_COLUMNS = [f.split()[0] for f in JOBS.split(", ")]
COMPANY_COLUMNS = [f.split()[0] for f in COMPANIES.split(", ")]
# Columns a list returns: everything but the payload.
JOB_LIST_COLUMNS = [c for c in JOB_COLUMNS if c != "raw_payload"]
