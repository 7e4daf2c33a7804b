"""Page metadata at corpus scale: DataFrame in, DataFrame out."""

from tagloom.config import DEFAULTS, Options
from tagloom.functions.errors import error_code, is_transient
from tagloom.functions.text import build_description, optimize_title, trim_to_length
from tagloom.functions.urls import canonical_url
from tagloom.operators.discovery import discover_urls
from tagloom.operators.jobs import (
    job_frontier,
    job_summary,
    latest_state,
    live_states,
    merge_retry,
    page_results,
    resolve_attempts,
    retry_set,
    run_job,
    url_lists,
)
from tagloom.operators.pages import extract_pages, page_type
from tagloom.operators.ratelimit import rate_limit
from tagloom.operators.responses import (
    apply_responses,
    build_prompts,
    build_requests,
    generate_metadata,
    generate_texts,
    response_texts,
)
from tagloom.operators.rules import compliance_report, generate_rules

__all__ = [
    "DEFAULTS", "Options", "apply_responses", "build_description", "build_prompts",
    "build_requests", "canonical_url", "compliance_report", "discover_urls", "error_code",
    "extract_pages", "generate_metadata", "generate_rules", "generate_texts", "is_transient", "job_frontier", "job_summary",
    "latest_state", "live_states", "merge_retry", "optimize_title", "page_results", "page_type",
    "rate_limit", "resolve_attempts", "response_texts", "retry_set", "run_job",
    "trim_to_length", "url_lists",
]
