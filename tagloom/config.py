"""Operator options.

One frozen dataclass instead of a free-form dictionary: every limit that an
operator applies is named here, so a job can override one value explicitly.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    # Limits every result depends on.
    max_content_length: int = 50_000
    # These three may be None: no limit.
    max_urls_per_site: int | None = 250
    h2_limit: int | None = 5
    paragraph_limit: int | None = 6
    paragraph_min_length: int = 80
    rule_description_length: int = 155
    title_length: int = 60
    description_length: int = 160
    prompt_content_length: int = 4_000
    prompt_h2_limit: int = 8
    max_attempts: int = 3
    rate_limit_requests: int = 10
    rate_limit_window: int = 60
    job_ttl_seconds: int = 3_600


DEFAULTS = Options()
