"""Every tunable number of the daily run, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PulseConfig:
    # date windows, in days before ``as_of`` (lower end inclusive)
    raw_days: int = 60
    recent_days: int = 7
    retention_days: int = 60
    # caps of the arrays kept on one enriched event
    max_themes: int = 50
    max_persons: int = 30
    max_orgs: int = 30
    # caps of the arrays kept on one country-day
    max_codes: int = 20
    max_urls: int = 30
    top_entities: int = 10
    # countries handled on the latest day
    top_n: int = 80
    # vector search
    embed_chars: int = 3000
    vector_top_k: int = 10
    analog_topk: int = 5
    analog_snip_chars: int = 400
    # text generation
    context_chars: int = 700
    max_tokens: int = 300
    summary_tokens: int = 60
    temperature: float = 0.2
    # rows that one task asks a model about
    text_rows_per_task: int = 10
    embed_rows_per_task: int = 4096
    # map
    mood_low: float = -1.0
    mood_high: float = 1.0
    color_scale: str = "RdYlGn"


DEFAULTS = PulseConfig()
