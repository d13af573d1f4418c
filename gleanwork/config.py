"""Job options: one immutable object instead of module constants and environment look-ups in operators."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    # Crawl
    allowed_hosts: tuple[str, ...] = ("example.com", "example.org")
    start_urls: tuple[str, ...] = ()
    max_pages: int | None = 1_000_000  # None: all
    max_depth: int = 10
    requests_per_second: float = 2.0
    timeout_s: float = 30.0
    sitemap_cap: int = 20_000
    # Paths of the stages' tables
    bronze: str = "output/bronze"
    documents: str = "output/documents"
    chunks: str = "output/chunks"
    vectors: str = "output/vectors"
    # Chunking: tokens and share of overlap by profile
    structured_size: int = 512
    structured_overlap: float = 0.12
    ocr_size: int = 256
    ocr_overlap: float = 0.20
    # Normalising
    text_key: str = ""
    dedup: str = "none"  # or sha1_text
    token_mode: str = "approx_chars"
    chars_per_token: float = 3.6
    min_tokens: int = 0
    min_chars: int = 0
    # Retrieval
    top_k: int = 5
    initial_k: int = 50
    final_k: int = 10
    mode: str = "auto"  # plain, rerank or auto

    @classmethod
    def from_env(cls, prefix: str = "GLEANWORK_", env: dict[str, str] | None = None) -> Options:
        """Defaults, overridden by variables such as GLEANWORK_TOP_K; tuples are comma-separated."""
        env, out = dict(os.environ if env is None else env), cls()
        for f in fields(cls):
            if (text := env.get(f"{prefix}{f.name.upper()}")) is not None:
                old = getattr(out, f.name)
                out = replace(out, **{f.name: tuple(x.strip() for x in text.split(",") if x.strip()) if isinstance(old, tuple) else _as(type(old), text)})
        return out


def _as(kind: type, text: str):
    """The text as a value of this kind; a number that is empty is None."""
    return None if kind is not str and not text.strip() else kind(text)
