"""Schemas and settings."""

from __future__ import annotations

from dataclasses import dataclass

METADATA = "struct<command:string,environment:string,has_caption:boolean,inline:boolean,block:boolean,delimiter:string>"
ELEMENTS = f"file_path string, file_ord long, line_no int, seq long, type string, content string, start_line int, start_char int, end_line int, end_char int, metadata {METADATA}"
DIAGNOSTICS = "file_path string, start_line int, start_char int, end_line int, end_char int, message string, severity int, source string, code string, rule string, element_key string"
RANGE = ("start_line", "start_char", "end_line", "end_char")
TYPES = ("chapter", "title", "section", "subsection", "subsubsection", "sentence", "equation", "figure", "table", "environment")
LEVELS = {"chapter": 0, "section": 1, "subsection": 2, "subsubsection": 3}
ERROR, WARNING, INFORMATION, HINT = range(4)
STATE_VERSION = 2


@dataclass(frozen=True)
class Settings:
    minimum_sentences: int = 3
    density_scope: str = "corpus"  # or "file"
    auto_analyze: bool = False
    debounce_ms: int = 800
    llm_enabled: bool = False
    provider: str = "openai"
    review_mode: str = "lowFalsePositive"
    openai_model: str = ""
    openai_base_url: str = ""
    ollama_endpoint: str = ""
    ollama_model: str = ""


def debounce_ms(value: object, default: int = 800) -> int:
    """A whole number of milliseconds, 0 at least; the default for what is no number."""
    if isinstance(value, bool) or not isinstance(value, int | float) or value != value:
        return default
    return max(0, int(value // 1))
