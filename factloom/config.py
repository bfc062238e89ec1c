"""Settings: one frozen tree, read from JSON or YAML; what a file leaves out keeps its default."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

# Names, order and numbers are part of the results.
METRICS = ("aum", "net_irr", "tvpi", "target_irr", "mgmt_fee", "carry")
EXTRACTOR_WEIGHTS = (("RegexExtractor", 0.95), ("CohereExtractor", 0.70), ("OllamaExtractor", 0.60))
AUTHORITY_WEIGHTS = (("lpa", 0.98), ("agreement", 0.95), ("audited", 0.93), ("financial", 0.90), ("statement", 0.85), ("quarter", 0.75), ("update", 0.70), ("deck", 0.55))


@dataclass(frozen=True)
class Rules:
    aum_tolerance_pct: float = 0.03
    mgmt_fee_abs_pct: float = 0.25
    target_irr_abs_pct: float = 2.0
    internal_irr_mention_tolerance_pct: float = 1.0


@dataclass(frozen=True)
class Trust:
    extractor_weights: tuple[tuple[str, float], ...] = EXTRACTOR_WEIGHTS
    extractor_default_weight: float = 0.50
    authority_weights: tuple[tuple[str, float], ...] = AUTHORITY_WEIGHTS
    authority_default_weight: float = 0.50


# Default models, limits and resolutions of the classes below.
@dataclass(frozen=True)
class Hosted:
    enabled: bool = False
    model: str = "command-a-03-2025"
    temperature: float = 0.0
    max_chars: int = 60_000
    attempts: int = 3
    backoff_s: float = 2.0


@dataclass(frozen=True)
class Local:
    enabled: bool = False
    model: str = "llama3.2:3b"
    host: str = "http://localhost:11434"
    temperature: float = 0.0
    max_chars: int = 24_000
    attempts: int = 3
    timeout_s: float = 180.0


@dataclass(frozen=True)
class Vision:
    enabled: bool = False
    model: str = "qwen2.5vl:7b"
    host: str = "http://localhost:11434"
    temperature: float = 0.0
    dpi: int = 150
    max_pages: int = 20
    confidence: float = 0.60
    attempts: int = 2
    timeout_s: float = 180.0


@dataclass(frozen=True)
class Ocr:
    enabled: bool = True
    dpi: int = 300
    min_text_chars: int = 20


@dataclass(frozen=True)
class Prompts:
    """Prompt files; without a folder the built-in prompts are used."""

    folder: str | None = None
    extract: str = "extract_v1.txt"
    charts: str = "chart_extract_v1.txt"


# Settings of files in the other layout, and where they go; None: read, and without effect here.
OTHER_LAYOUT = {
    "model.provider": None,
    "model.model": "hosted.model",
    "model.temperature": "hosted.temperature",
    "ollama.enabled": "local.enabled",
    "ollama.model": "local.model",
    "ollama.temperature": "local.temperature",
    "ollama.host": "local.host",
    "vision.provider": None,
    "vision.prompt": "prompts.charts",
    "run.use_cohere": "hosted.enabled",
    "run.cache_dir": None,
    "run.enable_disk_cache": "cache",
    "run.prompts_dir": "prompts.folder",
    "run.extract_prompt": "prompts.extract",
    "run.memo_prompt": None,
    "run.enable_ocr": None,
    "run.enable_pdf_output": None,
    "run.enable_streamlit": None,
    "run.redact_before_llm": "redact",
}


#: Sections that only the other layout has, and its defaults where they differ from the ones here.
OTHER_SECTIONS = {"model", "ollama", "run"}
OTHER_DEFAULTS = {"hosted": {"enabled": True}, "local": {"enabled": True}}


@dataclass(frozen=True)
class Config:
    rules: Rules = field(default_factory=Rules)
    trust: Trust = field(default_factory=Trust)
    hosted: Hosted = field(default_factory=Hosted)
    local: Local = field(default_factory=Local)
    vision: Vision = field(default_factory=Vision)
    ocr: Ocr = field(default_factory=Ocr)
    prompts: Prompts = field(default_factory=Prompts)
    redact: bool = False
    cache: bool = True


def load(path: str | None = None) -> Config:
    """None: defaults. A .json file is JSON, any other YAML; a missing file is an error, an unknown name too.

    A file of the other layout has its defaults for what it leaves out: text models are on, where they can be reached."""
    if path is None:
        return Config()
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            given = json.load(f)
        else:
            import yaml

            given = yaml.safe_load(f)
    given = given or {}
    base = _set(Config(), OTHER_DEFAULTS) if OTHER_SECTIONS & given.keys() else Config()
    return _set(base, _renamed(given))


def _renamed(given: dict) -> dict:
    """given, with the settings of the other layout under this one's names."""
    out = {k: {} if v is None else dict(v) if isinstance(v, dict) else v for k, v in given.items()}
    for old, new in OTHER_LAYOUT.items():
        section, name = old.split(".")
        if name not in (out.get(section) or {}):
            continue
        value = out[section].pop(name)
        if new is not None:
            *into, last = new.split(".")
            target = out.setdefault(into[0], {}) if into else out
            target[last] = value
    return {k: v for k, v in out.items() if v != {}}


def _set(base, given: dict):
    new = {}
    for name, value in given.items():
        old = getattr(base, name)
        if dataclasses.is_dataclass(old):
            new[name] = _set(old, value)
        elif isinstance(old, tuple) and isinstance(value, dict):
            new[name] = tuple((k, float(v)) for k, v in value.items())
        else:
            new[name] = value
    return dataclasses.replace(base, **new)
