"""Settings, with their defaults, and their YAML form."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Decontamination:
    benchmarks: tuple[str, ...] = ("mmlu", "gsm8k", "humaneval", "arc", "hellaswag")
    threshold: float = 0.85
    gram: int = 5
    method: str = "hybrid"
    sample_limit: int = 200
    top_k: int = 3
    review_threshold: float = 0.92
    hard_fail: tuple[str, ...] = ("exact", "ngram")
    review: tuple[str, ...] = ("substring", "embedding")


@dataclass(frozen=True)
class Quality:
    min_score: float = 7.5


@dataclass(frozen=True)
class Generation:
    num_examples: int = 100
    batch_size: int = 5
    personas: tuple[str, ...] = ("beginner", "expert", "skeptic")
    difficulties: tuple[str, ...] = ("easy", "medium", "hard")
    max_divergence: float = 0.15
    focus_top_k: int = 2
    focus_strategy: str = "strict"
    semantic_focus_top_k: int = 3
    max_active_clusters: int = 12
    saturation_threshold: float = 1.05
    long_tail_boost: float = 0.35
    neighbor_k: int = 3
    distance_weight: float = 0.6
    max_rounds: int = 3
    max_retries: int = 3
    max_empty_waves: int = 2


@dataclass(frozen=True)
class Export:
    format: str = "jsonl"
    output_dir: str = "./output"
    include_metadata: bool = False
    include_report: bool = True
    include_seeds: bool = True


# Where each provider's service is, and the model that is asked there unless another is named.
PROVIDERS = {
    "ollama": ("http://localhost:11434/v1", "llama3.1:8b"),
    "openai": ("https://api.openai.com/v1", "gpt-4o-mini"),
    "anthropic": ("https://api.anthropic.com/v1", "claude-sonnet-4-20250514"),
    "vllm": ("http://localhost:8000/v1", "meta-llama/Llama-3.1-8B-Instruct"),
    "custom": ("http://localhost:8000/v1", "default"),
}


@dataclass(frozen=True)
class Model:
    """The service that a judge or generator of the user's own may ask; nothing here calls it."""

    provider: str = "ollama"
    api_base: str = PROVIDERS["ollama"][0]
    model: str = PROVIDERS["ollama"][1]
    temperature: float = 0.8
    concurrent_requests: int = 4

    @classmethod
    def of(cls, provider: str, **settings) -> Model:
        """A provider's preset; of an unknown one the first's."""
        base, model = PROVIDERS.get(provider, PROVIDERS["ollama"])
        return cls(**{"provider": provider if provider in PROVIDERS else "ollama", "api_base": base, "model": model, **settings})


@dataclass(frozen=True)
class Config:
    model: Model = field(default_factory=Model)
    decontamination: Decontamination = field(default_factory=Decontamination)
    quality: Quality = field(default_factory=Quality)
    generation: Generation = field(default_factory=Generation)
    export: Export = field(default_factory=Export)

    def to_yaml(self, path: str) -> None:
        import yaml

        plain = {k: {n: list(v) if isinstance(v, tuple) else v for n, v in part.items()} for k, part in asdict(self).items()}
        Path(path).write_text(yaml.safe_dump(plain, sort_keys=False))

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        """Defaults where the file, a section or a setting is missing; others are ignored."""
        import yaml

        given = (yaml.safe_load(Path(path).read_text()) or {}) if Path(path).exists() else {}
        parts = {}
        llm = {k: v for k, v in (given.get("model") or {}).items() if k in Model.__dataclass_fields__}
        parts["model"] = Model.of(llm.pop("provider", "ollama"), **llm)
        for name, kind in (("decontamination", Decontamination), ("quality", Quality), ("generation", Generation), ("export", Export)):
            known = {k: tuple(v) if isinstance(v, list) else v for k, v in (given.get(name) or {}).items() if k in kind.__dataclass_fields__}
            parts[name] = kind(**known)
        return cls(**parts)
