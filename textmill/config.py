"""Budgets, models, thresholds and options; all of it lives on the driver."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

#: Context windows by model.
MODELS = {
    "gpt-4o": 128_000, "gpt-4-turbo": 128_000, "gpt-4": 8_192, "gpt-3.5-turbo": 16_385,
    "claude-3-opus": 200_000, "claude-3-sonnet": 200_000, "claude-3-haiku": 200_000, "claude-3.5-sonnet": 200_000,
}


class InputError(ValueError):
    """Exit code 1: missing, unreadable or empty input."""

    code = 1


class ArgumentError(ValueError):
    """Exit code 2: options that don't go together."""

    code = 2


class BudgetError(ValueError):
    """Exit code 3: unknown model, or a reserve that leaves nothing."""

    code = 3


class ConfigError(ValueError):
    """Exit code 4: settings or preserves that can't be met."""

    code = 4


@dataclass(frozen=True)
class Budget:
    """One of: tokens, a share of the whole text's tokens, a model's window less a reserve; or a column with a number, or with a model, for each row."""

    tokens: int | None = None
    share: float | None = None
    model: str | None = None
    reserve: int = 0
    column: str | None = None
    model_column: str | None = None

    @staticmethod
    def parse(text: str) -> Budget:
        """``"25%"`` (over 0, up to 100) or a positive whole number."""
        s = text.strip()
        try:
            if s.endswith("%"):
                p = float(s[:-1])
                if not 0 < p <= 100:
                    raise ConfigError(f"invalid budget percentage: {text}")
                return Budget(share=p / 100.0)
            n = int(s)
        except ValueError as e:
            raise e if isinstance(e, ConfigError) else ConfigError(f"invalid budget: {text}") from None
        if n <= 0 or not re.fullmatch(r"\+?[0-9]+", s):
            raise ConfigError(f"budget must be positive: {text}")
        return Budget(tokens=n)


def list_models() -> list[str]:
    return list(MODELS)


def context_window(model: str) -> int | None:
    return MODELS.get(model.lower())


def model_budget(model: str, reserve: int = 0) -> int:
    """The model's window less ``reserve``."""
    window = context_window(model)
    if window is None:
        raise BudgetError(f"unknown model '{model}'; known models: {', '.join(MODELS)}")
    if reserve >= window:
        raise BudgetError(f"reserve {reserve} leaves nothing of the window of {window}")
    return window - reserve


def available(budget: int, head: int, tail: int) -> int:
    """Budget less what head and tail keep."""
    if budget <= 0:
        raise ConfigError("budget is zero")
    if head + tail > budget:
        raise ConfigError(f"preserved head and tail ({head + tail}) exceed the budget ({budget})")
    return budget - head - tail


@dataclass(frozen=True)
class Thresholds:
    similarity: float = 0.85
    importance_min: float = 0.30
    boilerplate: float = 0.90
    decay: float = 0.95

    def check(self) -> Thresholds:
        for name, value in vars(self).items():
            if not 0.0 <= value <= 1.0:
                raise ConfigError(f"threshold {name} must be within 0 and 1: {value}")
        return self


@dataclass(frozen=True)
class Options:
    """How to compress. ``compat="reference"`` keeps the known quirks, ``"fixed"`` repairs them."""

    budget: Budget = field(default_factory=Budget)
    mode: str = "paragraph"  # paragraph, sentence, line, semantic
    preserve_code: bool = False
    tokenizer: str | None = None  # left out: approximate, in reference compatibility openai
    vocabulary: str | None = None  # rank file for openai; left out: the library's own, which it fetches once
    vocabulary_pattern: str | None = None
    thresholds: Thresholds = field(default_factory=Thresholds)
    redundancy: bool = True
    boilerplate: bool = True
    extractive: bool = True
    head: int = 0
    tail: int = 0
    aggressive: bool = False
    conservative: bool = False
    boilerplate_patterns: tuple[str, ...] = ()
    preserve_patterns: tuple[str, ...] = ()
    similarity: str | None = None  # jaccard or minhash; left out: jaccard, in reference compatibility minhash
    compat: str = "fixed"

    @property
    def counter(self) -> str:
        return self.tokenizer or ("openai" if self.compat == "reference" else "approximate")

    @property
    def likeness(self) -> str:
        return self.similarity or ("minhash" if self.compat == "reference" else "jaccard")

    def check(self) -> Options:
        b = self.budget
        if b.tokens is None and b.share is None and b.model is None and b.column is None and b.model_column is None:
            raise ArgumentError("a budget or a model is needed")
        if self.aggressive and self.conservative:
            raise ArgumentError("aggressive and conservative exclude each other")
        if b.reserve > 0 and not b.model and not b.model_column:
            raise ArgumentError("a reserve needs a model")
        if self.mode not in ("paragraph", "sentence", "line", "semantic"):
            raise ArgumentError(f"unknown mode {self.mode}")
        if self.compat not in ("fixed", "reference") or self.likeness not in ("jaccard", "minhash"):
            raise ArgumentError("compat is fixed or reference, similarity is jaccard or minhash")
        self.thresholds.check()
        return self


def default_config_path() -> Path | None:
    """Where the user's configuration is looked for: ``$XDG_CONFIG_HOME`` or ``~/.config``; None without a home."""
    base = os.environ.get("XDG_CONFIG_HOME") or (os.path.join(os.environ["HOME"], ".config") if os.environ.get("HOME") else None)
    return Path(base) / "textmill" / "config.toml" if base else None


def load(path: str | None, options: Options | None = None) -> Options:
    """Options from a TOML file over ``options``. A path that is given must exist, but in reference compatibility."""
    options = options or Options()
    if path is None:
        return options
    if not Path(path).exists():
        if options.compat == "reference":
            return options
        raise ConfigError(f"no configuration file {path}")
    try:
        data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from None
    t = data.get("thresholds", {})
    names = {"redundancy_similarity": "similarity", "importance_minimum": "importance_min", "boilerplate_confidence": "boilerplate", "position_decay": "decay"}
    thresholds = replace(options.thresholds, **{names[k]: float(v) for k, v in t.items() if k in names}).check()
    s = data.get("strategies", {})
    changes: dict = {"thresholds": thresholds} | {k: bool(s[k]) for k in ("redundancy", "boilerplate", "extractive") if k in s}
    for key in ("boilerplate_patterns", "preserve_patterns"):
        patterns = tuple(map(str, data.get(key, {}).values()))
        changes[key] = getattr(options, key) + patterns
    if options.compat == "fixed":
        if "tokenizer" in data:
            changes["tokenizer"] = str(data["tokenizer"])
        if "default_budget" in data and options.budget == Budget():
            changes["budget"] = Budget.parse(str(data["default_budget"]))
        elif "default_model" in data and options.budget == Budget():
            changes["budget"] = Budget(model=str(data["default_model"]))
    return replace(options, **changes)
