"""Progress of a long compression on a terminal."""

from __future__ import annotations

import sys
from collections.abc import Callable

#: From how many tokens on progress is shown, and the stages with what is done when they begin, in percent.
LARGE = 50_000
STAGES = {"segmenting": 10, "analyzing redundancy": 30, "analyzing importance": 50, "compressing": 70, "reassembling": 90}


def quiet(stage: str) -> None:
    """No progress."""


def on_terminal(tokens: int, out=None) -> Callable[[str], None]:
    """Shows stages on ``out`` (standard error) if it is a terminal and the input is large."""
    out = sys.stderr if out is None else out
    if tokens < LARGE or not out.isatty():
        return quiet
    return lambda stage: out.write(f"\rProcessing: {STAGES[stage]:3d}% ({stage})" + ("\n" if stage == "reassembling" else ""))
