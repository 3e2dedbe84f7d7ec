"""Prompt templates, one per kind of decision; ``{name}`` is a column."""

from __future__ import annotations

from importlib.resources import files


def template(kind: str) -> str:
    return files(__name__).joinpath(f"{kind}.txt").read_text(encoding="utf-8")
