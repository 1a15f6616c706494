"""Thresholds of the history and graph operators, passed explicitly everywhere."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    coupling_min_shared: int = 5
    coupling_min_degree: float = 0.45
    mega_commit_files: int = 25
    min_commits: int = 60
    knowledge_risk_share: float = 0.85
    knowledge_risk_min_edits: int = 8
    episode_gap_days: int = 3
    rework_window_days: int = 14
    rework_min_changes: int = 5
    velocity_min_episodes: int = 3
    clone_window: int = 40
    clone_min_shared: int = 2
    clone_max_owners: int = 50
    slice_budget_bytes: int = 8192
    slice_string_chars: int = 400
    payback_max_quarters: float = 4.0
    prune_min_confidence: int = 60
    prune_min_control: int = 20
    gate_containment_drop: float = -0.03
    gate_rework_rise: float = 0.05

    @classmethod
    def parse(cls, text: str) -> Params:
        """From lines `key: value`; unknown keys are errors, # starts a comment."""
        own, known = {}, cls.__dataclass_fields__
        for line in text.splitlines():
            key, colon, value = line.partition("#")[0].partition(":")
            if not key.strip():
                continue
            if not colon or key.strip() not in known:
                raise ValueError(f"unknown parameter: {key.strip()}")
            own[key.strip()] = type(known[key.strip()].default)(float(value)) if known[key.strip()].type != "str" else value.strip()
        return cls(**own)


DEFAULTS = Params()
DAY = 86_400
