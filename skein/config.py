"""Limits of a run, from defaults or from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Limits:
    """What a run reads, keeps and asks for; each field is also read from ``SKEIN_<FIELD>``."""

    batches_per_run: int = 8
    first_run_batches: int = 48
    look_back_hours: int = 24
    most_selected: int = 800
    most_strategic: int = 200
    most_final: int = 600
    provider_batch: int = 50
    provider_limit: int = 1500
    provider_tries: int = 4
    provider_enabled: bool = True
    most_doubts: int = 100
    anomaly_days: int = 90

    @classmethod
    def from_environment(cls, environment: Mapping[str, str] = os.environ) -> Limits:
        """Defaults, with numbers and switches of the environment; what is empty or no number counts as not set."""
        given = {}
        for field in fields(cls):
            text = environment.get(f"SKEIN_{field.name.upper()}", "").strip().lower()
            if field.type == "bool":
                if text:
                    given[field.name] = text not in ("false", "0", "no", "off")
            elif text.lstrip("-").isdigit() and int(text) > 0:
                given[field.name] = int(text)
        return cls(**given)
