"""Settings of a vault: defaults, a YAML file laid over them, three checks."""

from __future__ import annotations

from copy import deepcopy
from pathlib import Path

# The defaults of each section.
DEFAULTS: dict = {
    "vault": {"version": "0.1"},
    "templates": {"default": "templates/note.md", "by_type": {}},
    "vitality": {
        "decay": {}, "base": 1.0, "model": "actr", "actr_decay": 0.5, "metabolic_rates": {"self": 0.1, "notes": 1.0, "ops": 3.0}, "structural_boost_per_link": 0.1, "structural_boost_cap": 10,
        "revival_decay_rate": 0.2, "revival_window_days": 14, "access_saturation_k": 10, "zone_thresholds": {"active_floor": 0.6, "stale_floor": 0.3, "fading_floor": 0.1},
    },
    "promote": {"auto": True, "require_llm": False, "min_confidence": 0.6, "project_keywords": {}, "project_map_routing": {}, "default_area": "index"},
    "graph": {"pagerank_alpha": 0.85, "bridge_vitality_floor": 0.5, "hub_degree_multiplier": 2.0},
    "engine": {"embedding_dims": 384, "piecewise_bins": 8, "community_dims": 16},
    "retrieval": {"default_limit": 10, "candidate_multiplier": 5, "rrf_k": 60, "signal_weights": {"composite": 2.0, "keyword": 1.0, "graph": 1.5}, "exploration_budget": 0.1},
    "bm25": {"k1": 1.2, "b": 0.75, "title_boost": 3.0, "description_boost": 2.0},
    "ips": {"enabled": True, "epsilon": 0.01, "log_path": "ops/access.jsonl"},
    "activation": {"enabled": True, "damping": 0.6, "max_hops": 2, "min_boost": 0.01},
}


def load_config(path: str) -> dict:
    """The defaults with what the YAML file at ``path`` says instead; a missing or empty file gives the defaults.

    A value under a known section replaces that of the same name, sections within sections likewise; null values
    change nothing. Raises ``ValueError`` where the version, the default template or a numeric base of
    vitality is missing.
    """
    given = {}
    if Path(path).exists():
        import yaml

        given = yaml.safe_load(Path(path).read_text("utf-8")) or {}
    config = _laid_over(deepcopy(DEFAULTS), given)
    base = config["vitality"]["base"]
    faults = [
        "vault.version is required" if not config["vault"]["version"] else None,
        "templates.default is required" if not config["templates"]["default"] else None,
        "vitality.base must be a number" if isinstance(base, bool) or not isinstance(base, (int, float)) else None,
    ]
    if any(faults):
        raise ValueError("Invalid config: " + ", ".join(f for f in faults if f))
    return config


def _laid_over(base: dict, given: dict) -> dict:
    for name, value in given.items():
        if isinstance(value, dict) and isinstance(base.get(name), dict):
            base[name] = _laid_over(base[name], value) if base[name] else value
        elif value is not None:
            base[name] = value
    return base
