"""Settings of an analysis: defaults, a YAML file, overrides."""

from __future__ import annotations

from collections.abc import Mapping
from copy import deepcopy
from pathlib import Path
from typing import Any

#: The defaults of every setting.
DEFAULTS: dict[str, Any] = {
    "window_seconds": 30,  # gap over which alerts are merged
    "state_ttl_seconds": 300,
    "sweep_interval_seconds": 30,
    "max_tracked_sources": 50000,  # accepted, has no effect: state is distributed and spills
    "port_scan": {"min_distinct_ports": 20, "window_seconds": 10, "slow_window_seconds": 300, "slow_min_distinct_ports": 40},
    "arp_spoof": {"allowlist_macs": []},
    "dns_tunnel": {"max_label_length": 40, "min_entropy": 3.5, "min_unique_subdomains": 30, "domain_allowlist": [], "window_seconds": 60},
    "cleartext_creds": {"enabled": True, "mask_opaque_username": False},
    "ml": {"enabled": False, "model_path": "models/iforest", "top_k": 10, "window_seconds": 60, "contamination": 0.05},
}


#: Fixed value: the settings that are read where no file is named.
DEFAULT_FILE = Path("configs/default.yaml")


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``over`` on top of ``base``: mappings are merged at every depth, anything else is replaced."""
    out = deepcopy(dict(base))
    for key, value in over.items():
        both = isinstance(out.get(key), Mapping) and isinstance(value, Mapping)
        out[key] = merged(out[key], value) if both else deepcopy(value)
    return out


def load_config(path: str | Path | None = None, overrides: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Defaults, then the YAML file at ``path`` (FileNotFoundError if there is none), then ``overrides``.

    Without a path the file is ``configs/default.yaml`` in the working folder, if it is there.
    """
    out = deepcopy(DEFAULTS)
    if path is None and DEFAULT_FILE.is_file():
        path = DEFAULT_FILE
    if path is not None:
        import yaml

        if not Path(path).is_file():
            raise FileNotFoundError(f"no configuration file at {path}")
        out = merged(out, yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})
    return merged(out, overrides or {})


def micros(seconds: float) -> int:
    return round(float(seconds) * 1_000_000)
