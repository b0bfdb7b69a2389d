"""Configuration of a run: defaults, a TOML file over them, and the decision file of the sequencer's software."""

from __future__ import annotations

import argparse
import tomllib
from dataclasses import dataclass, field
from typing import Any

# Defaults by section.
DEFAULTS: dict[str, dict[str, Any]] = {
    "general": {"name": "run"},
    "live": {"device": "", "host": "localhost", "port": 9502, "data_wait": 100, "prom": False},
    "optional": {"temperature": 60, "wait": 60},
    "filters": {"min_seq_len": 2500, "min_contig_len": 10_000, "min_s1": 200, "min_map_len": 2000},
    "const": {"mu": 400, "tetra": True, "filter_repeats": False, "lowcov": 10},
    "simulation": {"fq": "", "bsize": 4000, "maxb": 400, "binit": 5, "dumptime": 200_000_000},
}
CHANNELS, CHANNELS_LARGE = 512, 3000


@dataclass
class Config:
    values: dict[str, Any] = field(default_factory=dict)
    sim_run: bool = False
    live_run: bool = False
    split_flowcell: bool = False
    regions: list[dict[str, Any]] = field(default_factory=list)

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["values"][name]
        except KeyError:
            raise AttributeError(name) from None

    @property
    def channels(self) -> int:
        return CHANNELS_LARGE if self.prom else CHANNELS


def merged(own: dict[str, dict[str, Any]]) -> dict[str, dict[str, Any]]:
    """The defaults with the keys of ``own`` over them."""
    return {s: DEFAULTS.get(s, {}) | own.get(s, {}) for s in [*DEFAULTS, *(x for x in own if x not in DEFAULTS)]}


def flat(sections: dict[str, dict[str, Any]]) -> dict[str, Any]:
    """One table; where sections have the same key, the later one wins."""
    return {k: v for s in sections.values() for k, v in s.items()}


def load(toml: str | dict, decisions: str | dict | None = None) -> Config:
    """A run's configuration. A read file makes it a simulation, else a device makes it live; neither is an error.

    With a decision file of two regions or more the flow cell is split, and one of them must have the run's name.
    """
    read = lambda x: tomllib.loads(open(x, encoding="utf-8").read()) if isinstance(x, str) else x
    config = Config(flat(merged(read(toml))))
    if config.fq:
        config.sim_run = True
    elif config.device:
        config.live_run = True
    else:
        raise ValueError("neither reads for a simulation nor a device")
    if decisions is not None:
        config.regions = read(decisions).get("regions", [])
        config.split_flowcell = len(config.regions) >= 2
        if config.split_flowcell and config.name not in [r.get("name") for r in config.regions]:
            raise ValueError("no region has the run's name")
    return config


def actions(config: Config, region: str | None = None) -> dict[str, str]:
    """Decision to action of a region, the first one if none is named."""
    kinds = ("single_on", "single_off", "multi_on", "multi_off", "no_map", "no_seq")
    chosen = next((r for r in config.regions if region is None or r.get("name") == region), {})
    return {k: chosen[k] for k in kinds if k in chosen}


def channels_of(toml: str | dict, name: str) -> set[int]:
    """Channels of the condition that is called ``name``; none if there is no such condition."""
    told = tomllib.loads(open(toml, encoding="utf-8").read()) if isinstance(toml, str) else toml
    for condition in told.get("conditions", {}).values():
        if condition.get("name") == name:
            return set(condition.get("channels", []))
    return set()


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strandlake")
    out.add_argument("--toml", required=True)
    out.add_argument("--decisions", default=None)
    out.add_argument("--work", default="file:///tmp/strandlake")
    return out
