"""The processing profile: defaults, rules, and reading it from TOML.

Rules are SQL predicates over a row of profile values; not-a-number fails every
rule that compares.
"""

from __future__ import annotations

import logging
import tomllib
from dataclasses import dataclass, field

#: The defaults of the numeric keys, and the rules in the order they are reported.
DEFAULTS = {"overlap": 20.0, "aspect": 0.33, "threads": 0.0, "growth_step": 2.0, "growth_steps": 11.0, "max_std": 15.0, "improvement": 0.1, "strength": 10.0, "window": 7.0, "search": 21.0, "inpaint_std": 15.0, "multiplier": 0.2, "min_radius": 7.0, "max_radius": 20.0}
RULES = {
    "overlap": "overlap between 0 and 100",
    "aspect": "aspect > 0 and not isnan(aspect)",
    "threads": "threads <= 2147483647",
    "growth": "growth_step >= 1 and growth_steps >= 1",
    "max_std": "max_std > 0 and not isnan(max_std)",
    "improvement": "improvement >= 0 and improvement < 1",
    "strength": "strength > 0 and not isnan(strength)",
    "window": "window >= 3 and window % 2 = 1 and search >= 3 and search % 2 = 1",
    "inpaint": "inpaint_std >= 0 and multiplier >= 0",
    "radius": "max_radius >= min_radius",
}


@dataclass(frozen=True)
class Profile:
    """Values by key; what a file had besides is kept but not used."""

    values: dict[str, float] = field(default_factory=lambda: dict(DEFAULTS))
    unknown: dict = field(default_factory=dict)


def parse(text: str) -> Profile:
    """Missing keys take their default; unknown ones are reported and preserved."""
    raw = tomllib.loads(text)
    flat = {k: v for part in raw.values() if isinstance(part, dict) for k, v in part.items()} | {k: v for k, v in raw.items() if not isinstance(v, dict)}
    unknown = {k: v for k, v in flat.items() if k not in DEFAULTS}
    for key in unknown:
        logging.getLogger(__name__).warning("unknown profile key %s", key)
    return Profile({k: float(flat.get(k, d)) for k, d in DEFAULTS.items()}, unknown)


def start_step(skips: set[str], steps: tuple[str, ...]) -> int:
    """Number of leading steps to skip: skipping one implies all before it."""
    return max((i + 1 for i, s in enumerate(steps) if s in skips), default=0)


def resolve_threads(configured: int, cores: int, images: int) -> int:
    return max(1, min(configured or cores, images))


def keeps_in_memory(images: int, debug: bool, no_cache: bool) -> bool:
    """A single image without debug output or cache needs no checkpoint files."""
    return images == 1 and not debug and no_cache


def requested_outputs(save_only_mask: bool = False, save_only_cleaned: bool = False, save_only_text: bool = False, extract_text: bool = False) -> set[str]:
    """Categories to export: what "only" names, else cleaned and mask; text when asked for."""
    only = {name for name, on in (("mask", save_only_mask), ("cleaned", save_only_cleaned), ("text", save_only_text)) if on}
    return only or {"cleaned", "mask", *(["text"] if extract_text else [])}


def implied_skips(skips: set[str], steps: tuple[str, ...]) -> set[str]:
    """Skipping a step skips all before it."""
    return set(steps[: start_step(skips, steps)])


def growth_padding(min_thickness: int = 4, step: int = 2) -> int:
    """Margin in which masks grow: twice the larger of both radii."""
    return 2 * max(min_thickness, step)


def nlm_params(profile: Profile) -> dict[str, float]:
    return {"strength": profile.values["strength"], "patch": int(profile.values["window"]), "search": int(profile.values["search"])}


def split_params(preferred_height: int = 2000, tolerance: int = 500, split_strips: bool = True, aspect: float | None = None) -> dict[str, float]:
    """What cutting a strip goes by: preferred height of a segment, how far a cut may lie from it, whether to cut at all, and from which shape on."""
    return {"preferred_height": preferred_height, "tolerance": tolerance, "split_strips": split_strips, "aspect": DEFAULTS["aspect"] if aspect is None else aspect}


def resolve_device(wanted: str, has_cuda: bool) -> str:
    """The device to run on: what is wanted, ``auto`` by what there is; asking for what is missing is refused."""
    if wanted not in ("auto", "cpu", "cuda"):
        raise ValueError(f"unknown device {wanted}")
    if wanted == "cuda" and not has_cuda:
        raise ValueError("cuda is wanted but not available")
    return ("cuda" if has_cuda else "cpu") if wanted == "auto" else wanted
