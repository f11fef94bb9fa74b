"""Finding the target, unit and role columns by name. Only names are looked at here."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

# Names accepted for the target column.
TARGET_ALIASES = (
    "vickers hardness (hv)", "vickers hardness(hv)", "vickers hardness", "vickers_hardness",
    "hardness (hv)", "hardness(hv)", "hardness_hv", "hardness", "hv", "hv_value",
    "target", "y", "label",
    "维氏硬度", "维氏硬度(hv)", "维氏硬度 hv", "硬度", "硬度值", "硬度(hv)", "目标", "目标值",
)
# Names accepted for the target in the second unit.
SECOND_UNIT_ALIASES = (
    "vickers hardness (gpa)", "vickers hardness(gpa)", "hardness (gpa)", "hardness(gpa)",
    "hardness_gpa", "gpa", "维氏硬度(gpa)", "硬度(gpa)",
)
# The canonical target name and the conversion factor of the second unit.
TARGET_NAME = "Vickers Hardness (HV)"
SECOND_UNIT_FACTOR = 102.0
# The share columns of a sample.
COMPOSITION = (
    "Al", "W", "Ta", "Ti", "Cr", "Ni", "Mo", "Hf", "C", "Co", "B",
    "V", "Si", "Fe", "Nb", "Zr", "Re", "Cb", "Ce", "Mn", "S", "P",
)
# Name patterns of the column groups shown to a user.
KEY_PATTERN = r"sample|id|image"
FEATURE_PATTERN = r"micro|pca|feat|dino|struct|pc\d+|feature_?\d+"
TARGET_PATTERN = r"hv|hardness|vickers"

_ALIAS_KEYS = frozenset(TARGET_ALIASES)
_UNIT_KEYS = frozenset(SECOND_UNIT_ALIASES)
_WORDS = ("硬度", "维氏")


def normal_name(name: str) -> str:
    """Comparable form of a column name."""
    ascii_brackets = str(name).translate(str.maketrans("（）", "()"))
    return re.sub(r"\s+", " ", ascii_brackets.strip().lower())


def name_map(columns: Iterable[str]) -> dict[str, str]:
    """Normalised name to original name; the last of equal names wins."""
    return {normal_name(c): c for c in columns}


def _looks_like_target(name: str) -> bool:
    key = normal_name(name)
    if any(word in key for word in ("image", "name", "gpa")):
        return False
    by_unit = key == "hv" or key.endswith(" hv") or "(hv)" in key
    return by_unit or "hardness" in key or any(word in name for word in _WORDS)


def find_target(columns: Sequence[str], target: str = TARGET_NAME) -> str | None:
    """Exact name, then alias, then a fuzzy match that prefers names with the unit."""
    exact = [c for c in columns if c.strip() == target]
    aliased = [c for key, c in name_map(columns).items() if key in _ALIAS_KEYS]
    fuzzy = sorted(
        (c for c in columns if _looks_like_target(c)), key=lambda c: "hv" not in normal_name(c)
    )
    return next(iter([*exact[-1:], *aliased, *fuzzy]), None)


def find_second_unit(columns: Sequence[str]) -> str | None:
    """Column that holds the target in the second unit."""
    known = [c for key, c in name_map(columns).items() if key in _UNIT_KEYS]
    similar = [
        c for c in columns
        if "gpa" in normal_name(c) and ("hard" in normal_name(c) or any(w in c for w in _WORDS))
    ]
    return next(iter([*known, *similar]), None)


# How many columns of a group a display shows.
DISPLAY_LIMITS = {"composition": 24, "features": 20, "all": 20}


def column_groups(
    columns: Sequence[str], composition: Sequence[str] = COMPOSITION, limits: Mapping[str, int] | None = None
) -> dict[str, list[str]]:
    """Split names into composition, features, target and all; ``limits`` cuts groups for a display."""
    def matching(pattern: str, names: Iterable[str]) -> list[str]:
        return [c for c in names if re.search(pattern, c, re.IGNORECASE)]

    shares = set(composition)
    keys = set(matching(KEY_PATTERN, columns))
    others = [c for c in columns if c not in shares]
    features = matching(FEATURE_PATTERN, others)
    if not features:
        named = set(matching(f"{TARGET_PATTERN}|image", others))
        features = [c for c in others if c not in named]
    groups = {
        "composition": [c for c in columns if c in shares or c in keys],
        "features": features,
        "target": matching(f"{TARGET_PATTERN}|{KEY_PATTERN}", columns),
        "all": list(columns),
    }
    return {name: found[: (limits or {}).get(name)] for name, found in groups.items()}
