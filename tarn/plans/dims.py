"""Dimension tables: small, fixed-size parameters as DataFrames, safe to broadcast because their size is that of a configuration."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Quality multipliers by source; those of the career analogs, by their own abbreviations; million inhabitants; age cohorts
#: (label, youngest, oldest); position codes by source.
MULTIPLIERS = {"nhl": 1.00, "ahl": 0.55, "shl": 0.45, "liiga": 0.42, "nl": 0.40, "extraliga": 0.35, "cz1l": 0.20}
CAREER_MULTIPLIERS = {"NHL": 1.00, "AHL": 0.55, "SHL": 0.45, "Liiga": 0.42, "NL": 0.40, "Czechia": 0.35, "KHL": 0.55}
POPULATION = {"CAN": 40.1, "USA": 335.0, "SWE": 10.6, "FIN": 5.6, "CZE": 10.9, "SVK": 5.4}
COHORTS = [("U22", 18, 21), ("23-25", 22, 25), ("26-29", 26, 29), ("30+", 30, 99)]
POSITIONS = {
    "nhl": {"C": "F", "L": "F", "R": "F", "F": "F", "D": "D", "G": "G"},
    "liiga": {"MV": "G", "VP": "D", "PP": "D", "OP": "D", "KH": "F", "VL": "F", "OL": "F", "LP": "F", "KP": "F"},
    "extraliga": {"Ú": "F", "O": "D", "B": "G"},
}


@lru_cache(maxsize=64)
def load_yaml(path: str) -> dict:
    """A YAML file as a dict; an empty file is an empty dict."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def mapping(spark: SparkSession, values: dict, key: str, value: str, kind: str = "double") -> DataFrame:
    """A dict as a two-column table."""
    return spark.createDataFrame(list(values.items()), f"{key} string, {value} {kind}")


def positions(spark: SparkSession) -> DataFrame:
    rows = [(source, code, position) for source, codes in POSITIONS.items() for code, position in codes.items()]
    return spark.createDataFrame(rows, "source string, code string, position string")


def cohorts(spark: SparkSession, of=COHORTS) -> DataFrame:
    return spark.createDataFrame(of, "cohort string, youngest int, oldest int")


def scenarios(multipliers: dict[str, float], changed: list[str], share: float = 0.2) -> list[tuple[str, str, dict[str, float]]]:
    """(name, description, multipliers): the baseline, each changed source down and up by share, and all sources down and up together.
    Changed values have four places."""

    def moved(sources, factor):
        return {s: round(m * factor, 4) if s in sources else m for s, m in multipliers.items()}

    out = [("baseline", "as configured", dict(multipliers))]
    for name, factor in (("down", 1 - share), ("up", 1 + share)):
        out += [(f"{s}_{name}", f"{s} x {factor:g}", moved({s}, factor)) for s in changed]
    for name, factor in (("down", 1 - share), ("up", 1 + share)):
        out.append((f"all_{name}", f"all x {factor:g}", moved(set(multipliers), factor)))
    return out


def scenario_dim(spark: SparkSession, multipliers: dict[str, float], changed: list[str], share: float = 0.2) -> DataFrame:
    """scenario x source -> multiplier."""
    rows = [(name, source, value) for name, _, values in scenarios(multipliers, changed, share) for source, value in values.items()]
    return spark.createDataFrame(rows, "scenario string, source string, multiplier double")
