"""Names and numbers every family shares. All of them are plain parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Constants of the published method.
CI_Z = 1.959964
PROPENSITY_CLIP = 0.01
OVERLAP_MIN = 0.05
MAX_WIDTH = 1.5
FOLDS = 5
EVALUE_SLOPE = 0.91
SMD_LIMIT = 0.1
ARMS = ("A", "B", "C")


@dataclass(frozen=True)
class Columns:
    """Which columns of a table play which part."""

    unit: str = "unit_id"
    arm: str = "arm"
    cell: str = "cell"
    outcome: str = "y"
    covariates: tuple[str, ...] = ("x1", "x2", "b1", "b2")
    truth_prefixes: tuple[str, ...] = ("e_true_", "mu_true_")


def contrasts(arms=ARMS):
    """Ordered pairs of arms, first against second."""
    return [(a, b) for i, a in enumerate(arms) for b in arms[i + 1:]]


def targets(arms=ARMS):
    """(target name, plus arm, minus arm or None): every arm, then every contrast."""
    return [(a, a, None) for a in arms] + [(f"{a}-{b}", a, b) for a, b in contrasts(arms)]
