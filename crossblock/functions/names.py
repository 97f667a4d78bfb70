"""Labels of the five token positions and the other closed domains."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PositionNames:
    """Labels used in `position` columns. Tables saved with other labels pass their own."""

    answer_colon: str = "AC"
    last_answer: str = "LAT"
    newline: str = "NL"
    after_newline: str = "NL1"
    confidence: str = "CC"

    def ordered(self) -> list[str]:
        return [
            self.answer_colon,
            self.last_answer,
            self.newline,
            self.after_newline,
            self.confidence,
        ]

    @property
    def controls(self) -> list[str]:
        return [self.after_newline, self.answer_colon]


@dataclass(frozen=True)
class ConditionNames:
    """Labels of the route conditions that the gates read."""

    clean: str = "clean"
    everything_cut: str = "cut everything"
    only_newline: str = "only via NL"
    only_direct: str = "only direct"


# The closed domains of the cell table.
CELLS = ["q1a1", "q1a2", "q2a1", "q2a2"]
ANSWER_SOURCES = ["gold", "model_error", "alias", "distractor"]
POLICY_STATUSES = ["natural", "high_lp_wrong", "low_lp_correct", "off_policy"]
FITTABLE_SPLITS = ["train", "validation", "test"]
HOLDOUT = "family_holdout"
SPLITS = [*FITTABLE_SPLITS, HOLDOUT]
SOURCE_KINDS = ["partner", "random_cell", "gaussian", "mean", "matched_donor", "crossed_donor"]
