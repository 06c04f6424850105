"""What the beginning of a step can say."""

from __future__ import annotations

from enum import Enum


class StepStatus(Enum):
    OK = "ok"
    NOT_READY = "not ready"  # within the time allowed, no further step appeared
    END_OF_STREAM = "end of stream"


class StepError(ValueError):
    """A step begun within another, or ended or written outside of one."""
