"""What an audited operation returns: its rows, an account of what they cover, a list of issues and a verdict."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import DataFrame


class Verdict(IntEnum):
    """As an exit code; UNDECIDABLE outranks ISSUES."""

    OK = 0
    ISSUES = 1
    MISSING_SPEC = 2
    UNDECIDABLE = 3


class MissingSpecError(ValueError):
    """A declaration that the operation can't do without is missing."""


@dataclass(frozen=True)
class AuditedResult:
    result: DataFrame
    coverage: DataFrame
    issues: DataFrame
    verdict: Verdict
