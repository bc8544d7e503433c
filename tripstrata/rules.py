"""One ordered rule list behind both the clean filter and the quarantine reason.

A rule's ``broken`` text is true for rows that break it. The first broken rule
names the reason. Rules with ``blocks_clean`` off only mark a row: it is kept in
clean and listed in quarantine as well.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted codes and the speed limit.
PAYMENT_TYPES = (0, 1, 2, 3, 4, 5, 6)
RATE_CODES = (1, 2, 3, 4, 5, 6, 99)
MAX_SPEED = 200


@dataclass(frozen=True)
class Rule:
    reason: str
    broken: str
    blocks_clean: bool = True


# Reasons and their order.
RULES = (
    Rule("missing_datetime", "pickup_ts IS NULL OR dropoff_ts IS NULL"),
    Rule("negative_duration", "dropoff_ts < pickup_ts"),
    Rule("missing_location", "pu_location_id IS NULL OR do_location_id IS NULL"),
    Rule("invalid_distance", "trip_distance IS NULL OR trip_distance <= 0"),
    Rule("invalid_total_amount", "total_amount IS NULL OR total_amount < 0"),
    Rule("invalid_payment_type", f"payment_type IS NOT NULL AND payment_type NOT IN {PAYMENT_TYPES}"),
    Rule("invalid_rate_code", f"rate_code_id IS NOT NULL AND rate_code_id NOT IN {RATE_CODES}"),
    Rule("unrealistic_speed", f"avg_speed_kmh IS NOT NULL AND avg_speed_kmh > {MAX_SPEED}", blocks_clean=False),
)


def reason_code(rules: tuple[Rule, ...] = RULES) -> Column:
    """Reason of the first broken rule, NULL when none is broken."""
    branches = " ".join(f"WHEN {rule.broken} THEN '{rule.reason}'" for rule in rules)
    return F.expr(f"CASE {branches} END")


def is_valid(rules: tuple[Rule, ...] = RULES) -> Column:
    """True when no blocking rule is broken.

    Written as a chain of negations that Catalyst turns into plain comparisons,
    so that the NULL and range parts reach the Parquet reader.
    """
    return F.expr(" AND ".join(f"NOT ({rule.broken})" for rule in rules if rule.blocks_clean))


def rules_print(rules: tuple[Rule, ...] = RULES) -> str:
    """Identifies a rule list: what was built by another one is to be built again."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]
