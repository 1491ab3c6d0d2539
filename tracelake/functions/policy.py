"""Snapshot policy of an asset, resolved against its archive's settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Policies, cap actions and archive defaults.
POLICIES = ("auto", "every_change", "on_reference", "periodic", "manual")
AUTO = "auto"
DEFAULT_POLICY = "on_reference"
CAP_ACTIONS = ("mark", "drop")
DEFAULT_PERIODIC_ABOVE = 256 * 1024 ** 2
DEFAULT_MANUAL_ABOVE = 8 * 1024 ** 3
DEFAULT_PERIOD_DAYS = 7


def policy_for_size(size: Column, policy: Column, periodic_above: Column,
                    manual_above: Column) -> Column:
    """Rung of the size ladder, the archive's own policy at the bottom."""
    size = F.coalesce(size, F.lit(0))
    bottom = F.when(F.coalesce(policy, F.lit("")) == "", DEFAULT_POLICY).otherwise(policy)
    return (F.when(size >= manual_above, "manual")
            .when(size >= periodic_above, "periodic").otherwise(bottom))


def effective_policy(declared: Column, size: Column, policy: Column, periodic_above: Column,
                     manual_above: Column) -> Column:
    chosen = F.when(F.coalesce(declared, F.lit("")) == "", AUTO).otherwise(declared)
    return (F.when(chosen == AUTO, policy_for_size(size, policy, periodic_above, manual_above))
            .when(chosen.isin(*POLICIES), chosen).otherwise(DEFAULT_POLICY))


def policy_reason(resolved: Column) -> Column:
    return (F.when(resolved == "manual", "over the manual threshold")
            .when(resolved == "periodic", "over the periodic threshold")
            .otherwise("below the size thresholds"))
