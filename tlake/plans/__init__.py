from tlake.plans.lake import Lake
from tlake.plans.lifecycle import apply_moves, compact, compact_due, plan_moves, vacuum
from tlake.plans.inventory import inventory
from tlake.plans import reports

__all__ = ["Lake", "apply_moves", "compact", "compact_due", "inventory", "plan_moves", "reports", "vacuum"]
