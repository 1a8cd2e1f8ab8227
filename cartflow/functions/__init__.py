"""Column-level helpers: ordering without hot groups, bounded broadcast, seeded splits."""

from .broadcast import bounded_broadcast
from .columns import hash_fraction, threshold_flag
from .ordering import grouped_row_number, running_sums

__all__ = ["bounded_broadcast", "hash_fraction", "threshold_flag",
           "grouped_row_number", "running_sums"]
