"""Column-level functions (scalar expressions)."""

from netvigil.functions.labels import label_from_keywords, normalize_label, pick_label
from netvigil.functions.mac import mac_prefix, strip
from netvigil.functions.numeric import (finite_or_null, round_half_even, safe_ratio,
                                        to_numeric, to_numeric_text, zero_fill)

__all__ = [
    "normalize_label", "label_from_keywords", "pick_label", "mac_prefix", "strip",
    "to_numeric", "to_numeric_text", "finite_or_null", "zero_fill", "safe_ratio",
    "round_half_even",
]
