"""Payment-method classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A method's name containing the word gets the type, first match wins.
PAYMENT_TYPES = (("Credit", "Credit Card"), ("Debit", "Debit Card"), ("Cash", "Cash"))
OTHER_TYPE = "Other"


def payment_type(method_name: Column, normalize: bool = False) -> Column:
    """Type by ``LIKE``; case-sensitive unless ``normalize`` is set."""
    match = method_name.ilike if normalize else method_name.like
    branches = F
    for word, label in PAYMENT_TYPES:
        branches = branches.when(match(f"%{word}%"), F.lit(label))
    return branches.otherwise(F.lit(OTHER_TYPE))
