"""Importing this module registers every query of the subpackage."""

from . import conversations, exact_dedup, language, lexical_search, licenses, mixing, neighbours, ngram_lm, packing, quality, simhash, token_count, toxicity  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
