"""Operators for training-data corpora, each with its query."""

from .common import ORACLES, QUERIES  # noqa: F401
from . import bpe, chat, decontaminate, langid, lattice, lines, negatives, periodic, pii, secrets, sharding, simhash, toxicity  # noqa: F401
