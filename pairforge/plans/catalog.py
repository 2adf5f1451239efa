"""Every query of the engine by name, with its plain SQL."""

from pairforge.plans import corpus, decoys, inference, packed, retrieval, sequences, stores, tokens  # noqa: F401
from pairforge.plans.base import ORACLES, QUERIES  # noqa: F401
