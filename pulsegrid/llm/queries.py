"""Imports every operator of this package, which registers its query."""

from pulsegrid.llm import language, licenses, mixing, packing, quality, sharding, repeats, runs, simhash, topk, toxicity, warc, whitening  # noqa: F401
from pulsegrid.llm.common import LLM_QUERIES  # noqa: F401
