"""Imports the modules whose queries register themselves."""

from visitwise.llm import (  # noqa: F401
    bpe,
    exact,
    language,
    mixing,
    negatives,
    neighbours,
    passages,
    quality,
    repetition,
    resampling,
    simhash,
    suffixes,
    warc,
)
from visitwise.llm.registry import ORACLES, QUERIES  # noqa: F401
