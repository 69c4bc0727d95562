"""The registered queries: each applies operators of the library to the test tables."""

from quillstone.plans import catalogue, curation, files, layout, learner, merging, outline, quality, reading, retrieval, streams, strings, tagging
from quillstone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalogue", "curation", "files", "layout", "learner", "merging", "outline", "quality", "reading", "retrieval", "streams", "strings", "tagging"]
