"""Registered queries: importing the modules fills the registry."""

from . import answers, corpora, experiments, ingest, retrieval  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
