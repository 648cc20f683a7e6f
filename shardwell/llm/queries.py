"""Imports every module that registers queries."""

from . import content_sort, jaccard_join, language_id, line_dedup, packing, secret_scan, sentence_pieces, simhash, substring_dedup, token_files  # noqa: F401
from .runtime import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
