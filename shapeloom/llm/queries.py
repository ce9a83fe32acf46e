"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from . import binaryoutput, bitslices, centroids, chatformat, decontam, langid, mixing, ngramjoin, qualityrules, secretscan, tokencount, toxicity, whitening

MODULES = (mixing, ngramjoin, tokencount, binaryoutput, decontam, toxicity, secretscan, langid, chatformat, qualityrules, centroids, whitening, bitslices)


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
