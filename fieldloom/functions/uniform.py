"""Repeatable uniforms and ids from a hash, so that a lost task gives the same rows again."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .nulls import paste

HASH_RANGE = 2**52


def hash32(*parts) -> Column:
    """An integer in [0, 2**32) from the md5 of the parts joined with ``|``."""
    digest = F.md5(paste(*parts, sep="|"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """A number in [0, 1) with 52 random bits that depends on the parts only."""
    digest = F.md5(paste(*parts, sep="|"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(HASH_RANGE))
