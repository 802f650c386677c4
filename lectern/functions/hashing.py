"""Reproducible pseudo-random values from md5, equal in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def md5_hex(*parts: Column | str | int) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def md5_int(*parts: Column | str | int) -> Column:
    """First 32 bits of the md5 of the joined parts as a non-negative long."""
    return F.conv(F.substring(md5_hex(*parts), 1, 8), 16, 10).cast("long")


def md5_unit(*parts: Column | str | int) -> Column:
    """Uniform value in [0, 1)."""
    return md5_int(*parts) / F.lit(4294967296.0)


def md5_bucket(hex_digest: Column) -> Column:
    """Order-preserving bucket of a digest (4096 even buckets) for chunked ranking."""
    return F.conv(F.substring(hex_digest, 1, 3), 16, 10).cast("int")


def signed_cell(token: Column, dimensions: int) -> Column:
    """``(d, g)`` of a token: the dimension its digest names (at most 256) and a sign of 1 or -1."""
    digest = F.md5(token)
    at = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % dimensions
    return F.struct(at.alias("d"), F.when(F.substring(digest, 3, 1) < "8", 1).otherwise(-1).alias("g"))


def signed_vector(tokens: Column, dimensions: int = 16) -> Column:
    """Feature hashing of a token array: each token adds its sign in its dimension (at most 256).

    Needs no vocabulary, and md5 gives the same vector in any SQL engine. A token becomes one
    character that names its cell, and a cell's tokens are the characters of its kind, so the work
    per token is a digest and not a step in every dimension.
    """
    digits = "0123456789abcdef"
    names = "".join(chr(33 + i) for i in range(2 * dimensions))

    def cell(digest: Column) -> Column:
        second, third = [F.instr(F.lit(digits), F.substring(digest, i, 1)) - 1 for i in (2, 3)]
        at = second
        if dimensions != 16:  # the first digit counts sixteens
            at = ((F.instr(F.lit(digits), F.substring(digest, 1, 1)) - 1) * 16 + second) % dimensions
        return F.substr(F.lit(names), at + F.when(third < 8, 1).otherwise(1 + dimensions), F.lit(1))

    def number(cells: Column, i: int) -> Column:
        return F.length(cells) - F.length(F.replace(cells, F.lit(names[i]), F.lit("")))

    def vector(cells: Column) -> Column:
        return F.array(*[number(cells, d) - number(cells, dimensions + d) for d in range(dimensions)])

    named = F.array_join(F.transform(F.transform(tokens, F.md5), cell), "")
    return F.when(tokens.isNotNull(), F.get(F.transform(F.array(named), vector), F.lit(0)))
