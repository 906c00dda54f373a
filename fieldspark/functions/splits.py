"""Deterministic split assignment from content or group hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldspark.functions.geo import col


def sha1_position(salt: str, key) -> Column:
    """First 32 bits of sha1(salt/key) on [0, 1]."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(salt + "/"), col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967295.0


def split_sha1(salt: str, key) -> Column:
    p = sha1_position(salt, key)
    return F.when(p < 0.10, "test").when(p < 0.25, "val").otherwise("train")


def sha256_position(salt: str, group) -> Column:
    """First 64 bits, big endian, of sha256(salt NUL group) on [0, 1)."""
    digest = F.sha2(F.concat(F.lit(salt), F.lit("\x00"), col(group).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(2**64)


def split_sha256(salt: str, group, pinned: list[str] = (), train: float = 0.70, validation: float = 0.15) -> Column:
    p = sha256_position(salt, group)
    hashed = F.when(p < train, "train").when(p < train + validation, "validation").otherwise("test")
    return F.when(col(group).isin(*pinned), "test").otherwise(hashed) if pinned else hashed


def sha1_mod(salt: str, digest, modulus: int = 10_000) -> Column:
    """The whole 160-bit sha1 value modulo ``modulus``, digit group by digit group."""
    text = F.sha1(F.concat(F.lit(salt + "/"), col(digest).cast("string")))
    groups = F.transform(F.sequence(F.lit(0), F.lit(4)),
                         lambda i: F.conv(F.substring(text, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.aggregate(groups, F.lit(0).cast("long"), lambda acc, g: (acc * (2**32 % modulus) + g) % modulus)


def split_mod(salt: str, digest, ratios: dict[str, float]) -> Column:
    total = float(sum(ratios.values()))
    if total <= 0:
        raise ValueError("split ratios must sum to more than zero")
    position, names, edge, out = sha1_mod(salt, digest), list(ratios), 0.0, None
    for name in names:
        edge += ratios[name] / total * 10_000
        out = F.when(position < edge, name) if out is None else out.when(position < edge, name)
    return out.otherwise(names[-1])
