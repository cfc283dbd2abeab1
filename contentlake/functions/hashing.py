"""Identities: hashes of guids and contents, and times of sortable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the digits of sortable ids, base 32 without I, L, O and U.
DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
NUL = "\0"


def guid_hash(feed: Column, guid: Column) -> Column:
    """sha256 of feed, NUL, guid."""
    return F.sha2(F.concat(feed, F.lit(NUL), guid), 256)


def content_hash(*parts: Column) -> Column:
    """sha256 of the parts, each trimmed, case folded and ended by NUL; null parts are empty."""
    folded = [F.replace(F.lower(F.trim(F.coalesce(p, F.lit("")))), F.lit("ß"), F.lit("ss")) for p in parts]
    return F.sha2(F.concat(*(x for p in folded for x in (p, F.lit(NUL)))), 256)


def stable_guid(guid: Column, url: Column, *content: Column) -> Column:
    """The first that is not empty: guid, url, hash of the content."""
    return F.coalesce(F.nullif(F.trim(guid), F.lit("")), F.nullif(url, F.lit("")), content_hash(*content))


def id_time_ms(ulid: Column) -> Column:
    """The milliseconds in the first ten digits of a sortable id."""
    digits = F.split(F.substring(F.upper(ulid), 1, 10), "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda total, d: total * 32 + F.position(d, F.lit(DIGITS)).cast("long") - 1)


def id_of(ms: Column, random: Column) -> Column:
    """A sortable id: ten digits of time, sixteen from a hexadecimal hash."""
    time = F.concat(*(F.substring(F.lit(DIGITS), (F.shiftrightunsigned(ms, 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(9, -1, -1)))
    return F.concat(time, F.upper(F.substring(random, 1, 16)))


def asset_name(url: Column) -> Column:
    """The name of an image in an export: the start of its address's sha1."""
    return F.substring(F.sha1(url), 1, 16)
