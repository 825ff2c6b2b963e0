"""Content fingerprints."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(c: Column) -> Column:
    """``sha256:`` and 16 hexadecimal digits of the text or bytes."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(c, 256), 1, 16))


def head_hash(c: Column, size: int = 65536) -> Column:
    """SHA-256 of the first bytes of a binary column."""
    return F.sha2(F.substring(c, 1, size), 256)


def url_hash(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 8)
