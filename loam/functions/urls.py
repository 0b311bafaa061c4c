"""URL expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host, no query or fragment, no slash at the end; null where blank."""
    c = F.regexp_replace(F.trim(c), r"[?#].*$", "")
    head, tail = F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)?(.*)$", 1), F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)?(.*)$", 2)
    return F.when(c != "", F.concat(F.lower(head), F.regexp_replace(tail, "/+$", "")))


def reference_tags(c: Column) -> Column:
    """Tags that the words of a link give."""
    low = F.lower(c)
    return F.filter(F.array(F.when(F.regexp_like(low, F.lit("patch|commit|advisory|release")), F.lit("patch")), F.when(F.regexp_like(low, F.lit("exploit|poc|metasploit")), F.lit("exploit"))), lambda x: x.isNotNull())
