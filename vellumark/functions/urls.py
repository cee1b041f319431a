"""Address normal forms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumark.functions.text import text

# Query parameters that only track the reader.
TRACKING = "^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid)(=|$)"
_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(c: Column, i: int) -> Column:
    return F.regexp_extract(c, _PARTS, i)


def normal_url(c: Column | str) -> Column:
    """Scheme and host in lower case, single slashes, no fragment and no slash at the end; the query stays.

    A text without scheme and host is folded and loses its last slashes.
    """
    u = F.trim(text(c))
    full = u.rlike(_PARTS) & (_part(u, 2) != "")
    path = F.regexp_replace(F.regexp_replace(_part(u, 3), "/+", "/"), "/$", "")
    return F.when(full, F.concat(F.lower(_part(u, 1)), F.lit("://"), F.lower(_part(u, 2)), path, _part(u, 4))).otherwise(F.regexp_replace(F.lower(u), "/+$", ""))


def unwrap_archive(c: Column | str) -> Column:
    """The archived address inside an archive's address, or the address itself."""
    inner = F.regexp_extract(text(c), r"(?i)^https?://[^/]+/web/[0-9]+[a-z_]*/(.+)$", 1)
    return F.when(inner != "", inner).otherwise(text(c))


def source_url(c: Column | str) -> Column:
    """host/path?query of the page that an address names, whatever archive, scheme, port, www or tracking it has.

    The query's parts are sorted. A missing address gives ''.
    """
    u = F.trim(unwrap_archive(F.trim(text(c))))
    u = F.when(u == "", u).when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(_part(u, 2)), "^[^@]*@", ""), ":[0-9]*$", ""), r"^www\.", "")
    path = F.regexp_replace(_part(u, 3), "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    kept = F.filter(F.split(F.regexp_replace(_part(u, 4), r"^\?", ""), "&"), lambda q: (q != "") & ~q.rlike(TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    return F.when(u == "", F.lit("")).otherwise(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def source_family(c: Column | str) -> Column:
    """The host of the page that an address names; '' where there is none."""
    return F.split_part(source_url(c), F.lit("/"), F.lit(1))


def archive_date(c: Column | str) -> Column:
    """The day an archive captured an address, from the first eight digits of its time stamp; null without a valid one."""
    digits = F.regexp_extract(text(c), r"(?i)^https?://[^/]+/web/([0-9]{8})[0-9]*", 1)
    return F.when(digits != "", F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date"))


def safe_url(c: Column | str) -> Column:
    """Whether an address is https with a host, and has no user, other port, fragment, backslash, blank or control character."""
    u = text(c)
    authority = _part(u, 2)
    return (
        u.rlike(_PARTS)
        & (F.lower(_part(u, 1)) == "https")
        & authority.rlike(r"^[^@:]+(:443)?$")
        & (_part(u, 5) == "")
        & ~u.rlike(r"[\x00-\x20\x7f\\]")
    )
