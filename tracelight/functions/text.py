"""Text helpers: decoding, redaction, hashing, marker extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelight.functions.values import dash_to_null

# Markers whose following value is hidden, applied in this order.
SECRET_MARKERS = [
    "authorization:", "authorization=", "bearer ", "apikey:", "apikey=", "api_key=", "x-api-key:", "x-api-key=",
    "cookie:", "cookie=", "password:", "password=", "passwd:", "passwd=", "pwd=", "token:", "token=",
    "access_token=", "refresh_token=", "session=", "sessionid=", "jwt=", "privatekey=", "client_secret=",
    "secret=", "connectionstring=", "connection_string=",
]
_ANY_MARKER = "(?i)" + "|".join(re.escape(m) for m in SECRET_MARKERS)


def redact(value: Column) -> Column:
    """Replace the value after each secret marker with ``<redacted>``."""
    hidden = value
    for marker in SECRET_MARKERS:
        hidden = F.regexp_replace(hidden, rf"(?i)({re.escape(marker)}[ \t]*+)[^&;,\"'\r\n ]+", "$1<redacted>")
    return F.when(value.rlike(_ANY_MARKER), hidden).otherwise(value)


def percent_decode(value: Column) -> Column:
    """Decode ``%XX`` once; malformed sequences stay as written and ``+`` is literal."""
    protected = F.regexp_replace(value, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(value.contains("%"), F.url_decode(F.replace(protected, F.lit("+"), F.lit("%2B")))).otherwise(value)


def form_decoded_lower(value: Column) -> Column:
    """Lower-cased view with ``+`` as space and one percent-decode, as used by ``contains``."""
    return percent_decode(F.replace(F.lower(value), F.lit("+"), F.lit(" ")))


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def uri_path(uri: Column) -> Column:
    return dash_to_null(F.substring_index(uri, "?", 1))


def uri_query(uri: Column) -> Column:
    query = F.when(uri.contains("?"), F.regexp_extract(uri, r"(?s)^[^?]*\?(.*)$", 1))
    return F.when(query != "", query)


def path_segments(decoded: Column) -> Column:
    """Segments after resolving ``.``, ``..`` and empty ones."""

    def push(stack: Column, segment: Column) -> Column:
        return (
            F.when(segment.isin("", "."), stack)
            .when(segment == "..", F.when(F.size(stack) > 0, F.slice(stack, 1, F.size(stack) - 1)).otherwise(stack))
            .otherwise(F.concat(stack, F.array(segment)))
        )

    return F.aggregate(F.split(decoded, "/"), F.array().cast("array<string>"), push)


_PLAIN_PATH = r"^(/[^/.%][^/%]*)+$"


def normalise_path(path: Column) -> Column:
    """Absolute form used to compare request paths: decoded once, dot segments and slashes resolved."""
    resolved = F.concat(F.lit("/"), F.array_join(path_segments(percent_decode(F.trim(path))), "/"))
    return F.when(path.rlike(_PLAIN_PATH) & ~path.rlike(r"\s$"), path).otherwise(resolved)


def normalise_allow_path(path: Column) -> Column:
    """Form used by allowlists: as above, but a relative path stays relative."""
    decoded = percent_decode(path)
    lead = F.when(decoded.startswith("/"), "/").otherwise("")
    resolved = F.concat(lead, F.array_join(path_segments(decoded), "/"))
    return F.when(path.rlike(_PLAIN_PATH), path).otherwise(resolved)


def single_quoted_after(value: Column, marker: str) -> Column:
    """Text of the first ``'…'`` after a marker, NULL when absent."""
    return _extract(value, rf"(?is)^.*?{re.escape(marker)}[^']*'([^']*)'")


def double_quoted_after(value: Column, marker: str) -> Column:
    return _extract(value, rf'(?is)^.*?{re.escape(marker)}[^"]*"([^"]*)"')


def _extract(value: Column, pattern: str) -> Column:
    return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, 1))


def extract(value: Column, pattern: str, group: int = 1) -> Column:
    """A capture group, NULL when the pattern does not match."""
    return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, group))


def domain_host(value: Column) -> Column:
    """Lower-cased host without port or trailing dots."""
    return F.lower(F.substring_index(F.rtrim(F.trim(value), F.lit(".")), ":", 1))
