"""Classes of failed calls and of failed documents, from their messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status codes and wordings of each class.
REFUSED_CODES = ("401", "402", "403", "404", "410")
ACCOUNT = ("access denied", "overdue", "arrears", "insufficient balance", "insufficient_quota", "quota exceeded", "invalid api key", "invalid_api_key", "unauthorized", "forbidden", "account disabled", "suspended", "billing", "daily limit exceeded", "resource_exhausted")
TRANSIENT_CODES = ("408", "409", "429")
RETRIED_CODES = ("400", "409", "429", "500", "502", "503", "504")
DROPPED = ("io:", "unexpected end of file", "connection reset", "connection aborted", "peer disconnected", "incomplete message")
RECOVERABLE = ("timeout", "omitted segment", "invalid translation json", "did not contain a json", "no translations array", "missing id", "missing text", "placeholder was not preserved", "empty message.content", "reply too long", "http status 500", "http status 502", "http status 503", "http status 429")


def _any(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(n) for n in needles))


def refused(message: Column) -> Column:
    """The service said no for a reason that asking again doesn't change: the code says so, or an account's trouble is named."""
    low = F.lower(message)
    return _any(low, tuple(f"http status {c}" for c in REFUSED_CODES)) | (low.contains("http status") & _any(low, ACCOUNT))


def client_error(message: Column) -> Column:
    """A 4xx that isn't transient; the first status of the message counts."""
    code = F.regexp_extract(F.lower(message), "http status (4.{0,2})", 1)
    return (code != "") & ~code.isin(*TRANSIENT_CODES)


def dropped(message: Column) -> Column:
    """The connection broke."""
    return _any(F.lower(message), DROPPED)


def retryable(message: Column) -> Column:
    """The same request may be sent again."""
    status = _any(message, tuple(f"HTTP status {c}" for c in RETRIED_CODES))
    return ~refused(message) & (status | dropped(message) | F.lower(message).contains("timeout"))


def recoverable(message: Column) -> Column:
    """A smaller batch may do better."""
    return _any(F.lower(message), RECOVERABLE) | dropped(message)


def gateway_class(message: Column) -> Column:
    """refused, retry, client, or fail; the first that fits."""
    return F.when(refused(message), "refused").when(retryable(message), "retry").when(client_error(message), "client").otherwise("fail")


def document_class(message: Column) -> Column:
    """Why a document could not be read."""
    low = F.lower(message)
    return (
        F.when(low.contains("panic"), "panic")
        .when(_any(low, ("encrypt", "password")), "encrypted")
        .when(_any(low, ("xref", "trailer")), "xref-or-trailer")
        .when(_any(low, ("flate", "decompress", "filter")), "stream-filter")
        .when(_any(low, ("io error", "os error")), "io")
        .otherwise("parse")
    )
