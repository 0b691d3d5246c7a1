"""Predefined character maps of composite fonts: how bytes part into codes, and what characters these are."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass

# Names of the maps (without the writing direction), their encodings, and lead bytes of codes of two.
_UNICODE = {"UCS2": ("utf-16-be", 2), "UTF16": ("utf-16-be", 2), "UTF32": ("utf-32-be", 4)}
_HIGH, _SHIFTED = rb"[\x81-\xfe]", rb"[\x81-\x9f\xe0-\xfc]"
_LEGACY = {
    "GBK-EUC": ("gbk", _HIGH), "GBKp-EUC": ("gbk", _HIGH), "GBK2K": ("gb18030", _HIGH), "GB-EUC": ("gbk", rb"[\xa1-\xfe]"), "GBpc-EUC": ("gbk", rb"[\xa1-\xfe]"),
    "90ms-RKSJ": ("cp932", _SHIFTED), "90msp-RKSJ": ("cp932", _SHIFTED), "90pv-RKSJ": ("cp932", _SHIFTED), "Add-RKSJ": ("cp932", _SHIFTED), "Ext-RKSJ": ("cp932", _SHIFTED),
    "KSCms-UHC": ("cp949", _HIGH), "KSCms-UHC-HW": ("cp949", _HIGH), "KSCpc-EUC": ("cp949", _HIGH),
    "ETen-B5": ("big5hkscs", _HIGH), "ETenms-B5": ("big5hkscs", _HIGH), "B5pc": ("big5hkscs", _HIGH), "HKscs-B5": ("big5hkscs", _HIGH),
    "EUC": ("euc_jp", rb"[\x8e\xa1-\xfe]"),
}


@dataclass(frozen=True)
class Predefined:
    codec: str
    vertical: bool
    pattern: re.Pattern

    def codes(self, text: bytes) -> Iterator[bytes]:
        """The codes of a string; what is too short for one is a code of a byte."""
        return (m.group() for m in self.pattern.finditer(text))

    def unicode(self, code: bytes) -> str | None:
        """The character of a code; null if it is none."""
        try:
            return codecs.decode(code, self.codec) or None
        except UnicodeDecodeError:
            return None


def predefined(name: str | None) -> Predefined | None:
    """The map of a name such as ``GBK-EUC-H`` or ``UniJIS-UTF16-V``; null if it isn't known."""
    base, vertical = re.sub("-[HV]$", "", name or ""), (name or "").endswith("-V")
    if m := re.fullmatch("Uni(?:GB|JIS|KS|CNS)-(UCS2|UTF16|UTF32)", base):
        codec, size = _UNICODE[m[1]]
        return Predefined(codec, vertical, re.compile(b"(?s).{%d}|." % size))
    if base not in _LEGACY:
        return None
    codec, lead = _LEGACY[base]
    triple = rb"\x8f..|" if codec == "euc_jp" else b""
    return Predefined(codec, vertical, re.compile(b"(?s)" + triple + lead + b".|."))
