"""Repairs of a reply, gated on its source; columns in, a column out. They run in one fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkledger.functions.text import HAN, number_tokens


def _replace_first(text: Column, old: Column, new: Column) -> Column:
    """The first occurrence only."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def _shape(number: Column) -> Column:
    """Digits before and after the point."""
    return F.concat_ws(".", F.length(F.regexp_extract(number, r"^[0-9,]+", 0)).cast("string"), F.length(F.regexp_extract(number, r"\.([0-9]+)$", 1)).cast("string"))


def _spare(own: Column, others: Column) -> Column:
    """The tokens of ``own`` that ``others`` has not as often, in order."""
    return F.filter(own, lambda x, i: F.size(F.filter(F.slice(own, 1, i + 1), lambda y: y == x)) > F.size(F.filter(others, lambda y: y == x)))


def numbers(source: Column, reply: Column) -> Column:
    """Each number of the source that is missing takes the place of the first spare one of its shape."""
    missing = _spare(number_tokens(source), number_tokens(reply))

    def put(text: Column, number: Column) -> Column:
        spare = F.filter(_spare(number_tokens(text), number_tokens(source)), lambda x: _shape(x) == _shape(number))
        return F.when(F.size(spare) > 0, _replace_first(text, F.get(spare, F.lit(0)), number)).otherwise(text)

    return F.aggregate(missing, reply, put)


def repeated_words(source: Column, reply: Column) -> Column:
    twice = r"(?<![A-Za-z])([A-Za-z]{2,}) \1(?![A-Za-z])"
    return F.when(source.rlike(twice), reply).otherwise(F.regexp_replace(reply, twice, "$1"))


def cjk_spaces(reply: Column) -> Column:
    return F.regexp_replace(reply, f"(?<={HAN}) +(?={HAN})", "")


def sentence_end(source: Column, reply: Column) -> Column:
    """A run of stops becomes the last of them, unless the source ends in one."""
    return F.when(source.rlike(r"[.!?]{2,}\s*$"), reply).otherwise(F.regexp_replace(reply, r"[。.!?！？]+([。.!?！？])$", "$1"))


def glosses(source: Column, reply: Column) -> Column:
    """English in brackets after Han goes, if the source has no such brackets."""
    gloss = rf"(?<={HAN}) ?[(（][A-Za-z][A-Za-z ,.'-]*[)）]"
    return F.when(source.rlike(r"[(（]"), reply).otherwise(F.regexp_replace(reply, gloss, ""))


def repair(source: Column, reply: Column) -> Column:
    reply = numbers(source, reply)
    reply = repeated_words(source, reply)
    reply = glosses(source, reply)
    reply = cjk_spaces(reply)
    return sentence_end(source, reply)
