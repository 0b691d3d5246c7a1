"""Token, number and sentence functions on text columns; all run in the JVM.

Two token grammars are kept apart: ``SHIELD`` protects tokens in text that is
sent out, ``SCORED`` finds the tokens that a fidelity score looks for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkledger.functions import words as wd

# The patterns of protected tokens. Possessive quantifiers stand for scanners that never step back.
PLACEHOLDER = r"⟦[0-9]+⟧"
URL = r'(?:https?://|www\.)[^ \t\r\n\f<>"]*[^ \t\r\n\f<>".,;:)\]]'
EMAIL = r"(?<![A-Za-z0-9_])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++(?<=\.[A-Za-z]{2,63})"
BRACES = r"\{[^{}\n]+\}"
NUMBER = r"(?<![A-Za-z0-9_])[0-9]++(?:\.[0-9]++)?+(?![A-Za-z0-9_])"
NUMERIC_CITATION = r"[\[［] ?[0-9]{1,4}(?: ?[,;\-–—] ?[0-9]{1,4})*+ ?[\]］]"
_NAME = r"[A-Z][A-Za-z'’\-]+"
_YEAR = r"(?:19|20)[0-9]{2}[a-z]?"
NARRATIVE_CITATION = rf"(?<![A-Za-z0-9_])(?!(?:Figure|Fig|Table|Tab|Section|Equation|Eq|Chapter|Appendix|Algorithm|Theorem|Lemma|Page|Volume|Vol|The|This|That|For|With|From|Using|See)(?![A-Za-z])){_NAME}(?: et al\.?| (?:and|&) {_NAME})? \({_YEAR}(?:, pp?\. ?[0-9–-]+)?\)"
#: Words in lower case that a citation in brackets may hold.
CITATION_WORDS = ("and", "with", "from", "und", "von", "van", "de", "del", "der", "di", "la", "le", "da", "dos", "das", "et", "al")
_CHUNK = rf"(?:(?:e\.g\.,?|cf\.|see|ibid\.) )?{_NAME}(?:,? (?:{'|'.join(CITATION_WORDS)}|al\.|&|[A-Z]\.|{_NAME}),?)*,? {_YEAR}"
WRAPPED_CITATION = rf"(?:\({_CHUNK}(?:; ?{_CHUNK})*\)|\[{_CHUNK}(?:; ?{_CHUNK})*\])"
#: The kinds in the order in which they are tried at a place.
KINDS = {"placeholder": PLACEHOLDER, "url": URL, "email": EMAIL, "braces": BRACES, "citation": f"{NUMERIC_CITATION}|{WRAPPED_CITATION}|{NARRATIVE_CITATION}", "number": NUMBER}
SHIELD = "|".join(f"(?:{p})" for p in KINDS.values())
SHIELD_KEEPING_NUMBERS = "|".join(f"(?:{p})" for k, p in KINDS.items() if k != "number")

SCORED_URL = r"https?://[^ \t\r\n\f]*[^ \t\r\n\f.,;)]"
SCORED_EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9._%+-]++(?<=\.[A-Za-z]{2,63})"
SCORED_NUMBER = r"(?<![A-Za-z0-9])[0-9]++(?:\.[0-9]++)?+(?![A-Za-z0-9])"
SCORED_TOKENS = f"{PLACEHOLDER}|{SCORED_URL}|{SCORED_EMAIL}|{BRACES}|{KINDS['citation']}|{SCORED_NUMBER}"

# The same without look-around; words with a letter are matched too, so that no number is found inside one.
_ADDRESS = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9._%+-]++"
_WORD = r"[0-9]+\.[0-9]+[A-Za-z][A-Za-z0-9]*|[0-9]*[A-Za-z][A-Za-z0-9]*"
WHOLE_TOKENS = f"{PLACEHOLDER}|{SCORED_URL}|{_ADDRESS}|{BRACES}|{NUMERIC_CITATION}|{_WORD}|" + r"[0-9]+(?:\.[0-9]+)?"

#: Substrings that make a text prompt-like, each counted once.
PROMPT_CUES = ("you are ", "you must", "your task", "respond with", "reply with", "answer yes", "answer no", "return json", "output format", "do not ", "instructions:", "## ", "{{", '"evidence"', "</", "step 1")
#: Words before a stop that ends no sentence.
ABBREVIATIONS = ("al", "etc", "eg", "ie", "fig", "eq", "dr", "mr", "mrs", "ms", "vs", "cf", "vol", "pp", "no", "approx", "st", "jr", "sr", "prof", "inc", "ltd")
#: Ranges of three Han and CJK classes.
CJK_WIDE, CJK_SCORE, HAN = r"[\x{3000}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]", r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]", r"[\x{3400}-\x{9FFF}]"


def _text(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def found(text: Column | str, pattern: str) -> Column:
    """All tokens that a pattern finds, in order."""
    return F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(0))


def scored_tokens(text: Column | str) -> Column:
    """The tokens that a fidelity score looks for."""
    return found(text, SCORED_TOKENS)


def plain_scored_tokens(text: Column | str) -> Column:
    """As ``scored_tokens``, but by a scanner that takes what looks like an address, and words with a letter, as a whole, and knows no authors.

    So nothing is found inside an address that turns out to be none, or inside a word.
    """
    whole = F.filter(found(text, WHOLE_TOKENS), lambda t: ~t.rlike(f"^(?:{_WORD})$"))
    return F.filter(whole, lambda t: ~t.rlike(f"^(?:{_ADDRESS})$") | t.rlike(r"\.[A-Za-z]{2,63}$"))


def kind_of(token: Column | str) -> Column:
    """Which kind of protected token a token is."""
    t, out = _text(token), F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        # A token alone has no neighbours, so the boundaries hold.
        out = F.when(t.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _term(term: str) -> str:
    """A glossary term; where it ends in a letter or digit, no other may touch it."""
    word = re.compile("[A-Za-z0-9_]")
    return ("(?<![A-Za-z0-9_])" if word.match(term[0]) else "") + r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E" + ("(?![A-Za-z0-9_])" if word.match(term[-1]) else "")


def shield(text: Column | str, keep_numbers: bool = False, glossary: dict[str, str] | None = None) -> tuple[Column, Column]:
    """The text with ``⟦k⟧`` for the k-th protected token, and the slots: those tokens, or what the glossary has for a term."""
    pattern = SHIELD_KEEPING_NUMBERS if keep_numbers else SHIELD
    terms = sorted(filter(None, glossary or {}), key=lambda t: (-len(t.encode()), t))
    if terms:
        pattern = "|".join([pattern, *map(_term, terms)])
    slots = found(text, pattern)
    if terms:
        known = F.create_map(*[F.lit(x) for t in terms for x in (t, glossary[t])])
        slots = F.transform(slots, lambda t: F.coalesce(F.try_element_at(known, t), t))
    parts = F.split(_text(text), pattern, -1)
    marks = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("⟦"), (i - 1).cast("string"), F.lit("⟧"), p)))
    return F.array_join(marks, ""), slots


def verbatim_spans(text: Column | str) -> Column:
    """Where the protected tokens of a text are, [start, end) in characters: they stay on one line."""
    t = _text(text)
    gaps, tokens = F.split(t, SHIELD, -1), found(t, SHIELD)
    # The gap before each token, and the tokens before it.
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + F.length(x["gap"])
        b = a + F.length(x["token"])
        return F.struct(b.alias("at"), F.concat(s["spans"], F.array(F.struct(a.alias("start"), b.alias("end")))).alias("spans"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(tokens)), tokens, lambda g, x: F.struct(g.alias("gap"), x.alias("token")))
    return F.aggregate(pairs, start, step, lambda s: s["spans"])


def citation_end(text: Column | str, start: Column) -> Column:
    """The end of the citation that starts at a character; null if none does."""
    rest = F.substring(_text(text), start + 1, F.length(_text(text)))
    found_ = F.regexp_extract(rest, f"^(?:{KINDS['citation']})", 0)
    return F.when(found_ != "", start + F.length(found_))


def restore(text: Column | str, slots: Column | str) -> Column:
    """The text with slots put back; null if a placeholder is unknown or a slot unused."""
    t, s = _text(text), _text(slots)
    used = F.transform(F.regexp_extract_all(t, F.lit("⟦([0-9]+)⟧"), F.lit(1)), lambda n: n.cast("int"))
    parts = F.split(t, PLACEHOLDER, -1)
    whole = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.get(s, F.get(used, i - 1)), F.lit("")), p))), "")
    known = F.forall(used, lambda n: n.isNotNull() & (n < F.size(s)))
    all_used = F.size(F.array_distinct(used)) == F.size(s)
    return F.when(known & all_used, whole)


def restored(text: Column | str, slots: Column | str) -> Column:
    """As ``restore``, but a reply that has every slot literally is taken as it is."""
    t = _text(text)
    return F.coalesce(restore(t, slots), F.when(F.forall(_text(slots), lambda s: t.contains(s)), t))


def squash(text: Column | str) -> Column:
    return F.regexp_replace(_text(text), r"[ \t\r\n\f\x0b]+", "")


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_text(text), r"[ \t\r\n\f\x0b]+", " "))


def fold_ligatures(text: Column | str) -> Column:
    out = _text(text)
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def latin_letters(text: Column | str) -> Column:
    return F.length(F.regexp_replace(_text(text), "[^A-Za-z]", ""))


def cjk_count(text: Column | str, kind: str = CJK_WIDE) -> Column:
    return F.length(_text(text)) - F.length(F.regexp_replace(_text(text), kind, ""))


def number_tokens(text: Column | str) -> Column:
    """Digit runs joined by a point and digits, or a comma and exactly three; not inside placeholders."""
    return F.regexp_extract_all(F.regexp_replace(_text(text), PLACEHOLDER, " "), F.lit(r"[0-9]+(?:\.[0-9]+|,[0-9]{3}(?![0-9]))*"), F.lit(0))


def lost_numbers(source: Column | str, reply: Column | str) -> Column:
    """Numbers of the source that the reply has not, or not as often."""
    a, b = number_tokens(source), number_tokens(reply)
    many = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.array_sort(F.filter(F.array_distinct(a), lambda x: many(a, x) > many(b, x)))


def split_sentences(text: Column | str) -> Column:
    """Sentences with the white space after them: joined, they are the text.

    A sentence ends after a stop, closing quotes and spaces, before an ASCII capital; not after one letter or
    an abbreviation. Ends are marked going forward, and those after an abbreviation are unmarked again.
    """
    mark, words = "\x01\x1f\x01", "|".join(ABBREVIATIONS)
    after = r"[\"'”’)\]]{0,3}[ \t\r\n]{0,64}"
    marked = F.regexp_replace(_text(text), rf"([.?!]{after})(?=[A-Z])", f"$1{mark}")
    marked = F.regexp_replace(marked, rf"(?<![A-Za-z])((?i:[A-Za-z]|{words})\.{after}){mark}", "$1")
    return F.filter(F.split(marked, mark, -1), lambda s: s != "")


def prompt_score(text: Column | str) -> Column:
    """How many cues of a prompt a text has; prompt-like from 2."""
    low = F.lower(_text(text))
    score = sum((F.when(low.contains(cue), 1).otherwise(0) for cue in PROMPT_CUES), F.lit(0))
    words = F.transform(F.split(_text(text), r"[ \t\r\n\f\x0b]+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))
    return score + F.when(F.exists(words, lambda w: (F.length(w) - F.length(F.replace(w, F.lit("_"), F.lit(""))) >= 2) & (F.octet_length(w) > 8)), 1).otherwise(0)


def prefilled(text: Column | str) -> Column:
    """Segments that need no translator: blank, without a letter or digit, addresses only, or a label of a formula."""
    t = _text(text)
    return (F.trim(t) == "") | ~t.rlike(r"[\p{L}\p{N}]") | wd.addresses_only(t) | wd.is_annotation(t)


def choose_saved(a: Column, b: Column, source: Column) -> Column:
    """Which of two saved renderings holds; null if two differ and neither echoes the source."""
    short = (F.length(source) <= 48) & ~source.contains(". ") & (F.size(F.split(source, r"\s+")) <= 6)
    echo_a, echo_b = a == source, b == source
    return F.when(a == b, a).when(echo_a | echo_b, F.when(short, source).when(echo_a, b).otherwise(a))


def space_cjk_latin(text: Column | str) -> Column:
    """A space between CJK and Latin letters or digits that touch."""
    t = F.regexp_replace(_text(text), rf"({CJK_SCORE})([A-Za-z0-9])", "$1 $2")
    return F.regexp_replace(t, rf"([A-Za-z0-9])({CJK_SCORE})", "$1 $2")
