"""Words and lines that are kept as they are: names, code, references, formulas, addresses.

All are conditions on columns. A line is cut into its words once; a rule about
words is a test of each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no names, words of organisations and institutions, small words of titles.
FUNCTION_WORDS = (
    "the", "of", "and", "for", "with", "from", "to", "by", "on", "in", "a", "an", "or", "as", "at", "how", "got", "why", "what", "when", "where", "which", "who",
    "testing", "practical", "software", "engineering", "consultant", "versus", "theorem", "summary", "log", "executive", "change", "contents", "introduction",
    "treasure", "hunt", "first", "aid", "global", "switch", "day", "your", "business", "interests", "illusion", "references", "appendix", "abstract", "overview", "chapter", "section",
    "challenge", "type", "overly", "specific", "complex", "aspects", "computer", "science", "quantitative", "biology", "finance", "trigger", "optimization", "context", "method", "verified",
)
ORGANISATIONS = ("co", "inc", "ltd", "llc", "corp", "company", "press", "publications", "publishing", "university", "institute", "group", "labs", "lab", "department", "division", "office", "bureau", "committee", "association", "society", "services", "headquarters", "dept")
INSTITUTIONS = (
    "university", "universite", "institute", "institution", "laboratory", "laboratories", "college", "polytechnic", "google", "microsoft", "facebook", "meta", "deepmind", "openai", "nvidia", "ibm", "adobe", "amazon", "apple", "baidu", "tencent", "alibaba", "huawei",
    "samsung", "intel", "qualcomm", "oracle", "salesforce", "bytedance", "sensetime", "stanford", "berkeley", "oxford", "cambridge", "mit", "cmu", "eth", "epfl", "inria", "research", "labs", "lab",
)
CONNECTORS = ("of", "for", "and", "the", "de", "la", "at", "in", "on", "&", "und", "et")
SENTENCE_WORDS = ("the", "and", "of", "to", "a", "in", "is", "for", "that", "with", "we", "as", "on", "by", "or", "from", "are", "be", "this", "it", "let", "since", "whenever", "then", "where", "if", "when")
LEADS = ("let", "since", "whenever", "and", "where", "then", "if")
TITLE_SMALL = ("a", "an", "the", "and", "or", "of", "in", "on", "with", "vs.", "vs", "to", "for", "at")
#: Letters of names beyond ASCII, and the marks of affiliations.
ACCENTED = r"\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"
MARKS = "*∗†‡§¶⋆"

_SPACE = r"[ \t\r\n\f\x0b]+"


def let(value: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule`` of a value that is worked out once, however often the rule names it."""
    return F.get(F.transform(F.array(value), lambda v: rule(v)), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


def _bare(word: Column) -> Column:
    """Lower-cased, without what isn't a letter at its ends."""
    return F.lower(F.regexp_replace(word, "^[^A-Za-z]+|[^A-Za-z]+$", ""))


def is_email(word: Column) -> Column:
    """An address; marks around it don't count, and ``a@k`` has no domain."""
    return F.btrim(word, F.lit("()<>[],;:\"'.")).rlike(r"(?s)^.+@[A-Za-z0-9._-]+\.[A-Za-z]{2,}$")


def is_address(word: Column) -> Column:
    return word.contains("://") | word.startswith("www.") | is_email(word)


def bare_address(word: Column) -> Column:
    """A URL that goes on after its start, or an e-mail address of plain letters with no marks around it."""
    return word.rlike(r"^(?:(?:https?://|www\.)[^ ]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})\z")


def addresses_only(text: Column, bare: bool = False) -> Column:
    """At least one word, and each a URL or an e-mail address; with ``bare``, marks around one aren't set aside."""
    ws = words(text)
    return (F.size(ws) > 0) & F.forall(ws, bare_address if bare else lambda w: w.rlike(r"^(?:https?://|www\.)") | is_email(w))


def is_acronym(word: Column) -> Column:
    return F.regexp_replace(word, "[^A-Za-z]", "").rlike("^[A-Z]{1,5}$")


def is_file_name(word: Column) -> Column:
    w = F.btrim(word, F.lit("(),;:"))
    return w.rlike(r"\.[a-z0-9]{2,4}$") & (F.length(F.regexp_replace(F.regexp_extract(w, r"(?s)^(.*)\.[a-z0-9]{2,4}$", 1), "[^A-Za-z0-9]", "")) >= 2)


def is_function_word(word: Column) -> Column:
    return F.lower(word).isin(*FUNCTION_WORDS)


def prose_word(token: Column) -> Column:
    """The word of a token in lower case; null if it is none: a name with capitals inside, a number, an acronym."""
    core = F.btrim(token, F.lit(",.;:)(\"'“”—-"))
    plain = F.regexp_replace(core, "[^A-Za-z]", "")
    fine = core.rlike("^[A-Za-z'-]+$") & ~(core.contains("-") & core.rlike("[A-Z]")) & (F.length(plain) >= 3) & plain.rlike("[a-z]") & ~plain.rlike("[a-z][A-Z]")
    return F.when(core == "", F.lit(None)).when(is_function_word(core), F.lower(core)).when(fine, F.lower(plain))


def _name_token(token: Column, longest: int) -> Column:
    upper = rf"(?:[A-Z]|[{ACCENTED}&&\p{{Lu}}])"
    shape = rf"^{upper}$|^{upper}(?=.*(?:[a-z]|[{ACCENTED}&&\p{{Ll}}]))(?:[A-Za-z{ACCENTED}&&\p{{L}}]|['-])+$"
    # Two parts of six letters or more are a title's compound.
    compound = "^(?:[^A-Za-z-]*[A-Za-z]){6}[^-]*-(?:[^A-Za-z]*[A-Za-z]){6}"
    return let(F.btrim(token, F.lit(",.")), lambda t: t.rlike(shape) & ~F.lower(t).isin(*ORGANISATIONS) & ~t.rlike(compound)) & ~is_function_word(token) & (letters(token) <= longest)


def _named(text: Column, most: int, longest: int) -> Column:
    # A full word and a stop end a heading; an initial may have one.
    heading = F.trim(text).rlike(r"(?:[A-Za-z][^A-Za-z\s]*){3}\.$")
    # A text of more words is none, and is not cut up to find that out.
    longer = text.rlike(rf"^\s*+(?:\S++\s++){{{most}}}\S")
    named = let(words(text), lambda ws: (F.size(ws) >= 2) & (F.size(ws) <= most) & F.forall(ws, lambda w: _name_token(w, longest)))
    return F.when(longer, F.lit(False)).otherwise(~heading & named)


def is_person(text: Column) -> Column:
    """Two to five title-case words of at most nine letters, none of them a function word or an organisation."""
    return F.coalesce(_named(text, 5, 9), F.lit(False))


def is_byline(text: Column) -> Column:
    """The same for up to 24 words of up to twelve letters."""
    return F.coalesce(_named(text, 24, 12), F.lit(False))


def is_author_list(text: Column) -> Column:
    """A byline, or several parted by commas, affiliation marks aside; the last may be a given name whose surname is on the next line."""

    def listed(parts: Column) -> Column:
        # Each part, and what is left of it without its mark; a person is a short byline.
        forms = lambda p: F.array(F.btrim(p, F.lit(MARKS)), F.regexp_replace(F.btrim(p, F.lit(MARKS)), "[0-9*∗†]+$", ""))
        named = lambda p: F.exists(forms(p), is_byline)
        last = F.try_element_at(parts, F.lit(-1))
        wrapped = (F.size(parts) >= 4) & ~last.rlike(r"[ \t]") & _name_token(last, 1000)
        # The first part that is no name ends it.
        return F.when(F.size(parts) >= 2, F.forall(F.slice(parts, F.lit(1), F.size(parts) - 1), named) & (named(last) | wrapped))

    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return is_byline(text) | F.coalesce(F.when(F.contains(text, F.lit(",")), let(parts, listed)), F.lit(False))


def is_institution(text: Column) -> Column:
    """An affiliation: title case but for connectors, with a word that institutions have; no sentence, no address."""
    titled = lambda w: let(F.btrim(w, F.lit(",;()/+")), lambda b: b.rlike("^(?:$|[A-Z0-9])") | F.lower(b).isin(*CONNECTORS))
    cue = lambda w: F.lower(F.btrim(w, F.lit(",.;()"))).isin(*INSTITUTIONS)
    rule = lambda ws: (F.size(ws) >= 1) & (F.size(ws) <= 12) & F.exists(ws, cue) & F.forall(ws, titled) & ~F.exists(ws, is_email)
    return (F.octet_length(F.trim(text)) <= 160) & ~F.trim(text).rlike("[.?!]$") & let(words(text), rule)


def is_product(text: Column) -> Column:
    """A hyphenated word with a part that is an acronym or has a capital inside."""
    t = F.rtrim(F.trim(text), F.lit(".,;:"))
    marked = lambda p: F.regexp_replace(p, "[^A-Za-z]", "").rlike("^(?:[A-Z]{2,}|[A-Za-z].*[A-Z].*)$")
    return ~t.rlike(_SPACE) & t.contains("-") & F.exists(F.split(t, "-"), marked)


def is_title_list(text: Column) -> Column:
    """Four or more titles of up to eight words parted by semicolons, nearly all of their words with a capital."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, "[. ]+$", ""), ";"), lambda p: words(p)), lambda p: F.size(p) > 0)
    titled = lambda w: w.rlike(r"^[\p{Lu}0-9]") | F.lower(w).isin(*TITLE_SMALL)
    mostly = lambda ws: F.size(F.filter(ws, titled)) * 10 >= F.size(ws) * 9
    return F.contains(text, F.lit(";")) & let(parts, lambda p: (F.size(p) >= 4) & F.forall(p, lambda w: F.size(w) <= 8) & let(F.flatten(p), mostly))


def is_code(text: Column) -> Column:
    """Four or more brackets and signs of code, at least one to three letters."""
    marks = F.length(F.regexp_replace(text, r"[^{};`=()\[\]]", ""))
    return F.when(text.rlike(r"^(?:[^{};`=()\[\]]*+[{};`=()\[\]]){4}"), (letters(text) > 0) & (marks * 3 >= letters(text))).otherwise(F.lit(False))


def is_reference(text: Column) -> Column:
    """An entry of a bibliography by what it holds; a sentence that cites late is none."""
    low = F.lower(text)
    cites_late = (F.size(words(low)) >= 16) & (F.size(words(F.substring_index(low, "et al", 1))) >= 10)
    return low.contains("doi.org") | low.contains("arxiv:") | (low.contains("et al") & low.contains("(") & low.rlike("[0-9]") & ~cites_late)


def is_display_math(text: Column) -> Column:
    return F.when(text.rlike(r"[=\\]"), (letters(text) < 12) & (F.length(F.regexp_replace(text, r"[^=+\\^_∑∫]", "")) >= 2)).otherwise(F.lit(False))


def is_annotation(text: Column) -> Column:
    """A label of a formula's brace."""
    low = F.lower(F.trim(text))
    rest = F.trim(F.regexp_extract(low, "(?s)^from (.*)$", 1))
    return (low != "") & (F.length(low) <= 28) & (low.isin("(high)", "(low)", "trajectory randomness") | (low.startswith("from ") & (rest != "") & (rest.rlike(r"[^\x00-\x7F]") | rest.rlike("^[a-z0-9]{1,12}$"))))


def is_apa_line(text: Column) -> Column:
    """Surnames with initials, and a year in brackets at the end."""
    t = F.rtrim(F.trim(text), F.lit("."))
    parts = F.filter(F.transform(F.split(F.replace(F.regexp_extract(t, r"(?s)^(.*)\([^(]*\)$", 1), F.lit("&"), F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    surname = lambda p: p.rlike(r"^\p{Lu}") & (F.size(words(p)) <= 3)
    initials = lambda p: p.rlike(r"^[-. \t]*(?:\p{Lu}(?:[-. \t]+|$))*$")
    fits = F.forall(F.transform(parts, lambda p, i: F.when(i % 2 == 0, surname(p)).otherwise(initials(p))), lambda ok: ok)
    return F.when(t.rlike(r"\([0-9]{4}[a-z]*\)$"), (F.size(parts) >= 2) & (F.size(parts) % 2 == 0) & fits).otherwise(F.lit(False))


def author_run(text: Column) -> Column:
    """Two or more surnames with an initial, and a year in brackets."""
    return text.rlike(r"\([0-9]{4}[)a-z]") & (F.regexp_count(text, F.lit(r"\p{L}, [A-Z]\.")) >= 2)


def keep_kind(text: Column, authors: Column | None = None, institution: Column | None = None) -> Column:
    """Why a source text is meant to stay as it is; null if it isn't. The first rule that fits holds. ``authors`` and ``institution`` are what those rules say, if it is known."""
    t = F.trim(text)
    name = (is_author_list(t) if authors is None else authors) | (is_institution(t) if institution is None else institution) | is_title_list(t) | is_product(t)
    return F.when(t == "", F.lit(None)).when(name, "name").when(is_code(t), "code").when(is_reference(t), "references").when(is_display_math(t) | is_annotation(t), "formula").when(is_apa_line(t), "references")


def kept_as_is(text: Column) -> Column:
    """Printed as it is: a kept kind, a line of addresses and paths, an author run, letter-spaced code, mathematical letters."""
    t = F.trim(text)
    ws = words(t)
    paths = F.filter(ws, lambda w: w.contains("://") | w.startswith("www.") | w.contains("/") | w.contains("_") | is_file_name(w))
    prose = letters(t) - letters(F.array_join(paths, ""))
    singles = F.size(F.filter(ws, lambda w: F.length(w) == 1))
    spaced = (F.size(ws) >= 8) & (singles * 10 >= F.size(ws) * 7)
    math = t.rlike(r"[\x{1D400}-\x{1D7FF}]") & (letters(t) < 12)
    return (t != "") & (keep_kind(t).isNotNull() | (t.contains("://") & (prose < 12)) | author_run(t) | spaced | math)


def is_equation_number(text: Column) -> Column:
    return F.trim(text).rlike(r"^(?:\([0-9]{1,3}\)|\[[0-9]{1,3}\])$")


def prose_with_formula(text: Column) -> Column:
    """A sentence that also holds formulas: function words, or a lead-in such as "let"."""
    bare = F.transform(words(text), _bare)
    found, lead, n = F.size(F.filter(bare, lambda w: w.isin(*SENTENCE_WORDS))), F.exists(bare, lambda w: w.isin(*LEADS)), letters(text)
    return ((found >= 2) & (n >= 12)) | (lead & (found >= 1) & (n >= 8))


def formula_shard(text: Column, math: Column, plain_letters: Column) -> Column:
    """A piece of a display formula, by its text, its glyphs in math faces and the letters of the others."""
    shard = ((math >= 1) & (plain_letters == 0)) | ((math >= 3) & (plain_letters < 8) & (math > plain_letters))
    return ~prose_with_formula(text) & (shard | is_equation_number(text))
