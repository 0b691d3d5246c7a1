"""What is wrong with a reply: flaws that are counted, and echoes that are sent again. Conditions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkledger.functions import words as wd
from inkledger.functions.text import ABBREVIATIONS, CJK_WIDE, cjk_count, collapse, fold_ligatures, latin_letters, lost_numbers

#: Han, short Han words that keep their space, connectives of a half-translated line, titles of one word, names that stay Latin.
HAN = r"\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}"
STRUCTURAL = ("部分", "章", "节", "图", "表", "第", "附录")
CONNECTIVES = "每当其中由于则且令如果"
ONE_WORD_TITLES = ("introduction", "abstract", "references", "appendix", "contents", "preface", "conclusion", "acknowledgements", "acknowledgment", "acknowledgments")
KEPT_NAMES = ("Ada", "Go", "Java", "Mozilla", "Nix", "Python", "Rust", "Swift")
#: Words and letters of a clause that is left over, and the words looked at from one on.
CLAUSE_WORDS, CLAUSE_LETTERS, CLAUSE_MOST = 6, 40, 24


def _pairs(tokens: Column) -> Column:
    """Each token that equals the one before it."""
    at = F.sequence(F.lit(1), F.size(tokens) - 1)
    return F.when(F.size(tokens) > 1, F.filter(F.transform(at, lambda i: F.when(F.get(tokens, i - 1) == F.get(tokens, i), F.get(tokens, i))), lambda t: t.isNotNull())).otherwise(F.array().cast("array<string>"))


def duplicated_word(source: Column, reply: Column) -> Column:
    """A word typed twice that the source doesn't have twice; numbers may be."""
    own = _pairs(wd.words(source))
    return F.exists(_pairs(wd.words(reply)), lambda t: ~t.rlike("^[0-9]+$") & ~F.array_contains(own, t))


def stray_cjk_space(reply: Column) -> Column:
    """A space after one or two Han characters, no structural word, and before another."""
    return reply.rlike(rf"(?<![{HAN}])(?!(?:{'|'.join(STRUCTURAL)})\s)[{HAN}]{{1,2}}\s+[{HAN}]")


def _sentence_ends(source: Column) -> Column:
    """Stops that end a sentence or the text, not after an abbreviation, and all question and exclamation marks."""
    abbreviated = rf"(?<![A-Za-z])(?i:[A-Za-z]|{'|'.join(ABBREVIATIONS)})"
    stop = rf"[?!]|(?<!{abbreviated})\.(?=[\"'”’)\]\s]*[A-Z])|(?<!{abbreviated})\.(?=\s*$)"
    return F.regexp_count(source, F.lit(stop))


def extra_sentence_end(source: Column, reply: Column) -> Column:
    return F.regexp_count(reply, F.lit("[。！？]")) > _sentence_ends(source)


def _prose(text: Column) -> Column:
    return F.transform(wd.words(text), wd.prose_word)


def residual_english(reply: Column) -> Column:
    """Three or four prose words in a row, one of them a function word. One Han character alone makes no Chinese sentence."""
    prose = F.concat(_prose(reply), F.array(F.lit(None).cast("string")))
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("small"), F.lit(False).alias("found"))

    def walk(s: Column, w: Column) -> Column:
        ended = s["found"] | (s["n"].between(3, 4) & s["small"])
        return F.when(w.isNull(), F.struct(F.lit(0).alias("n"), F.lit(False).alias("small"), ended.alias("found"))).otherwise(F.struct((s["n"] + 1).alias("n"), (s["small"] | wd.is_function_word(w)).alias("small"), s["found"].alias("found")))

    lone = reply.rlike(f"[{HAN}]") & ~reply.rlike(f"[{HAN}]{{2}}")
    return ~lone & F.aggregate(prose, start, walk, lambda s: s["found"])


def _has_word(text: Column, word: Column) -> Column:
    return F.array_contains(F.split(F.lower(text), "[^a-z]+"), word)


def leftover_source_word(source: Column, reply: Column) -> Column:
    """A short title whose reply has Han and one word of the source, while another word was translated."""
    kept = F.filter(_prose(reply), lambda w: w.isNotNull())
    word = F.get(kept, F.lit(0))
    others = F.exists(_prose(source), lambda w: w.isNotNull() & (w != word) & ~_has_word(reply, w))
    return F.coalesce((F.size(wd.words(source)) <= 6) & (F.size(kept) == 1) & reply.rlike(f"[{HAN}]") & _has_word(source, word) & others, F.lit(False))


def _items(text: Column, marks: str) -> Column:
    return F.filter(F.transform(F.split(text, marks), lambda i: F.trim(i)), lambda i: i != "")


def topic_list(source: Column) -> Column:
    """A list of six short topics or more: no citations, no numbers, at most one stop."""
    items = _items(source, ",")
    n = F.size(items)
    cited = F.size(F.filter(items, lambda i: F.lower(i).contains("et al") | (F.length(F.regexp_replace(i, "[^0-9]", "")) >= 4)))
    short = F.size(F.filter(items, lambda i: F.size(wd.words(i)) <= 4))
    last = lambda i: F.try_element_at(wd.words(i), F.lit(-1))
    numeric = F.size(F.filter(items, lambda i: last(i).rlike("[0-9]") & ~last(i).rlike("[A-Za-z]")))
    stops = F.regexp_count(source, F.lit(r"\. |\.\n|\? "))
    return (F.regexp_count(source, F.lit(",")) >= 6) & (stops < 2) & (n >= 6) & (cited * 2 < n) & (short * 4 >= n * 3) & (numeric * 2 < n)


def comma_list_incomplete(source: Column, reply: Column) -> Column:
    """A topic list whose reply lost an item, or a name that stays Latin."""
    s = F.trim(source)
    names = F.filter(F.transform(F.split(fold_ligatures(s), r"[\s,;:、，]+"), lambda t: F.btrim(t, F.lit("()（）[].\"'’"))), lambda t: t.isin(*KEPT_NAMES) | (t.contains(".") & t.rlike("[A-Za-z]")) | t.rlike("^[A-Z]{2,8}/[A-Z]{2,8}$"))
    lost = F.exists(names, lambda t: ~reply.contains(t))
    return topic_list(s) & reply.rlike(CJK_WIDE) & ((F.size(_items(reply, "[,、，]")) + 1 < F.size(_items(s, ","))) | lost)


def changed_number(source: Column, reply: Column) -> Column:
    return F.size(lost_numbers(source, reply)) > 0


def flaw_flags(source: Column, reply: Column) -> dict[str, Column]:
    """The flaws that are counted, each a condition."""
    return {
        "duplicated_word": duplicated_word(source, reply),
        "stray_cjk_space": stray_cjk_space(reply),
        "extra_sentence_end": extra_sentence_end(source, reply),
        "residual_english": residual_english(reply),
        "leftover_source_word": leftover_source_word(source, reply),
        "comma_list_incomplete": comma_list_incomplete(source, reply),
        "changed_number": changed_number(source, reply),
    }


def flaw_count(source: Column, reply: Column) -> Column:
    return sum((F.coalesce(c.cast("int"), F.lit(0)) for c in flaw_flags(source, reply).values()), F.lit(0))


def is_stub(reply: Column) -> Column:
    """Stops only."""
    return F.trim(reply).rlike("^[.…·。 　]+$")


def _worded(source: Column) -> Column:
    """Words with a letter that are no addresses."""
    return F.filter(wd.words(source), lambda w: w.rlike("[A-Za-z]") & ~wd.is_address(w))


def is_prose(source: Column) -> Column:
    """Two words or more with eight letters, not all of them acronyms."""
    ws = _worded(source)
    return (F.size(ws) >= 2) & (wd.letters(F.array_join(ws, "")) >= 8) & ~F.forall(ws, wd.is_acronym)


def is_column_header(source: Column) -> Column:
    """One to four words that may head a column: no sentence, no name, no acronyms, no usual title of one word."""
    s = F.trim(source)
    ws = _worded(s)
    n = wd.letters(F.array_join(ws, ""))
    bare = F.lower(F.regexp_replace(F.get(ws, F.lit(0)), "^[^A-Za-z]+|[^A-Za-z]+$", ""))
    title = (F.size(ws) == 1) & bare.isin(*ONE_WORD_TITLES)
    return ~s.rlike("[.?!。？！]$") & (F.size(ws) >= 1) & (F.size(ws) <= 4) & (n >= 4) & (n <= 36) & ~F.forall(ws, wd.is_acronym) & ~wd.is_person(s) & ~wd.is_byline(s) & ~F.coalesce(title, F.lit(False))


def half_echo(source: Column, reply: Column) -> Column:
    """Neither side has Han, and runs of four words or more of the source are in the reply with half the line's letters."""
    han = r"[\x{4E00}-\x{9FFF}]"
    bare = F.transform(wd.words(source), lambda w: F.lower(F.regexp_replace(w, "^[^A-Za-z]+|[^A-Za-z]+$", "")))

    def best(ws: Column, flat: Column) -> Column:
        # Letters of the longest run from each word on that the reply has; a run holds no word of one letter.
        run = lambda i, e: F.slice(ws, i + 1, e - i)
        there = lambda i, e: F.forall(run(i, e), lambda w: F.length(w) >= 2) & flat.contains(F.array_join(run(i, e), " "))
        of = lambda i: F.coalesce(F.array_max(F.transform(F.filter(F.sequence(i + 4, F.size(ws)), lambda e: there(i, e)), lambda e: F.length(F.array_join(run(i, e), "")))), F.lit(0))
        return F.array_max(F.transform(F.sequence(F.lit(0), F.size(ws) - 4), of))

    def echoed(ws: Column) -> Column:
        total = F.length(F.array_join(ws, ""))
        return (F.size(ws) >= 4) & (total >= 20) & (F.when(F.size(ws) >= 4, wd.let(collapse(F.lower(reply)), lambda flat: best(ws, flat))) * 2 >= total)

    quiet = ~source.rlike(han) & ~reply.rlike(han) & (F.trim(reply) != F.trim(source))
    return F.coalesce(F.when(quiet, wd.let(bare, echoed)), F.lit(False))


def _unquoted(text: Column) -> Column:
    """Without what stands in quotes that open after a space or bracket."""
    close = r"(?=$|[\s!-/:-@\[-`{-~])"
    out = text
    for a, b in (("'", "'"), ('"', '"'), ("[‘’]", "’"), ("[“”]", "”")):
        out = F.regexp_replace(out, rf"(?s)(?<![^\s(]){a}.*?{b}{close}", " ")
    return out


def residual_clause(source: Column, reply: Column) -> Column:
    """A reply with eight CJK characters or more that still has six words in a row of the source, of 40 letters."""
    token = lambda w: F.regexp_replace(w, "^[^A-Za-z0-9'-]+|[^A-Za-z0-9'-]+$", "")
    fine = lambda w: wd.let(token(w), lambda t: t.rlike("[A-Za-z]") & ~wd.is_address(t))
    exempt = wd.is_author_list(source) | wd.is_institution(source) | wd.addresses_only(source) | wd.keep_kind(source).isNotNull()

    def left_over(ws: Column) -> Column:
        words = F.transform(ws, lambda w: F.struct(w.alias("w"), fine(w).alias("fine"), latin_letters(w).alias("n")))

        def clause(all_: Column, i: Column, flat: Column) -> Column:
            here = lambda e: F.slice(all_, i + 1, e - i)
            enough = lambda e: F.forall(here(e), lambda w: w["fine"]) & (F.aggregate(here(e), F.lit(0), lambda s, w: s + w["n"]) >= CLAUSE_LETTERS)
            # The shortest clause that is long enough decides: a longer one holds it.
            ends = F.filter(F.sequence(i + CLAUSE_WORDS, F.least(F.size(all_), i + CLAUSE_MOST)), enough)
            return F.coalesce(wd.let(F.get(ends, F.lit(0)), lambda e: flat.contains(F.array_join(F.transform(here(e), lambda w: w["w"]), " "))), F.lit(False))

        return wd.let(collapse(reply), lambda flat: wd.let(words, lambda all_: F.exists(F.sequence(F.lit(0), F.size(all_) - CLAUSE_WORDS), lambda i: clause(all_, i, flat))))

    some = wd.let(wd.words(_unquoted(source)), lambda ws: F.when(F.size(ws) >= CLAUSE_WORDS, left_over(ws)))
    return F.coalesce(F.when((cjk_count(reply) >= 8) & ~exempt, some), F.lit(False))


def needs_retry(source: Column, reply: Column) -> Column:
    """The reply is an echo, whole or in part, or a stub, and is asked for again."""
    s, r = F.trim(source), F.trim(reply)
    header = F.exists(wd.words(s), lambda w: F.lower(F.regexp_replace(w, "^[^A-Za-z]+|[^A-Za-z]+$", "")).isin("trigger", "optimization", "context", "method", "verified"))
    exempt = (~header & (wd.is_author_list(s) | wd.is_institution(s) | wd.addresses_only(s))) | wd.kept_as_is(s)
    ns, nr, cs, cr = latin_letters(s), latin_letters(r), cjk_count(s), cjk_count(r)
    skeleton = lambda t: F.lower(F.regexp_replace(t, "[^A-Za-z]", ""))
    # The whole source, and a short gloss in Chinese after it.
    tail = F.regexp_extract(r, r"(?s)([^A-Za-z]*)$", 1)
    gloss = F.trim(F.regexp_replace(tail, "^[:：—– 　-]+", ""))
    subtitle = (F.length(skeleton(s)) >= 20) & skeleton(r).contains(skeleton(s)) & (gloss != "") & (F.length(gloss) <= 24) & gloss.rlike(CJK_WIDE)
    glossed = (cs == 0) & (ns >= 40) & (cr > 0) & (cr <= 8) & (F.regexp_replace(F.regexp_replace(r, f"[^{CJK_WIDE[1:-1]}]", ""), f"[{CONNECTIVES}]", "") == "") & (nr * 10 >= ns * 9)
    same = (skeleton(s) != "") & (skeleton(s) == skeleton(r)) & (is_prose(s) | is_column_header(s))
    latin = (cs == 0) & (cr == 0) & (((ns >= 40) & (nr >= 40)) | ((ns >= 8) & is_stub(r)) | same)
    return ~exempt & (residual_clause(s, r) | half_echo(s, r) | subtitle | glossed | latin)
