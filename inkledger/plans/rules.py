"""Queries of the rules for words, lines, tokens, replies and messages.

Texts come from the tables: all lines of documents and conversations, and
phrases and pairs put together from columns of ``part`` and ``events`` for
rules that invented prose doesn't meet. Both engines build these from the same
expression; the rule itself is written anew in SQL, or what it gives is known
from how the text was put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.functions import errors, flaws, repairs, text
from inkledger.functions import words as wd
from inkledger.plans.registry import query
from inkledger.sources import glyphs as gl
from inkledger.sources.files import table

# Messages of calls and documents, by the number of an event.
_PHRASES_OF_CALLS = ["access denied", "Overdue bill", "account in arrears", "insufficient balance", "insufficient_quota", "Quota exceeded", "invalid api key", "invalid_api_key", "Unauthorized", "forbidden", "account disabled", "suspended", "billing", "daily limit exceeded", "RESOURCE_EXHAUSTED", "busy", "upstream error"]
_OTHER_CALLS = ["timeout: global", "io: Peer disconnected", "unexpected end of file", "Connection reset by peer", "incomplete message", "omitted segment 3", "invalid translation JSON", "did not contain a JSON object", "no translations array", "missing id", "missing text", "placeholder was not preserved", "empty message.content", "reply too long", "quota exceeded", "401 in a text", "HTTP  status 401"]
_FAILED = ["thread panicked at", "file is Encrypted", "needs a Password", "bad XREF table", "no trailer", "Flate stream", "can't decompress", "unknown Filter /Crypt", "IO error: denied", "os error 2", "unexpected token", "panic in filter", "password in xref"]


def _choice(values: list[str], index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v.replace(chr(39), chr(39) * 2)}'" for i, v in enumerate(values)) + " END"


_MESSAGE = f"CASE event_id % 4 WHEN 0 THEN concat('LLM HTTP status ', CAST(395 + event_id % 120 AS VARCHAR(9)), ': ', event_type) WHEN 1 THEN concat('Google HTTP status ', CAST(396 + event_id % 38 AS VARCHAR(9)), ': ', {_choice(_PHRASES_OF_CALLS, 'event_id % 17')}) WHEN 2 THEN concat('http status 5', CAST(event_id % 7 AS VARCHAR(9)), ' after HTTP status 4', CAST(event_id % 31 AS VARCHAR(9))) ELSE {_choice(_OTHER_CALLS, 'event_id % 17')} END"
_in = lambda text, needles: "(" + " OR ".join(f"contains({text}, '{n}')" for n in needles) + ")"


@query(f"""WITH m AS (SELECT event_id, {_MESSAGE} AS m FROM events), c AS (SELECT event_id, m, lower(m) AS l,
  regexp_matches(lower(m), 'http status (401|402|403|404|410)') OR (contains(lower(m), 'http status') AND regexp_matches(lower(m), 'access denied|overdue|arrears|insufficient balance|insufficient_quota|quota exceeded|invalid api key|invalid_api_key|unauthorized|forbidden|account disabled|suspended|billing|daily limit exceeded|resource_exhausted')) AS refused,
  regexp_matches(lower(m), 'io:|unexpected end of file|connection reset|connection aborted|peer disconnected|incomplete message') AS gone,
  contains(lower(m), 'http status 4') AND substr(lower(m), strpos(lower(m), 'http status 4') + 12, 3) NOT IN ('408', '409', '429') AS client FROM m),
r AS (SELECT *, NOT refused AND (regexp_matches(m, 'HTTP status (400|409|429|500|502|503|504)') OR gone OR contains(l, 'timeout')) AS retryable,
  gone OR regexp_matches(l, 'timeout|omitted segment|invalid translation json|did not contain a json|no translations array|missing id|missing text|placeholder was not preserved|empty message.content|reply too long|http status (500|502|503|429)') AS recoverable FROM c)
SELECT event_id, refused, client, retryable, recoverable, CASE WHEN refused THEN 'refused' WHEN retryable THEN 'retry' WHEN client THEN 'client' ELSE 'fail' END AS class FROM r""")
def gateway_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("m")
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{_MESSAGE} AS m")
    return rows.select("event_id", errors.refused(m).alias("refused"), errors.client_error(m).alias("client"), errors.retryable(m).alias("retryable"), errors.recoverable(m).alias("recoverable"), errors.gateway_class(m).alias("class"))


@query(f"""WITH m AS (SELECT event_type, lower({_choice(_FAILED, 'event_id % 13')}) AS m FROM events)
SELECT event_type, class, count(*) AS n FROM (SELECT event_type, CASE WHEN {_in('m', ['panic'])} THEN 'panic' WHEN {_in('m', ['encrypt', 'password'])} THEN 'encrypted' WHEN {_in('m', ['xref', 'trailer'])} THEN 'xref-or-trailer'
  WHEN {_in('m', ['flate', 'decompress', 'filter'])} THEN 'stream-filter' WHEN {_in('m', ['io error', 'os error'])} THEN 'io' ELSE 'parse' END AS class FROM m) GROUP BY ALL""")
def document_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_type", f"{_choice(_FAILED, 'event_id % 13')} AS m")
    return rows.select("event_type", errors.document_class(F.col("m")).alias("class")).groupBy("event_type", "class").agg(F.count("*").alias("n"))


# Phrases of two words a and b of a part's name, by its number.
_A, _B = (f"concat(upper(substr(split_part(p_name, ' ', {k}), 1, 1)), substr(split_part(p_name, ' ', {k}), 2))" for k in (1, 2))
_PHRASES = f"""SELECT p_partkey AS id, CASE p_partkey % 24
  WHEN 0 THEN concat(a, ' ', b) WHEN 1 THEN concat(a, ' van ', b) WHEN 2 THEN concat(a, ' ', b, '1, ', b, ' ', a, '2*') WHEN 3 THEN concat('Department of ', a, ' ', b, ' University') WHEN 4 THEN concat('Department of ', a, ' ', b)
  WHEN 5 THEN concat('SWE-', a, 'Bench') WHEN 6 THEN concat(a, '-based') WHEN 7 THEN concat(p_name, ' = {{', a, '(', size, ')}};') WHEN 8 THEN concat(a, ' et al. (', year, ') ', p_name) WHEN 9 THEN concat('x = ', size, ' + y^2')
  WHEN 10 THEN concat('from ε', substr(p_name, 1, 3)) WHEN 11 THEN concat('from the ', p_name, ' side') WHEN 12 THEN concat(a, ', X., ', b, ', Y.-Z., & ', a, ', Q. (', year, ').') WHEN 13 THEN concat('see doi.org/', size) WHEN 14 THEN concat(a, ' ', b, '; The ', b, '; ', a, ' of ', b, '; ', b, ' 2')
  WHEN 15 THEN concat('let the ', p_name, ' be small and (', size, ') then') WHEN 16 THEN concat(a, ' ', b, ', ', b, ' ', a, ', ', a, ' ', a, ', ', b) WHEN 17 THEN concat('(', size, ')') WHEN 18 THEN concat('https://x.org/', size, ' ', a, '@', b, '.org') WHEN 19 THEN concat('notes.txt and https://x.org/', p_name)
  WHEN 20 THEN concat(a, '. ', b, ' Émile ', b, '-', a, '.') WHEN 21 THEN 'd e f r u n ( x )' WHEN 22 THEN concat('[', size, '5', size, ']') ELSE concat(a, ' ', b, ' Research, NLP LAB') END AS text
FROM (SELECT *, {_A} AS a, {_B} AS b, CAST(p_size AS VARCHAR(9)) AS size, CAST(1980 + p_size AS VARCHAR(9)) AS year FROM part) AS p"""
_LINES_OF = "SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS text FROM documents UNION ALL SELECT conv_id, unnest(string_split(text, chr(10))) FROM conversations"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    parts = spark.sql(_PHRASES)
    lines = [table(spark, sf_dir, n).select(F.col(i).alias("id"), F.explode(F.split("text", "\n")).alias("text")) for n, i in (("documents", "doc_id"), ("conversations", "conv_id"))]
    return parts.unionByName(lines[0]).unionByName(lines[1])


_ALL = f"texts AS ({_PHRASES} UNION ALL {_LINES_OF})"
_WS = "'[ \\t\\r\\n\\f\\v]+'"


def _list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {_WS}), lambda w: w <> '')"


def _letters(text: str) -> str:
    return f"length(regexp_replace({text}, '[^A-Za-z]', '', 'g'))"


_ACC = "\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}"


def _name(w: str, longest: int) -> str:
    t = f"trim({w}, ',.')"
    lead = f"(regexp_full_match(substr({t}, 1, 1), '[A-Z{_ACC}]') AND regexp_full_match(substr({t}, 1, 1), '\\p{{Lu}}'))"
    rest = f"(length({t}) = 1 OR (regexp_full_match(substr({t}, 2), '[A-Za-z''{_ACC}-]+') AND regexp_matches(regexp_replace({t}, '[^a-z{_ACC}]', '', 'g'), '\\p{{Ll}}')))"
    halves = f"(strpos({t}, '-') > 0 AND {_letters(f'split_part({t}, chr(45), 1)')} >= 6 AND {_letters(f'substr({t}, strpos({t}, chr(45)) + 1)')} >= 6)"
    return f"({lead} AND {rest} AND NOT lower({t}) IN {_list(wd.ORGANISATIONS)} AND NOT lower({w}) IN {_list(wd.FUNCTION_WORDS)} AND NOT {halves} AND {_letters(w)} <= {longest})"


def _names(t: str, most: int, longest: int) -> str:
    ws = _tokens(f"trim({t})")
    heading = f"(trim({t}) LIKE '%.' AND {_letters(f'list_last({_tokens(chr(39) + chr(39) + f' || rtrim(trim({t}), chr(46))')})')} > 2)"
    return f"coalesce(NOT coalesce({heading}, false) AND len({ws}) BETWEEN 2 AND {most} AND len(list_filter({ws}, lambda w: NOT {_name('w', longest)})) = 0, false)"


_email = lambda w: f"regexp_matches(trim({w}, '()<>[],;:\"''.'), '(?s)^.+@[A-Za-z0-9._-]+\\.[A-Za-z]{{2,}}$')"

# Each rule as a column of its own; the lists of a line are taken apart by row.
_PARTS = f"""base AS (SELECT *, trim(text) AS t FROM (SELECT row_number() OVER () AS r, id, text FROM texts)),
parts AS (SELECT r, k, n, trim(p, '{wd.MARKS}') AS p, regexp_replace(trim(p, '{wd.MARKS}'), '[0-9*∗†]+$', '') AS bare FROM (SELECT r, unnest(ps) AS p, generate_subscripts(ps, 1) AS k, len(ps) AS n
  FROM (SELECT r, list_filter(list_transform(string_split(t, ','), lambda p: trim(p)), lambda p: p <> '') AS ps FROM base WHERE contains(t, ',')))),
listed AS (SELECT r, n >= 2 AND bool_and(({_names('p', 24, 12)} OR {_names('p', 5, 9)} OR (bare <> p AND ({_names('bare', 24, 12)} OR {_names('bare', 5, 9)}))) OR (n >= 4 AND k = n AND NOT regexp_matches(p, '[ \\t]') AND {_name('p', 1000)})) AS listed FROM parts GROUP BY r, n),
kinds AS (SELECT b.*, ({_names('t', 5, 9)} OR {_names('t', 24, 12)} OR coalesce(listed, false)) AS authors,
  t <> '' AND strlen(t) <= 160 AND NOT regexp_matches(t, '[.?!]$') AND len({_tokens('t')}) <= 12 AND len(list_filter({_tokens('t')}, lambda w: {_email('w')})) = 0
    AND len(list_filter({_tokens('t')}, lambda w: NOT (trim(w, ',;()/+') = '' OR lower(trim(w, ',;()/+')) IN {_list(wd.CONNECTORS)} OR regexp_matches(trim(w, ',;()/+'), '^[A-Z0-9]')))) = 0
    AND len(list_filter({_tokens('t')}, lambda w: lower(trim(w, ',.;()')) IN {_list(wd.INSTITUTIONS)})) > 0 AS institution,
  len(list_filter(string_split(regexp_replace(text, '[. ]+$', ''), ';'), lambda p: trim(p) <> '')) >= 4
    AND len(list_filter(string_split(regexp_replace(text, '[. ]+$', ''), ';'), lambda p: len({_tokens('p')}) > 8)) = 0
    AND len(list_filter({_tokens("replace(regexp_replace(text, '[. ]+$', ''), ';', ' ')")}, lambda w: regexp_matches(w, '^[\\p{{Lu}}0-9]') OR lower(w) IN {_list(wd.TITLE_SMALL)})) * 10 >= 9 * len({_tokens("replace(regexp_replace(text, '[. ]+$', ''), ';', ' ')")}) AS titles,
  NOT regexp_matches(rtrim(t, '.,;:'), '[ \\t\\r\\n]') AND contains(rtrim(t, '.,;:'), '-') AND len(list_filter(string_split(rtrim(t, '.,;:'), '-'), lambda p: regexp_full_match(regexp_replace(p, '[^A-Za-z]', '', 'g'), '[A-Z]{{2,}}|[A-Za-z].*[A-Z].*'))) > 0 AS product,
  {_letters('t')} > 0 AND length(regexp_replace(t, '[^{{}};`=()\\[\\]]', '', 'g')) >= greatest(4, {_letters('t')} / 3.0) AS code,
  contains(lower(t), 'doi.org') OR contains(lower(t), 'arxiv:') OR (contains(lower(t), 'et al') AND contains(t, '(') AND regexp_matches(t, '[0-9]') AND NOT (len({_tokens('t')}) >= 16 AND len({_tokens("substr(lower(t), 1, greatest(strpos(lower(t), 'et al') - 1, 0))")}) >= 10)) AS reference,
  {_letters('t')} < 12 AND length(regexp_replace(t, '[^=+\\\\^_∑∫]', '', 'g')) >= 2 AND regexp_matches(t, '[=\\\\]') AS math,
  length(t) <= 28 AND (lower(t) IN ('(high)', '(low)', 'trajectory randomness') OR (lower(t) LIKE 'from %' AND trim(substr(t, 6)) <> '' AND (regexp_matches(substr(lower(t), 6), '[^\\x00-\\x7F]') OR regexp_full_match(trim(substr(lower(t), 6)), '[a-z0-9]{{1,12}}')))) AS annotation,
  regexp_full_match(rtrim(t, '.'), '(?:[^(),]+,(?: *(?:\\p{{Lu}}[-. ]*)+),? *&? *)+\\([0-9]{{4}}[a-z]*\\)') AND regexp_full_match(rtrim(t, '.'), '(?: *&? *\\p{{Lu}}[^ ,(]*(?: [^ ,(]+){{0,2}},[^,(]*,? *)+\\(.*') AS apa
  FROM base b LEFT JOIN listed l ON b.r = l.r),
kept AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN authors OR institution OR titles OR product THEN 'name' WHEN code THEN 'code' WHEN reference THEN 'references' WHEN math OR annotation THEN 'formula' WHEN apa THEN 'references' END AS kind FROM kinds)"""


@query(f"WITH {_ALL}, {_PARTS} SELECT kind, authors, institution, count(*) AS n, CAST(min(id) AS BIGINT) AS first_id, CAST(sum(strlen(t)) AS BIGINT) AS bytes FROM kept GROUP BY ALL")
def keep_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.trim("text")
    # Each rule once: what is named twice is a column of its own.
    told = _texts(spark, sf_dir).select("id", t.alias("t"), wd.is_author_list(t).alias("authors"), wd.is_institution(t).alias("institution"))
    rows = told.select("id", wd.keep_kind(F.col("t"), F.col("authors"), F.col("institution")).alias("kind"), "authors", "institution", F.octet_length("t").alias("b"))
    return rows.groupBy("kind", "authors", "institution").agg(F.count("*").alias("n"), F.min("id").cast("long").alias("first_id"), F.sum("b").alias("bytes"))


@query(f"""WITH {_ALL}, {_PARTS}, p AS (SELECT *, {_tokens('t')} AS ws FROM kept),
q AS (SELECT *, list_filter(ws, lambda w: contains(w, '://') OR w LIKE 'www.%' OR contains(w, '/') OR contains(w, '_') OR (regexp_matches(trim(w, '(),;:'), '\\.[a-z0-9]{{2,4}}$') AND length(regexp_replace(regexp_extract(trim(w, '(),;:'), '(?s)^(.*)\\.[a-z0-9]{{2,4}}$', 1), '[^A-Za-z0-9]', '', 'g')) >= 2)) AS paths FROM p)
SELECT id, t AS text, kind FROM q WHERE t <> '' AND (kind IS NOT NULL OR (contains(t, '://') AND {_letters('t')} - {_letters("array_to_string(paths, '')")} < 12)
  OR (regexp_matches(t, '\\([0-9]{{4}}[)a-z]') AND len(regexp_extract_all(t, '\\p{{L}}, [A-Z]\\.')) >= 2) OR (len(ws) >= 8 AND len(list_filter(ws, lambda w: length(w) = 1)) * 10 >= len(ws) * 7) OR (regexp_matches(t, '[\\x{{1D400}}-\\x{{1D7FF}}]') AND {_letters('t')} < 12))""")
def kept_as_is(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _texts(spark, sf_dir).where(wd.kept_as_is(t)).select("id", F.trim("text").alias("text"), wd.keep_kind(t).alias("kind"))


@query(f"""WITH {_ALL}, w AS (SELECT r, text, list_transform({_tokens('text')}, lambda w: lower(regexp_replace(w, '^[^A-Za-z]+|[^A-Za-z]+$', '', 'g'))) AS ws FROM (SELECT row_number() OVER () AS r, text FROM texts)),
c AS (SELECT text, len(list_filter(ws, lambda w: w IN {_list(wd.SENTENCE_WORDS)})) AS f, len(list_filter(ws, lambda w: w IN {_list(wd.LEADS)})) > 0 AS lead, {_letters('text')} AS n, regexp_full_match(trim(text), '\\([0-9]{{1,3}}\\)|\\[[0-9]{{1,3}}\\]') AS number FROM w)
SELECT prose, number, count(*) AS n, CAST(sum(letters) AS BIGINT) AS letters FROM (SELECT (f >= 2 AND n >= 12) OR (lead AND f >= 1 AND n >= 8) AS prose, number, n AS letters FROM c) GROUP BY ALL""")
def formula_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir).select(wd.prose_with_formula(F.col("text")).alias("prose"), wd.is_equation_number(F.col("text")).alias("number"), wd.letters(F.col("text")).alias("k"))
    return rows.groupBy("prose", "number").agg(F.count("*").alias("n"), F.sum("k").alias("letters"))


@query(f"""WITH {_ALL}, w AS (SELECT unnest({_tokens('text')}) AS w FROM texts), c AS (SELECT w, trim(w, ',.;:)("''“”—-') AS core, regexp_replace(w, '[^A-Za-z]', '', 'g') AS l FROM w)
SELECT count(*) AS n_words, count(*) FILTER (WHERE {_email('w')}) AS n_email, count(*) FILTER (WHERE contains(w, '://') OR w LIKE 'www.%' OR {_email('w')}) AS n_address, count(*) FILTER (WHERE regexp_full_match(l, '[A-Z]{{1,5}}')) AS n_acronym,
  count(*) FILTER (WHERE lower(w) IN {_list(wd.FUNCTION_WORDS)}) AS n_function,
  count(*) FILTER (WHERE core <> '' AND (lower(core) IN {_list(wd.FUNCTION_WORDS)} OR (regexp_full_match(core, '[A-Za-z''-]+') AND NOT (contains(core, '-') AND regexp_matches(core, '[A-Z]')) AND length(regexp_replace(core, '[^A-Za-z]', '', 'g')) >= 3
    AND regexp_matches(core, '[a-z]') AND NOT regexp_matches(regexp_replace(core, '[^A-Za-z]', '', 'g'), '[a-z][A-Z]')))) AS n_prose FROM c""")
def word_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    rows = _texts(spark, sf_dir).select(F.explode(wd.words(F.col("text"))).alias("w"))
    return rows.agg(F.count("*").alias("n_words"), F.count_if(wd.is_email(w)).alias("n_email"), F.count_if(wd.is_address(w)).alias("n_address"), F.count_if(wd.is_acronym(w)).alias("n_acronym"), F.count_if(wd.is_function_word(w)).alias("n_function"), F.count(wd.prose_word(w)).alias("n_prose"))


# Texts with tokens at known places.
_MADE = f"""SELECT p_partkey, a, b, size, year, concat('See [', size, '], ', a, ' et al. (', year, ') and (', b, ' & ', a, ', ', year, 'a); mail ', a, '@', b, '.org, {{', p_type, '}} at https://x.org/', size, 'x). Cost ', size, '.5, not ', size, 'x or v', size, ' or [', year, '0].') AS source
FROM (SELECT *, {_A} AS a, {_B} AS b, CAST(p_size AS VARCHAR(9)) AS size, CAST(1980 + p_size AS VARCHAR(9)) AS year FROM part) AS p"""


def _made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(sql)


@query(f"""SELECT p_partkey, concat('See ⟦0⟧, ⟦1⟧ and ⟦2⟧; mail ⟦3⟧, ⟦4⟧ at ⟦5⟧). Cost ⟦6⟧, not ', size, 'x or v', size, ' or [⟦7⟧].') AS shielded, 'citation,citation,citation,email,braces,url,number,number' AS kinds,
  concat('[', size, ']|', a, ' et al. (', year, ')|(', b, ' & ', a, ', ', year, 'a)|', a, '@', b, '.org|', substr(source, strpos(source, '{{'), strpos(source, '}}') - strpos(source, '{{') + 1), '|https://x.org/', size, 'x|', size, '.5|', year, '0') AS slots,
  source AS restored, concat('X ', size, '.5 ', a, '@', b, '.org') AS partly, NULL AS unknown FROM ({_MADE})""")
def shield_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    shielded, slots = text.shield("source")
    rows = _made(spark, sf_dir, _MADE).select("p_partkey", "source", shielded.alias("shielded"), slots.alias("held"))
    two = F.array(F.get("held", F.lit(6)), F.get("held", F.lit(3)))
    return rows.select(
        "p_partkey", "shielded", F.array_join(F.transform("held", text.kind_of), ",").alias("kinds"), F.array_join("held", "|").alias("slots"), text.restore("shielded", "held").alias("restored"),
        text.restore(F.lit("X ⟦0⟧ ⟦1⟧"), two).alias("partly"), F.coalesce(text.restore(F.lit("X ⟦0⟧ ⟦2⟧"), two), text.restore(F.lit("X ⟦0⟧"), two)).alias("unknown"),
    )


@query(f"""SELECT p_partkey, 8 AS n_tokens, 5 AS n_kept FROM ({_MADE})""")
def protected_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The output lost both author-year citations and the address.
    rows = _made(spark, sf_dir, _MADE).select("p_partkey", text.found("source", text.SCORED_TOKENS).alias("tokens"), text.squash(F.regexp_replace(F.regexp_replace("source", r"[A-Z][a-z]+ et al|\([A-Z][a-z]+ &", " "), "@", "(at)")).alias("flat"))
    return rows.select("p_partkey", F.size("tokens").alias("n_tokens"), F.size(F.filter("tokens", lambda t: F.col("flat").contains(text.squash(t)))).alias("n_kept"))


_TERMS = {"small": "S", "ring": "R", "red ring": "RR"}


@query("""WITH p AS (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, CAST(p_size AS VARCHAR) AS size FROM part),
s AS (SELECT *, CASE WHEN p_name = 'red ring' THEN ['RR', size] WHEN w1 = 'small' AND w2 = 'ring' THEN ['S', 'R', size] WHEN w1 = 'small' THEN ['S', size] WHEN w2 = 'ring' THEN ['R', size] ELSE [size] END AS slots,
  CASE WHEN p_name = 'red ring' THEN '⟦0⟧' WHEN w1 = 'small' AND w2 = 'ring' THEN '⟦0⟧ ⟦1⟧' WHEN w1 = 'small' THEN '⟦0⟧ ' || w2 WHEN w2 = 'ring' THEN w1 || ' ⟦0⟧' ELSE p_name END AS head FROM p)
SELECT p_partkey, head || ' x' || w2 || ' ' || w1 || '_ ⟦' || (len(slots) - 1) || '⟧' AS shielded, array_to_string(slots, '|') AS slots, array_to_string(slots, '+') AS restored FROM s""")
def shield_with_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, "SELECT p_partkey, concat(p_name, ' x', split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1), '_ ', p_size) AS t FROM part")
    shielded, slots = text.shield("t", glossary=_TERMS)
    rows = rows.select("p_partkey", shielded.alias("shielded"), slots.alias("held"))
    marks = F.array_join(F.transform(F.sequence(F.lit(0), F.size("held") - 1), lambda i: F.concat(F.lit("⟦"), i.cast("string"), F.lit("⟧"))), "+")
    return rows.select("p_partkey", "shielded", F.array_join("held", "|").alias("slots"), text.restore(marks, "held").alias("restored"))


@query(f"""WITH m AS ({_MADE}), t AS (SELECT p_partkey, source, unnest(['[' || size || ']', a || ' et al. (' || year || ')', '(' || b || ' & ' || a || ', ' || year || 'a)', a || '@' || b || '.org', 'https://x.org/' || size || 'x', size || '.5', year || '0']) AS token, size FROM m)
SELECT p_partkey, token, CAST(strpos(source, token) - 1 AS INTEGER) AS start, CAST(strpos(source, token) - 1 + length(token) AS INTEGER) AS "end", CASE WHEN token LIKE '%(%' OR token LIKE '[%' THEN CAST(strpos(source, token) - 1 + length(token) AS INTEGER) END AS citation FROM t""")
def verbatim_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, _MADE).select("p_partkey", "source", F.inline(text.verbatim_spans("source")))
    token = F.substring("source", F.col("start") + 1, F.col("end") - F.col("start"))
    return rows.select("p_partkey", token.alias("token"), "start", "end", text.citation_end("source", F.col("start")).alias("citation")).where("token not like '{%'")


#: Pairs of source and reply by the number of a part, and the flaws that each has.
_PAIRS = [
    ("concat('The ', p_name, ' is here')", "concat('这 ', p_name, ' ', p_name, ' x')", ()),
    ("concat('The ', p_name, ' is here')", "concat('这是 ', a, ' ', a, ' 了')", ("duplicated_word",)),
    ("concat('It is ', a, ' ', a, ' now')", "concat('这是', a, ' ', a, '了')", ()),
    ("concat('Row ', size, ' ', size, ' of ', b)", "concat('第 ', size, ' ', size, ' 行')", ()),
    ("concat('Advanced ', p_name)", "'高级 检索'", ("stray_cjk_space",)),
    ("concat('Part ', p_name)", "'部分 摘要和罗伯托 因凡特'", ()),
    ("concat('One ', p_name, ' stops. Here')", "'一个。两个。'", ("extra_sentence_end",)),
    ("concat('One ', p_name, '. Two ', p_name, '! Done.')", "'一个。两个！完。'", ()),
    ("concat('Fig. 2 of ', a, ' et al. shows it')", "'图2显示。'", ("extra_sentence_end",)),
    ("concat('Text ', p_name)", "concat('这里 the model ', lower(a), ' 了')", ("residual_english",)),
    ("concat('Text ', p_name)", "concat('中 the model ', lower(a), ' x9')", ()),
    ("concat(a, ' ', b)", "concat(a, ' 摘要')", ("leftover_source_word",)),
    ("concat(a, ' ', b)", "concat(a, ' ', b, ' 摘要')", ()),
    ("concat('Energy, Legal, Rust, ', a, ', ', b, ', Law, Tax')", "'能源、法律、Rust、甲、乙、法、税'", ()),
    ("concat('Energy, Legal, Rust, ', a, ', ', b, ', Law, Tax')", "'能源、法律、Rust、甲'", ("comma_list_incomplete",)),
    ("concat('Energy, Legal, Rust, ', a, ', ', b, ', Law, Tax')", "'能源、法律、锈、甲、乙、法、税'", ("comma_list_incomplete",)),
    ("concat('Costs ', size, '.8 of 1,000')", "concat('花费', size, '.8的1,000')", ()),
    ("concat('Costs ', size, '.8 of 1,000')", "concat('花费', size, '.0的1,000')", ("changed_number",)),
    ("concat('Costs 7 and 7 of ', b)", "'花费7'", ("changed_number",)),
]
_WORDED = f"(SELECT *, {_A} AS a, {_B} AS b, CAST(p_size AS VARCHAR(9)) AS size FROM part) AS p"
_FLAW_ROWS = f"SELECT p_partkey, p_partkey % {len(_PAIRS)} AS k, CASE p_partkey % {len(_PAIRS)} " + " ".join(f"WHEN {i} THEN {s}" for i, (s, _, _) in enumerate(_PAIRS)) + f" END AS source, CASE p_partkey % {len(_PAIRS)} " + " ".join(f"WHEN {i} THEN {r}" for i, (_, r, _) in enumerate(_PAIRS)) + f" END AS reply FROM {_WORDED}"


@query(f"SELECT p_partkey, CASE k " + " ".join(f"WHEN {i} THEN '{','.join(f)}'" for i, (_, _, f) in enumerate(_PAIRS)) + " END AS flaws, CASE k " + " ".join(f"WHEN {i} THEN {len(f)}" for i, (_, _, f) in enumerate(_PAIRS)) + f" END AS n FROM ({_FLAW_ROWS})")  # noqa: F541
def reply_flaws(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = F.col("source"), F.col("reply")
    flags = F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in flaws.flaw_flags(s, r).items()])), ",")
    return _made(spark, sf_dir, _FLAW_ROWS).select("p_partkey", flags.alias("flaws"), flaws.flaw_count(s, r).alias("n"))


_LONG = "concat('We measure how the ', p_name, ' behaves when many different workers read the same table')"
_PLAIN = "concat('the quick ', p_name, ' jumps over every lazy animal')"
#: Sources and replies, and whether the reply is asked for again: rows of each rule and of its exceptions.
_RETRIES = [
    (_LONG, _LONG, True), (_LONG, "'我们测量了这个部件的行为'", False), ("concat(a, ' ', b)", "concat(a, ' ', b)", False), ("concat(size, ' ', a, ' Road')", "concat(size, ' ', a, ' Road')", True),
    ("'RAG'", "'RAG'", False), ("'LLM API'", "'LLM API'", False), ("'Introduction'", "'Introduction'", False), ("'Trigger Optimization Context'", "'TriggerOptimizationContext'", True),
    ("concat('https://x.org/', size)", "concat('https://x.org/', size)", False), ("concat('Reading ', p_name, ' tables')", "'...'", True), (_LONG, f"concat({_LONG}, ' 性能基准')", True),
    (_LONG, f"concat('当', {_LONG})", True), (_LONG, "concat('我们在这里做了一些测量 how the ', p_name, ' behaves when many different workers read the same')", True),
    (_LONG, "concat('我们在这里做了一些测量 how the ', p_name, ' behaves 很好')", False), (_PLAIN, "concat('der schnelle Fuchs aber the quick ', p_name, ' jumps over every animal')", True), (_PLAIN, "concat('der schnelle Fuchs ', p_name, ' springt')", False),
    ("'def run(x): y = {z[0]};'", "'def run(x): y = {z[0]};'", False), ("concat('He said \"we measure how the ', p_name, ' behaves when many workers read\" today')", "concat('他今天说了这样一句话：\"we measure how the ', p_name, ' behaves when many workers read\"')", False),
]
_RETRY_ROWS = f"SELECT p_partkey, p_partkey % {len(_RETRIES)} AS k, CASE p_partkey % {len(_RETRIES)} " + " ".join(f"WHEN {i} THEN {s}" for i, (s, _, _) in enumerate(_RETRIES)) + f" END AS source, CASE p_partkey % {len(_RETRIES)} " + " ".join(f"WHEN {i} THEN {r}" for i, (_, r, _) in enumerate(_RETRIES)) + f" END AS reply FROM {_WORDED}"


@query("SELECT p_partkey, CASE k " + " ".join(f"WHEN {i} THEN {str(x).lower()}" for i, (_, _, x) in enumerate(_RETRIES)) + f" END AS again FROM ({_RETRY_ROWS})")
def retried_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, _RETRY_ROWS).select("p_partkey", F.coalesce(flaws.needs_retry(F.col("source"), F.col("reply")), F.lit(False)).alias("again"))


#: Pairs for the repairs, and what comes out.
_MENDED = [
    ("concat('It is ', size, '1.8 wide')", "concat('It is ', size, '1.0 wide')", "concat('It is ', size, '1.8 wide')"), ("'a b'", "concat('the ', a, ' ', a, ' end')", "concat('the ', a, ' end')"), ("concat(a, ' ', a)", "concat('the ', a, ' ', a, ' end')", "concat('the ', a, ' ', a, ' end')"),
    ("'x'", "'中 文'", "'中文'"), ("concat('The ', p_name)", "concat('猫 (the ', p_name, ')在')", "'猫在'"), ("concat('Pay ', size, ' and ', size)", "concat('Pay ', size, ' and ', size, '6')", "concat('Pay ', size, ' and ', size, '6')"), ("concat(a, '.')", "concat(b, '。。')", "concat(b, '。')"),
    ("concat('From 1,', size, '00 to 2')", "concat('Von 2 bis 1,', size, '00')", "concat('Von 2 bis 1,', size, '00')"),
]
_MENDED_ROWS = f"SELECT p_partkey, p_partkey % {len(_MENDED)} AS k, CASE p_partkey % {len(_MENDED)} " + " ".join(f"WHEN {i} THEN {s}" for i, (s, _, _) in enumerate(_MENDED)) + f" END AS source, CASE p_partkey % {len(_MENDED)} " + " ".join(f"WHEN {i} THEN {r}" for i, (_, r, _) in enumerate(_MENDED)) + f" END AS reply, CASE p_partkey % {len(_MENDED)} " + " ".join(f"WHEN {i} THEN {o}" for i, (_, _, o) in enumerate(_MENDED)) + f" END AS mended FROM {_WORDED}"


@query(f"SELECT p_partkey, source, mended AS repaired FROM ({_MENDED_ROWS})")
def repaired_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, _MENDED_ROWS).select("p_partkey", "source", repairs.repair(F.col("source"), F.col("reply")).alias("repaired"))


# Counts of letters and ideographs, normal forms.
@query("""WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' ﬁn 中文 㐀 豈 ＡＢ ア。' ELSE 'x中1' END AS t FROM documents)
SELECT doc_id, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(t, '[^\\x{3000}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FFEF}]', '', 'g')) AS wide,
  length(regexp_replace(t, '[^\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}]', '', 'g')) AS scored, md5(regexp_replace(t, '[ \\t\\r\\n\\f\\v]+', '', 'g')) AS squashed, md5(trim(regexp_replace(t, '[ \\t\\r\\n\\f\\v]+', ' ', 'g'))) AS collapsed,
  md5(replace(t, 'ﬁ', 'fi')) AS folded, md5(regexp_replace(regexp_replace(t, '([\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}])([A-Za-z0-9])', '\\1 \\2', 'g'), '([A-Za-z0-9])([\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}])', '\\1 \\2', 'g')) AS spaced FROM t""")
def letter_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 3 == 0, " ﬁn 中文 㐀 豈 ＡＢ ア。").otherwise("x中1")).alias("t"))
    return rows.select("doc_id", text.latin_letters(t).alias("latin"), text.cjk_count(t).alias("wide"), text.cjk_count(t, text.CJK_SCORE).alias("scored"), F.md5(text.squash(t)).alias("squashed"), F.md5(text.collapse(t)).alias("collapsed"), F.md5(text.fold_ligatures(t)).alias("folded"), F.md5(text.space_cjk_latin(t)).alias("spaced"))


@query("""WITH r AS (SELECT p_partkey, p_name AS source, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE '甲' || p_size END AS a, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 5 = 0 THEN '甲' || p_size ELSE '乙' END AS b FROM part)
SELECT p_partkey, CASE WHEN a = b THEN a WHEN a = source OR b = source THEN source END AS chosen FROM r""")
def saved_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name AS source", "CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE '甲' || p_size END AS a", "CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 5 = 0 THEN '甲' || p_size ELSE '乙' END AS b")
    return rows.select("p_partkey", text.choose_saved(F.col("a"), F.col("b"), F.col("source")).alias("chosen"))
