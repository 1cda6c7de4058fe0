"""The registered queries over the driver's tables, with DuckDB SQL where SQL can express them.

Messages are the lines of documents (short) or whole documents; users and times are functions of the ids. Limits and
lexicons are parameters, set here to values that select some but not all rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modengine.config import CustomRule, ModerationConfig
from modengine.functions import domains, fixed, normalize, rules, words
from modengine.functions.words import Lexicon, strings
from modengine.operators import gates, lexicon, limits, reports
from modengine.operators.decide import Moderator, dry_run
from modengine.sources.messages import audit_lines, private_messages, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LEXICON = Lexicon.of(("tion", "there", "andthe", "ingtion", "heat", "oner"), ("that", "thewith"))
CONFIG = ModerationConfig(allowed_blocks=("BASIC_LATIN", "LATIN_1_SUPPLEMENT", "GENERAL_PUNCTUATION"), max_length=200, repeats_enabled=False, domain_enabled=False, words_enabled=False)
FULL = ModerationConfig(allowed_blocks=("BASIC_LATIN", "LATIN_1_SUPPLEMENT"), max_length=120, rate_enabled=True, rate_max=8, rate_seconds=60, flood_enabled=True, flood_seconds=120, mixed_enabled=True, custom_rules=(CustomRule("shout", "[A-Z]{9,}"),))

_LINES = """lines AS (
  SELECT doc_id * 1000000 + pos AS msg_id, 1704067200 + doc_id * 7 + pos AS sec, (doc_id % 97)::VARCHAR AS user_id, source AS channel, text
  FROM (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS text FROM documents) WHERE text <> ''
)"""
# Fixed values as RE2 has them: its \b is the boundary that the operators spell out.
_IP = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b|0x[0-9a-fA-F]{1,2}(?:\.[0-9a-fA-F]{1,2}){3}|\b\d{1,3}\s*[,;:]\s*\d{1,3}\s*[,;:]\s*\d{1,3}\s*[,;:]\s*\d{1,3}\b"
_TAG = r"(?i)<[/]?[a-z][a-z0-9_]*(?::[^>]*)?>"
_COLOR = r"(?i)[&Â§](?:[0-9a-fk-or]|x(?:[&Â§][0-9a-f]){6})"
_UTF16 = r"(length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')))"
_DECISIONS = rf"""{_LINES}, decided AS (
  SELECT *, CASE WHEN regexp_matches(text, '[^\x{{0000}}-\x{{00FF}}\x{{2000}}-\x{{206F}}]') THEN 'Illegal Characters' WHEN regexp_matches(text, '{_TAG}') THEN 'MiniMessage'
    WHEN regexp_matches(text, '{_COLOR}') THEN 'Color Code' WHEN {_UTF16} > 200 THEN 'Message Too Long' WHEN regexp_matches(text, '{_IP}') THEN 'IP' END AS rule FROM lines
), found AS (SELECT msg_id AS id, user_id, text AS message, rule AS reason, sec FROM decided WHERE rule IS NOT NULL),
stats AS (SELECT user_id, count(*) AS violation_count, max(sec) AS last_violation FROM found GROUP BY user_id)"""


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages: the lines of documents that are not empty."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text")).filter("text <> ''")
    return rows.select((F.col("doc_id") * 1000000 + F.col("pos")).alias("msg_id"), F.timestamp_seconds(1704067200 + F.col("doc_id") * 7 + F.col("pos")).alias("ts"), (F.col("doc_id") % 97).cast("string").alias("user_id"), F.concat(F.lit("user"), (F.col("doc_id") % 97).cast("string")).alias("user_name"), F.col("source").alias("channel"), "text")


def seconds(column: str):
    return F.unix_seconds(F.col(column).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed messages: events, with their type as text."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("msg_id"), "ts", F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("normalized"))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word): lower-case words that stand in forty documents or more."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return found.filter(F.length("word") > 2).groupBy("word").agg(F.count_distinct("doc_id").alias("n")).filter("n >= 40").select("word")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Moderator(CONFIG).decide(lines(spark, sf_dir))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.violations(decisions(spark, sf_dir))


# --- rules -----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, regexp_matches(text, '{_IP}') AS hit FROM documents")
def rule_ip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", domains.ip_address(F.col("text"), CONFIG).alias("hit"))


@query(r"SELECT doc_id, regexp_matches(text, '[^\x{0000}-\x{007F}\x{2000}-\x{206F}]') AS hit FROM documents")
def rule_char_whitelist(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.illegal_characters(F.col("text"), ("BASIC_LATIN", "GENERAL_PUNCTUATION", "UNHEARD_OF")).alias("hit"))


@query(f"WITH {_LINES} SELECT msg_id, {_UTF16} > 25 AS hit FROM lines")
def rule_length(spark, sf_dir):
    return lines(spark, sf_dir).select("msg_id", rules.too_long(F.col("text"), 25).alias("hit"))


@query(f"SELECT page_id, regexp_matches(html, '{_TAG}') AS hit FROM pages")
def rule_minimessage(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", rules.formatting_tag(F.col("html")).alias("hit"))


@query(f"SELECT page_id, regexp_matches(html, '{_COLOR}') AS hit FROM pages")
def rule_color_code(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", rules.color_code(F.col("html")).alias("hit"))


@query(rf"""WITH {_LINES}, chars AS (
  SELECT msg_id, generate_subscripts(string_split(text, ''), 1) AS i, unnest(string_split(text, '')) AS c FROM lines
), runs AS (SELECT msg_id, c, i - row_number() OVER (PARTITION BY msg_id, c ORDER BY i) AS g FROM chars),
long AS (SELECT DISTINCT msg_id FROM (SELECT msg_id, c, g, count(*) AS n FROM runs GROUP BY ALL) WHERE n > 2 AND c NOT IN (chr(13), chr(133), chr(8232), chr(8233)))
SELECT msg_id, msg_id IN (SELECT msg_id FROM long) AS hit FROM lines""")
def rule_repeated_char(spark, sf_dir):
    return lines(spark, sf_dir).select("msg_id", rules.repeated_character(F.col("text"), 2).alias("hit"))


@query(rf"WITH {_LINES} SELECT msg_id, regexp_matches(text, 'tion[a-z]{{2}}[.,]') AS hit FROM lines")
def rule_custom_regex(spark, sf_dir):
    return lines(spark, sf_dir).select("msg_id", rules.custom_pattern(F.col("text"), "tion[a-z]{2}[.,]").alias("hit"))


@query(rf"WITH {_LINES} SELECT msg_id, CASE WHEN regexp_matches(text, '[\r\x{{85}}\x{{2028}}\x{{2029}}]') THEN NULL WHEN regexp_matches(lower(text), '\bder\b') THEN 'der' WHEN regexp_matches(lower(text), '\bthe\b') THEN 'the' END AS name FROM lines")
def rule_server_name(spark, sf_dir):
    """All lines; null where one holds another line break."""
    return lines(spark, sf_dir).select("msg_id", rules.server_name(F.col("text"), ("The", "der")).alias("name"))


@query(rf"WITH {_LINES} SELECT msg_id, regexp_matches(text, '[^\x00-\x7F\s]\S*$') AS hit FROM lines")
def rule_mixed_script(spark, sf_dir):
    return lines(spark, sf_dir).select("msg_id", rules.mixed_script(F.concat("text", F.lit("я")), rules.jvm_scripts(spark)).alias("hit"))


# --- normalization ---------------------------------------------------------------------------------------------------


@query("SELECT doc_id, text AS normalized FROM documents")
def norm_zero_width(spark, sf_dir):
    marked = F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("\u200be\ufe0f")), F.lit(" "), F.lit("\U000e0041 \u00ad"))
    return table(spark, sf_dir, "documents").select("doc_id", normalize.strip_zero_width(marked).alias("normalized"))


@query("SELECT page_id, translate(html, '@431!0$57+8692', 'aaeiiossttbggz') AS normalized FROM pages")
def norm_leet_single(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", normalize.decode_leet_chars(F.col("html")).alias("normalized"))


@query("SELECT doc_id, translate(translate(text, 'aeo', 'аео'), 'аеіјорсѕхуһԁԛԝӏгαοεκνρστχ', 'aeijopcsxyhdqwlraoekvpctx') AS normalized FROM documents")
def norm_confusable(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", normalize.decode_confusables(F.translate("text", "aeo", "аео")).alias("normalized"))


def _between(text: str, separator: str) -> str:
    """SQL: without ``separator`` between letters. A letter ends one match and may open the next, so it takes two passes."""
    once = lambda x: rf"regexp_replace({x}, '(\p{{L}}){separator}(\p{{L}})', '\1\2', 'g')"
    return once(once(text))


def _chars(text: str, keep: str) -> str:
    """SQL: the characters c (at i, of cs) for which ``keep`` holds."""
    return f"(SELECT array_to_string(list_filter(cs, lambda c, i: {keep}), '') FROM (SELECT string_split({text}, '') AS cs))"


def _leet(text: str) -> str:
    """SQL: sequences are marked in one pass and then replaced."""
    quoted = lambda x: x.replace("'", "''")
    marked = rf"regexp_replace({text}, '({quoted('|'.join(re.escape(q) for q, _ in fixed.LEET))})', chr(57344) || '\1' || chr(57345), 'g')"
    for sequence, letter in fixed.LEET:
        marked = f"replace({marked}, chr(57344) || '{quoted(sequence)}' || chr(57345), '{letter}')"
    return marked


def _spaced(text: str) -> str:
    once = lambda x: rf"regexp_replace({x}, '\b([a-zA-Z]) ([a-zA-Z])\b', '\1' || chr(57344) || '\2', 'g')"
    return f"replace({once(once(text))}, chr(57344), '')"


def _separators(text: str) -> str:
    """SQL: separators before a blank are put aside."""
    for n, c in enumerate("*_-|"):
        text = rf"regexp_replace({text}, '[{chr(92)}{c}](\s)', chr({57344 + n}) || '\1', 'g')"
    text = rf"regexp_replace({text}, '\s*([*_\-|])', '\1', 'g')"
    for n, c in enumerate("*_-|"):
        text = f"replace({text}, chr({57344 + n}), '{c}')"
    return text


#: The steps of the chain as SQL over an expression, in order.
_STEPS: dict[str, Callable[[str], str]] = {
    "zero_width": lambda t: f"regexp_replace({t}, '[{fixed.ZERO_WIDTH}]', '', 'g')",
    "decompose": lambda t: f"strip_accents({t})",
    "confusables": lambda t: f"translate({t}, '{fixed.CYRILLIC + fixed.GREEK}', '{fixed.CYRILLIC_AS + fixed.GREEK_AS}')",
    "leet_sequences": _leet,
    "leet_chars": lambda t: f"translate({t}, '{fixed.LEET_CHARS}', '{fixed.LEET_AS}')",
    "dot_variants": lambda t: f"regexp_replace({t}, '{fixed.DOT_VARIANTS}', '.', 'g')",
    "letter_dots": lambda t: _between(t, r"\.+"),
    "spaced_letters": _spaced,
    "punctuation": lambda t: _chars(t, "i = 1 OR c <> cs[i - 1] OR regexp_matches(c, '[a-zA-Z0-9]')"),
    "separators": _separators,
    "brackets": lambda t: _between(t, r"[()\[\]{{}}]+".replace("{{", "{").replace("}}", "}")),
    "inline_separators": lambda t: _between(t, r"[*_''\-|]"),
}


def _repeats(t: str) -> str:
    return _chars(t, "i < 3 OR c <> cs[i - 1] OR c <> cs[i - 2] OR c IN (chr(13), chr(133), chr(8232), chr(8233))")


def _chain(start: str, key: str, steps) -> str:
    """CTEs that apply ``steps`` to the text of ``start``; the last is ``normalized``."""
    names = [start, *(f"step{i}" for i in range(1, len(steps))), "normalized"]
    return ", ".join(f"{names[i + 1]} AS (SELECT {key}, {step('text')} AS text FROM {names[i]})" for i, step in enumerate(steps))


_NORMALIZED = f"{_LINES}, {_chain('lines', 'msg_id', list(_STEPS.values()))}"


@query(f"WITH {_NORMALIZED} SELECT msg_id, text AS normalized FROM normalized")
def norm_full(spark, sf_dir):
    return lines(spark, sf_dir).select("msg_id", normalize.normalize(F.col("text")).alias("normalized"))


def _step_query(name: str, step: Callable, sql: Callable[[str], str], letters: str, signs: str) -> None:
    """One step over lines in which ``letters`` are replaced by the ``signs`` that it works on."""
    quoted = signs.replace("'", "''")

    def run(spark, sf_dir):
        return lines(spark, sf_dir).select("msg_id", step(F.translate("text", letters, signs)).alias("normalized"))

    run.__name__ = f"norm_{name}"
    query(f"WITH {_LINES}, t AS (SELECT msg_id, translate(text, '{letters}', '{quoted}') AS text FROM lines) SELECT msg_id, {sql('text')} AS normalized FROM t")(run)


_step_query("decompose", normalize.decompose, _STEPS["decompose"], "aeou", "àéöů")
_step_query("leet_sequences", normalize.decode_leet_sequences, _STEPS["leet_sequences"], "etaoins", "|_/\\'><")
_step_query("dot_variants", normalize.fold_dot_variants, _STEPS["dot_variants"], "aehiox", "()[]0x")
_step_query("letter_dots", normalize.drop_letter_dots, _STEPS["letter_dots"], "aey", "...")
_step_query("spaced_letters", normalize.join_spaced_letters, _STEPS["spaced_letters"], "eoa", "   ")
_step_query("punctuation", normalize.collapse_punctuation, _STEPS["punctuation"], "lts", "!!.")
_step_query("separators", normalize.tighten_separators, _STEPS["separators"], "etoa", "*-| ")
_step_query("brackets", normalize.drop_letter_brackets, _STEPS["brackets"], "eto", "([}")
_step_query("inline_separators", normalize.drop_letter_separators, _STEPS["inline_separators"], "eto", "*_'")
_step_query("repeats", normalize.collapse_repeats, _repeats, "einorst", "aaaaaaa")


# --- detectors -------------------------------------------------------------------------------------------------------


@query(f"""WITH {_LINES}, lex AS (SELECT unnest(['andthe', 'heat', 'ingtion', 'oner', 'there', 'tion']) AS w)
SELECT msg_id, (SELECT w FROM lex WHERE instr(text, w) > 0 ORDER BY instr(text, w) + length(w), length(w) DESC, w LIMIT 1) AS word FROM lines""")
def exact_match_first(spark, sf_dir):
    return lines(spark, sf_dir).select("msg_id", words.first_match(F.col("text"), strings(LEXICON.fuzzy)).alias("word"))


_TOKENS = "tok AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS token FROM documents)"
_NEAR = "levenshtein(token, w) <= CASE WHEN length(token) <= 4 THEN 1 WHEN length(token) <= 8 THEN 2 ELSE 3 END AND levenshtein(token, w) / greatest(length(token), length(w)) <= 0.35"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token")).filter("token <> ''").distinct()


@query(f"""WITH {_TOKENS}, lex AS (SELECT unnest(['andthe', 'heat', 'ingtion', 'oner', 'there', 'tion']) AS w)
SELECT token, EXISTS (SELECT 1 FROM lex WHERE {_NEAR} AND (length(token) > 4 OR length(w) <> length(token) OR levenshtein(token, w) <> 1)) AS hit FROM tok WHERE token <> ''""")
def fuzzy_match(spark, sf_dir):
    return _tokens(spark, sf_dir).select("token", words.fuzzy_match(F.col("token"), strings(LEXICON.fuzzy)).alias("hit"))


@query(f"""WITH {_TOKENS}, lex AS (SELECT unnest(['andthe', 'heat', 'ingtion', 'oner', 'there', 'tion']) AS w)
SELECT token, n.word, n.distance::INTEGER AS distance FROM (
  SELECT token, (SELECT {{'distance': levenshtein(token, w), 'word': w}} FROM lex WHERE {_NEAR} ORDER BY levenshtein(token, w), w LIMIT 1) AS n FROM tok WHERE token <> '') WHERE n IS NOT NULL""")
def nearest_match(spark, sf_dir):
    near = _tokens(spark, sf_dir).withColumn("n", words.nearest_word(F.col("token"), strings(LEXICON.fuzzy))).filter("n is not null")
    return near.select("token", "n.word", F.col("n.distance").cast("int").alias("distance"))


_DICTIONARY = "dict AS (SELECT word FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE length(word) > 2 GROUP BY word HAVING count(DISTINCT doc_id) >= 40)"


@query(f"""WITH {_TOKENS}, {_DICTIONARY}
SELECT token, CASE length(token) WHEN 1 THEN true WHEN 2 THEN token IN ('am', 'an', 'as', 'at', 'be', 'by', 'do', 'go', 'he', 'hi', 'if', 'in', 'is', 'it', 'my', 'no', 'of', 'oh', 'ok', 'on', 'or', 'so', 'to', 'up', 'us', 'we', 'ye')
  ELSE token IN (SELECT word FROM dict) END AS common FROM tok WHERE token <> ''""")
def common_word_filter(spark, sf_dir):
    rows = words.with_common_words(_tokens(spark, sf_dir), F.array("token"), dictionary(spark, sf_dir), "token", "known")
    return rows.select("token", words.is_common(F.col("token"), F.col("known")).alias("common"))


@query(r"""SELECT page_id, list_transform(regexp_extract_all(url, '(?i)\b(?:[a-z0-9-]+\s*(?:\.|\(dot\)|\[dot]|dot|,|-|_|\*)\s*)+(?:com|net|org|io|gg|xyz|me|tv|to|co|info|online|site|store|club|live|dev|app|ai|shop)(?:\s*:\s*\d{1,5})?\b'), lambda h: lower(h)) AS direct,
  list_transform(regexp_extract_all(url, '(?i)\b[a-z0-9-]{3,}(?:com|net|org|xyz|info|online|site|store|club|live|dev|app|shop)\b'), lambda h: lower(h)) AS squished FROM pages""".replace(" AS direct", " AS d").replace(" AS squished", " AS s").replace("SELECT page_id,", "SELECT page_id, array_to_string(d, ' ') AS direct, array_to_string(s, ' ') AS squished FROM (SELECT page_id,") + ")")
def domain_hits(spark, sf_dir):
    tlds = Moderator().tlds
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(domains.direct_hits(F.col("url"), tlds), " ").alias("direct"), F.array_join(domains.squished_hits(F.col("url"), tlds), " ").alias("squished"))


@query(rf"""WITH {_LINES}, t AS (SELECT msg_id, CASE msg_id % 3 WHEN 0 THEN text WHEN 1 THEN 'Join ' || text || ', 2024' ELSE text || ' discord . gg/' || user_id END AS text FROM lines)
SELECT msg_id, regexp_matches(text, '(?i)discord\s*(?:\.|\(dot\)|\[dot]|dot|,|-|_|\*|\s)+(?:gg/\w+|com/invite/\w+)') AS discord,
  regexp_matches(text, '(?i)(?:join\s+(?:my\s+)?server|\bip:\s*[a-z0-9.\s]+|\bjoin\s+\w+(?:\s*,?\s*\w+)+[,.:]\s*\d{{3,5}})') AS invite FROM t""")
def invite_hits(spark, sf_dir):
    text = F.when(F.col("msg_id") % 3 == 0, F.col("text")).when(F.col("msg_id") % 3 == 1, F.concat(F.lit("Join "), "text", F.lit(", 2024"))).otherwise(F.concat("text", F.lit(" discord . gg/"), "user_id"))
    return lines(spark, sf_dir).withColumn("text", text).select("msg_id", domains.discord_invite(F.col("text")).alias("discord"), domains.invite_phrase(F.col("text")).alias("invite"))


def _common(word: str) -> str:
    """SQL: ``is_common`` with the table dict."""
    two = ", ".join(f"'{w}'" for w in fixed.TWO_LETTER_WORDS)
    return f"CASE length({word}) WHEN 0 THEN false WHEN 1 THEN {word} BETWEEN 'a' AND 'z' WHEN 2 THEN {word} IN ({two}) ELSE regexp_full_match({word}, '[0-9]{{1,4}}') OR {word} IN (SELECT word FROM dict) END"


_LEX = "lex AS (SELECT unnest(['andthe', 'heat', 'ingtion', 'oner', 'there', 'tion']) AS w)"


def _fuzzy(word: str) -> str:
    near = _NEAR.replace("token", word)
    return f"EXISTS (SELECT 1 FROM lex WHERE {near} AND (length({word}) > 4 OR length(w) <> length({word}) OR levenshtein({word}, w) <> 1))"


_VERDICTS = f"""verdicts AS (
  SELECT t, t <> '' AND NOT {_common("t")} AND (t IN ('that', 'thewith') OR length(t) >= 3 AND {_fuzzy("t")}
    OR coalesce((SELECT length(w) >= 4 AND (instr(t, w) = 1 OR instr(t, w) + length(w) - 1 = length(t)) OR length(w) = 3 AND instr(t, w) + length(w) - 1 = length(t)
                 FROM lex WHERE instr(t, w) > 0 ORDER BY instr(t, w) + length(w), length(w) DESC, w LIMIT 1), false)) AS bad
  FROM (SELECT DISTINCT t FROM trimmed)
)"""


@query(f"""WITH {_TOKENS}, {_DICTIONARY}, {_LEX}, trimmed AS (SELECT token AS t FROM tok WHERE token <> ''), {_VERDICTS} SELECT t AS token, bad FROM verdicts""")
def token_test(spark, sf_dir):
    rows = words.with_common_words(_tokens(spark, sf_dir), F.array("token"), dictionary(spark, sf_dir), "token")
    return rows.select("token", words.bad_token(F.col("token"), F.col("common"), LEXICON).alias("bad"))


@query(f"WITH {_LINES}, lex AS (SELECT unnest(['andthe', 'heat', 'ingtion', 'oner', 'there', 'tion']) AS w) SELECT msg_id, EXISTS (SELECT 1 FROM lex WHERE instr(text, w) > 0) AS hit FROM lines")
def contains_any(spark, sf_dir):
    return lines(spark, sf_dir).select("msg_id", words.contains_any(F.col("text"), strings(LEXICON.fuzzy)).alias("hit"))


#: The word tests over the table normalized, with the tables dict and lex.
_WORDS = rf"""squeezed AS (SELECT msg_id, lower({_repeats("text")}) AS text FROM normalized),
split AS (SELECT msg_id, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS ts, list_filter(string_split_regex(regexp_replace(text, '[^a-z\s]', '', 'g'), '\s+'), lambda t: t <> '') AS ls FROM squeezed),
trimmed AS (SELECT msg_id, regexp_replace(u, '^[^a-z]+|[^a-z]+$', '', 'g') AS t FROM (SELECT msg_id, unnest(ts) AS u FROM split)), {_VERDICTS},
blocked AS (SELECT DISTINCT msg_id FROM trimmed JOIN verdicts USING (t) WHERE bad),
letters AS (SELECT msg_id, i, l, coalesce(sum(length(l)) OVER (PARTITION BY msg_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, {_common("l")} AS common
  FROM (SELECT msg_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM split)),
hits AS (SELECT msg_id, w, instr(array_to_string(ls, ''), w) - 1 AS p FROM split, lex WHERE instr(array_to_string(ls, ''), w) > 0),
covers AS (SELECT h.msg_id, w, p, min(pos) AS head, string_agg(l, '' ORDER BY i) AS blob, count(*) AS n, bool_and(common) AS all_common
  FROM hits h JOIN letters x ON x.msg_id = h.msg_id AND pos < p + length(w) AND pos + length(l) > p GROUP BY ALL),
spread AS (SELECT DISTINCT msg_id FROM covers WHERE NOT {_common("blob")} AND NOT (all_common AND p > head) AND NOT (n = 1 AND p > head AND p - head + length(w) < length(blob))),
rests AS (SELECT msg_id, string_agg(l, '' ORDER BY i) FILTER (NOT common) AS r FROM letters GROUP BY msg_id),
loose AS (SELECT msg_id FROM rests WHERE length(r) >= 3 AND {_fuzzy("r")})"""
_BAD = "msg_id IN (SELECT msg_id FROM blocked) OR len(ts) = 2 AND array_to_string(ts, '') IN ('that', 'thewith')"
_OBFUSCATED = "msg_id IN (SELECT msg_id FROM spread) OR msg_id IN (SELECT msg_id FROM loose)"


@query(f"WITH {_NORMALIZED}, {_DICTIONARY}, {_LEX}, {_WORDS} SELECT msg_id, {_BAD} AS bad, {_OBFUSCATED} AS obfuscated FROM split")
def word_list_matches(spark, sf_dir):
    rows = lines(spark, sf_dir).select("msg_id", normalize.collapse_repeats(normalize.normalize(F.col("text"))).alias("text"))
    rows = words.with_common_words(rows, words.candidates(F.col("text"), LEXICON), dictionary(spark, sf_dir), "msg_id")
    return rows.select("msg_id", words.bad_message(F.col("text"), F.col("common"), LEXICON).alias("bad"), words.obfuscated(F.col("text"), F.col("common"), LEXICON).alias("obfuscated"))


def _domains(texts: str, key: str, *names: str) -> str:
    """SQL: the table sites (key, hit) over ``texts`` (key, text), with the table dict; ``names`` are those of present users."""
    present = ", ".join(f"'{n}'" for n in names or ("",))
    return rf"""tlds AS (SELECT unnest([{", ".join(f"'{t}'" for t in fixed.TLDS)}]) AS tld), squeezed_texts AS (SELECT {key}, {_repeats("text")} AS text FROM {texts}),
site_hits AS (SELECT {key}, false AS joined, lower(unnest(regexp_extract_all(text, '(?i)\b(?:[a-z0-9-]+\s*(?:{fixed.SEPARATORS})\s*)+(?:{"|".join(fixed.TLDS)})(?:\s*:\s*\d{{1,5}})?\b'))) AS h FROM squeezed_texts
  UNION ALL SELECT {key}, true, lower(unnest(regexp_extract_all(text, '(?i)\b[a-z0-9-]{{3,}}(?:{"|".join(t for t in fixed.TLDS if len(t) > 2)})\b'))) FROM squeezed_texts),
site_labels AS (SELECT DISTINCT h, left(h, length(h) - length(tld)) AS part FROM site_hits JOIN tlds ON joined AND length(h) > length(tld) AND suffix(h, tld)),
fine AS (SELECT DISTINCT h FROM site_labels WHERE part IN ({present}) OR {_common("part")}),
behind AS (SELECT DISTINCT h, trim(regexp_extract(h, '(?s)[,_\-*](.*)$', 1)) AS part FROM site_hits WHERE NOT joined AND length(h) - length(translate(h, '.,_-*', '')) = 1 AND NOT contains(h, '.')),
blocked_sites AS (SELECT DISTINCT {key} FROM site_hits WHERE h NOT IN ({present}) AND NOT {_common("h")}
  AND CASE WHEN joined THEN h NOT IN (SELECT h FROM fine) ELSE h NOT IN (SELECT h FROM behind WHERE {_common("part")}) END),
sites AS (SELECT {key}, bool_or({key} IN (SELECT {key} FROM blocked_sites) OR regexp_matches(text, '(?i)discord\s*(?:{fixed.SEPARATORS}|\s)+(?:gg/\w+|com/invite/\w+)')
  OR regexp_matches(text, '(?i)(?:join\s+(?:my\s+)?server|\bip:\s*[a-z0-9.\s]+|\bjoin\s+\w+(?:\s*,?\s*\w+)+[,.:]\s*\d{{3,5}})')) AS hit FROM squeezed_texts GROUP BY {key})"""


@query(f"WITH {_DICTIONARY}, texts AS (SELECT page_id, url AS text FROM pages), {_domains('texts', 'page_id', 'example.com')} SELECT page_id, hit FROM sites")
def domain_matches(spark, sf_dir):
    tlds, names = Moderator().tlds, strings(("example.com",))
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("text"))
    rows = words.with_common_words(rows, domains.domain_candidates(F.col("text"), tlds), dictionary(spark, sf_dir), "page_id")
    return rows.select("page_id", domains.domain(F.col("text"), F.col("common"), names, ModerationConfig(), tlds).alias("hit"))


# --- stateful rules --------------------------------------------------------------------------------------------------

_RATE = """SELECT event_id AS msg_id, in_window FROM (
  SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN UNBOUNDED PRECEDING AND 86400001 PRECEDING) AS in_window
  FROM (SELECT event_id, user_id, epoch_ms(ts) AS ms FROM events))"""


@query(_RATE)
def rate_limit(spark, sf_dir):
    return limits.rate_counts(events(spark, sf_dir), 86400).select("msg_id", F.col("in_window").cast("long").alias("in_window"))


@query(_RATE)
def rate_limit_stream(spark, sf_dir):
    """The rate rule as a stream over the events, read to its end."""
    from modengine.streaming.limits import rate_counts_stream
    from modengine.streaming.run import run_to_end

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.col("event_id").alias("msg_id"), "ts", F.col("user_id").cast("string").alias("user_id"))
    return run_to_end(rate_counts_stream(rows, 86400), "rate").select("msg_id", "in_window")


@query("""WITH e AS (SELECT event_id, user_id, epoch_ms(ts) AS ms, event_type FROM events)
SELECT a.event_id AS msg_id FROM e a JOIN e b ON b.user_id = a.user_id AND b.ms BETWEEN a.ms - 86400000 AND a.ms AND (b.ms < a.ms OR b.event_id < a.event_id)
 AND 1 - levenshtein(a.event_type, b.event_type) / greatest(length(a.event_type), length(b.event_type)) >= 0.85 GROUP BY a.event_id HAVING count(*) >= 2""")
def flood(spark, sf_dir):
    return limits.flooded(events(spark, sf_dir), 86400, 0.85, 2)


# --- decisions and reports -------------------------------------------------------------------------------------------


@query(f"WITH {_DECISIONS} SELECT msg_id, user_id, rule IS NOT NULL AS blocked, rule FROM decided")
def decisions_pre(spark, sf_dir):
    return decisions(spark, sf_dir).select("msg_id", "user_id", "blocked", "rule")


_SCRIPTS = "|".join(rf"[\x00-\x7F\p{{{s.capitalize()}}}]*" for s in rules.SCRIPTS)
_RUN = " AND ".join(f"c = cs[i - {n}]" for n in range(1, 6))
_BEFORE = rf"""CASE WHEN regexp_matches(text, '[^\x{{0000}}-\x{{00FF}}]') THEN 'Illegal Characters' WHEN regexp_matches(text, '{_TAG}') THEN 'MiniMessage'
    WHEN regexp_matches(text, '{_COLOR}') THEN 'Color Code' WHEN {_UTF16} > 120 THEN 'Message Too Long'
    WHEN {_chars("text", f"i > 5 AND {_RUN} AND c NOT IN (chr(13), chr(133), chr(8232), chr(8233))")} <> '' THEN 'Repeated Character Spam'
    WHEN regexp_matches(text, '{_IP}') THEN 'IP' END"""
_CUSTOM = "regexp_matches(n, '[A-Z]{9,}')"
_MIXED = rf"len(list_filter(string_split_regex(n, '[\s\x0B\x1C-\x1F]+'), lambda t: NOT regexp_full_match(t, '(?:{_SCRIPTS})'))) > 0"
_SITES = "texts AS (SELECT msg_id, text FROM lines UNION ALL SELECT msg_id, text FROM normalized)"
_WHOLE = "SELECT msg_id, sec, user_id, lines.text, normalized.text AS n, ts, hit FROM lines JOIN normalized USING (msg_id) JOIN split USING (msg_id) JOIN sites USING (msg_id)"
#: FULL's rules over lines without users and dictionary, in order.
_DRY = rf"""{_NORMALIZED}, dict AS (SELECT '' AS word WHERE false), {_LEX}, {_WORDS}, {_SITES}, {_domains("texts", "msg_id")}, whole AS ({_WHOLE}),
decided AS (SELECT msg_id, coalesce({_BEFORE}, CASE WHEN hit THEN 'Domain' WHEN {_BAD} OR {_OBFUSCATED} THEN 'Swear' WHEN {_CUSTOM} THEN 'Custom: shout' WHEN {_MIXED} THEN 'Mixed Script' END) AS rule FROM whole)"""
_REPLIES = {
    "Illegal Characters": FULL.whitelist_message, "MiniMessage": FULL.tags_message, "Color Code": FULL.colors_message, "Message Too Long": FULL.length_message.replace("%max%", "120"),
    "Repeated Character Spam": FULL.repeats_message, "IP": FULL.ip_message, "Rate Limit": FULL.rate_message, "Flood": FULL.flood_message, "Domain": FULL.domain_message, "Swear": FULL.words_message,
    "Server Name": FULL.server_name_message, "Custom: shout": FULL.custom_rules[0].block_message, "Mixed Script": FULL.mixed_message,
}
_REPLY = "CASE rule " + " ".join("WHEN '{}' THEN '{}'".format(rule, reply.replace("'", "''")) for rule, reply in _REPLIES.items()) + " END"
#: All of FULL's rules: those on users see what earlier rules let pass, and floods only what is not over the rate.
_DECIDED = rf"""{_NORMALIZED}, {_DICTIONARY}, {_LEX}, {_WORDS}, {_SITES}, {_domains("texts", "msg_id", "user1", "user22")},
whole AS (SELECT *, user_id::BIGINT % 17 = 0 AS bypassed, {_BEFORE} AS pre, lower({_repeats("n")}) AS squeezed_n FROM ({_WHOLE})),
paced AS (SELECT msg_id, user_id, sec, n, row_number() OVER (PARTITION BY user_id ORDER BY sec, msg_id) - count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN UNBOUNDED PRECEDING AND 61 PRECEDING) > 8 AS fast
  FROM whole WHERE pre IS NULL AND NOT bypassed),
calm AS (SELECT * FROM paced WHERE NOT fast),
floods AS (SELECT a.msg_id FROM calm a JOIN calm b ON b.user_id = a.user_id AND b.sec BETWEEN a.sec - 120 AND a.sec AND (b.sec < a.sec OR b.msg_id < a.msg_id)
  AND (a.n = b.n OR 1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)) >= 0.85) GROUP BY a.msg_id HAVING count(*) >= 2),
named AS (SELECT *, CASE WHEN regexp_matches(n, '[\r\x{{85}}\x{{2028}}\x{{2029}}]') THEN NULL WHEN regexp_matches(squeezed_n, '\benter\b') THEN 'enter' WHEN regexp_matches(squeezed_n, '\bthand\b') THEN 'thand' END AS name FROM whole),
decided AS (SELECT msg_id, user_id, bypassed, name, CASE WHEN bypassed THEN NULL WHEN pre IS NOT NULL THEN pre WHEN msg_id IN (SELECT msg_id FROM paced WHERE fast) THEN 'Rate Limit' WHEN msg_id IN (SELECT msg_id FROM floods) THEN 'Flood'
  WHEN hit THEN 'Domain' WHEN {_BAD} OR {_OBFUSCATED} THEN 'Swear' WHEN name IS NOT NULL THEN 'Server Name' WHEN {_CUSTOM} THEN 'Custom: shout' WHEN {_MIXED} THEN 'Mixed Script' END AS rule FROM named)"""


@query(f"WITH {_DECIDED} SELECT msg_id, user_id, bypassed, rule IS NOT NULL AS blocked, rule, replace({_REPLY}, '%name%', coalesce(name, '')) AS block_message FROM decided")
def decisions_full(spark, sf_dir):
    """All rules, with word lists, names, a dictionary, limits and exempt users."""
    moderator = Moderator(FULL, LEXICON, ("Enter", "thand"), ("user1", "user22"))
    exempt = spark.range(0, 97, 17).select(F.col("id").cast("string").alias("user_id"))
    return moderator.decide(lines(spark, sf_dir), dictionary(spark, sf_dir), exempt).select("msg_id", "user_id", "bypassed", "blocked", "rule", "block_message")


@query(f"WITH {_DRY} SELECT msg_id, rule IS NOT NULL AS blocked, rule FROM decided")
def dry_run_decisions(spark, sf_dir):
    """All rules in order, but for those on users and the dictionary."""
    return dry_run(Moderator(FULL, LEXICON), lines(spark, sf_dir).select("msg_id", "text")).select("msg_id", "blocked", "rule")


@query(f"WITH {_DECISIONS} SELECT count(*) AS checked, count(rule) AS blocked, round(100.0 * count(rule) / count(*), 2)::DOUBLE AS block_rate FROM decided")
def moderation_summary(spark, sf_dir):
    return reports.summary(decisions(spark, sf_dir))


@query(f"WITH {_DECISIONS} SELECT user_id, violation_count, last_violation FROM stats")
def violations_by_user(spark, sf_dir):
    return reports.user_stats(found(spark, sf_dir)).withColumn("last_violation", seconds("last_violation"))


@query(f"WITH {_DECISIONS} SELECT user_id, violation_count, last_violation FROM stats")
def merged_stats(spark, sf_dir):
    """The statistics built in two steps, as an upsert would."""
    rows = found(spark, sf_dir)
    first = reports.user_stats(rows.filter("id % 2 = 0"))
    return reports.merge_stats(first, rows.filter("id % 2 = 1")).withColumn("last_violation", seconds("last_violation"))


@query(f"WITH {_DECISIONS} SELECT row_number() OVER (ORDER BY violation_count DESC, user_id) AS rank, user_id, violation_count, last_violation FROM stats QUALIFY rank BETWEEN 11 AND 20")
def top_violators_page(spark, sf_dir):
    return reports.top_violators(reports.user_stats(found(spark, sf_dir)), "2").withColumn("last_violation", seconds("last_violation"))


@query(f"WITH {_DECISIONS} SELECT row_number() OVER (ORDER BY sec DESC, id DESC) AS rank, message, reason, sec FROM found WHERE user_id = '5' QUALIFY rank <= 10")
def history_page(spark, sf_dir):
    return reports.history(found(spark, sf_dir), "5", "x").select("rank", "message", "reason", seconds("ts").alias("sec"))


@query(f"WITH {_DECISIONS} SELECT id, user_id, reason, sec FROM found QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, id DESC) <= 5")
def violations_trim(spark, sf_dir):
    return reports.newest(found(spark, sf_dir), 5).select("id", "user_id", "reason", seconds("ts").alias("sec"))


@query(f"WITH {_DECISIONS} SELECT reason, count(*) AS violations, count(DISTINCT user_id) AS users FROM found GROUP BY reason")
def violations_by_rule(spark, sf_dir):
    return reports.violations_by_rule(found(spark, sf_dir))


@query(f"WITH {_DECISIONS} SELECT user_id, violation_count, last_violation FROM stats WHERE user_id = '7'")
def user_report(spark, sf_dir):
    return reports.one_user(reports.user_stats(found(spark, sf_dir)), "7").withColumn("last_violation", seconds("last_violation"))


@query(f"""WITH {_DECISIONS} SELECT '&c' || row_number() OVER (ORDER BY violation_count DESC, user_id) || '. &fuser' || user_id || ' &8- &c' || violation_count || ' violations &7(last: never)' AS line
FROM stats QUALIFY row_number() OVER (ORDER BY violation_count DESC, user_id) <= 10""")
def report_lines(spark, sf_dir):
    top = reports.top_violators(reports.user_stats(found(spark, sf_dir)))
    template = "&c%rank%. &f%player% &8- &c%violations% violations &7(last: %last%)"
    values = {"rank": F.col("rank"), "player": F.concat(F.lit("user"), F.col("user_id")), "violations": F.col("violation_count"), "last": F.lit(None).cast("string")}
    return top.select(reports.render(template, values).alias("line"))


@query(f"WITH {_DECISIONS} SELECT '[' || strftime(make_timestamp(sec * 1000000), '%Y-%m-%d %H:%M:%S') || '] user' || user_id || ' (' || user_id || ') | ' || rule || ' | ' || text AS value FROM decided WHERE rule IS NOT NULL")
def audit_log(spark, sf_dir):
    return audit_lines(decisions(spark, sf_dir))


# --- gates, lists, sources -------------------------------------------------------------------------------------------


@query("SELECT event_id AS msg_id, user_id::VARCHAR AS user_id, user_id % 17 = 0 OR user_id IN (3, 5) AS bypassed FROM events")
def bypass_gate(spark, sf_dir):
    rows = events(spark, sf_dir)
    ids = rows.select("user_id").distinct()
    exempt = gates.bypass_users(ids.filter("user_id % 17 = 0"), spark.createDataFrame([("3",), (None,)], "user_id string"), spark.createDataFrame([("5", "n", True), ("6", "m", False)], "user_id string, name string, is_op boolean"), ops=True)
    return gates.bypass_flag(rows, exempt).select("msg_id", "user_id", "bypassed")


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN upper(c_name) ELSE 'nobody' END AS name, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS user_id
FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 2 = 1 OR c_name IS NOT NULL""")
def name_resolution(spark, sf_dir):
    users = _users(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"))
    asked = orders.join(users.select(F.col("user_id").alias("key"), "name"), "key", "left").filter("key % 2 = 1 or name is not null")
    asked = asked.select("id", F.when(F.col("key") % 2 == 0, F.upper("name")).otherwise(F.lit("nobody")).alias("name"))
    return gates.resolve_names(asked, users).select("id", "name", "user_id")


@query("SELECT c_custkey * 1000000007 AS user_id, left((c_custkey * 1000000007)::VARCHAR, 8) AS name FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
def display_names(spark, sf_dir):
    users = _users(spark, sf_dir)
    ids = users.select(F.when(F.col("user_id") % 2 == 1, F.col("user_id") * 1000000007).otherwise(F.col("user_id")).alias("user_id"))
    return gates.display_names(ids, users).select("user_id", "name")


@query("""WITH w AS (SELECT DISTINCT lower(p_type) AS word FROM part UNION SELECT 'new word')
SELECT word, 'fuzzy' AS kind FROM w WHERE word <> (SELECT min(lower(p_type)) FROM part) UNION ALL SELECT DISTINCT lower(p_brand), 'basic' FROM part""")
def lexicon_admin(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    fuzzy = part.select(F.lower("p_type").alias("word"), F.lit(2).alias("level")).distinct()
    first = fuzzy.agg(F.min("word")).first()[0]
    fuzzy = lexicon.remove_word(lexicon.add_word(lexicon.add_word(fuzzy, "New Word"), first), first)
    return lexicon.list_words(fuzzy, part.select(F.lower("p_brand").alias("word")).distinct())


@query("SELECT DISTINCT lower(p_type) AS word FROM part WHERE starts_with(lower(p_type), 'eco')")
def prefix_completion(spark, sf_dir):
    return lexicon.complete(table(spark, sf_dir, "part").select(F.lower("p_type").alias("word")).distinct(), "ECO")


@query("SELECT u AS user_id FROM (SELECT DISTINCT user_id AS u FROM events WHERE user_id % 3 = 0 AND user_id <> 9) UNION SELECT 1")
def user_set_admin(spark, sf_dir):
    ids = table(spark, sf_dir, "events").filter("user_id % 3 = 0").select("user_id").distinct()
    return lexicon.set_user(lexicon.toggle_user(lexicon.set_user(ids, 9, True), 9), 1, True)


_PRIVATE = r"^(?i:/(?:msg|tell|w|whisper|reply|r))[\s\x0B]+([^\s\x0B]+)[\s\x0B]+([^\n\r\x{85}\x{2028}\x{2029}]*)$"


@query(f"""SELECT conv_id, turn, regexp_extract(raw, '{_PRIVATE}', 2) AS text FROM (
  SELECT conv_id, turn, (CASE conv_id % 3 WHEN 0 THEN '/Msg bob ' WHEN 1 THEN '/reply ' ELSE '/say ' END) || text AS raw FROM conversations) WHERE regexp_matches(raw, '{_PRIVATE}')""")
def private_message_source(spark, sf_dir):
    """All private messages; a line break may be a blank before the message."""
    rows = table(spark, sf_dir, "conversations")
    raw = F.concat(F.when(F.col("conv_id") % 3 == 0, "/Msg bob ").when(F.col("conv_id") % 3 == 1, "/reply ").otherwise("/say "), "text")
    return private_messages(rows.select("conv_id", "turn", raw.alias("text")))


@query(f"""WITH lowered AS (SELECT DISTINCT lower(c_name) AS text FROM customer), decoded AS (SELECT {_STEPS["leet_chars"]("text")} AS text FROM lowered),
bare AS (SELECT {_STEPS["inline_separators"]("text")} AS text FROM decoded), short AS (SELECT {_repeats("text")} AS text FROM bare)
SELECT text AS variant FROM lowered UNION SELECT text FROM decoded UNION SELECT text FROM bare UNION SELECT text FROM short""")
def name_variants(spark, sf_dir):
    """All variants of names."""
    variants = _users(spark, sf_dir).select(F.explode(normalize.name_variants(F.col("name"))).alias("variant"))
    return variants.distinct()
