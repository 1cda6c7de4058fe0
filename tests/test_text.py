"""Normalization, detectors and rules: golden cases, and random strings against scalar models."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from modengine.config import CustomRule, ModerationConfig, custom_rules, java_regex_check, load_config
from modengine.functions import domains, fixed, normalize, rules, words
from modengine.functions.words import Lexicon

GOLDEN = [
    ("h3ll0", "hello"), ("b.a.d", "bad"), ("b a d", "bad"), ("a b cat", "ab cat"), ("foo(dot)com", "foocom"), ("foo dot com", "foocom"),
    ("192.168.1.1", "igzigbii"), ("phone PHone", "fone PHone"), ("b-a-d", "bad"), ("b - a", "b - a"), ("don't", "dont"), ("wow!!", "wowii"),
    ("go... now", "go. now"), ("x (y) z", "x (y) z"), ("ca​fé", "cafe"), ("|\\/|_|", "m_|"), ("", ""), ("ﬁx Ⅷ", "fix VIII"),
]


def column(spark, texts, make):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", make(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def test_golden_normalization(spark):
    texts = [a for a, _ in GOLDEN] + [None]
    assert column(spark, texts, normalize.normalize) == [b for _, b in GOLDEN] + [None]


def scalar_leet(t):
    out, i = [], 0
    while i < len(t):
        for sequence, letter in fixed.LEET:
            if t.startswith(sequence, i):
                out.append(letter)
                i += len(sequence)
                break
        else:
            out.append(dict(zip(fixed.LEET_CHARS, fixed.LEET_AS, strict=True)).get(t[i], t[i]))
            i += 1
    return "".join(out)


def test_leet_equals_scalar_model(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab01|/\\'><ph3_ 2\n") for _ in range(rng.randrange(14))) for _ in range(3000)]
    assert column(spark, texts, lambda t: normalize.decode_leet_chars(normalize.decode_leet_sequences(t))) == [scalar_leet(t) for t in texts]


def test_spaced_letters_equal_scalar_model(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB  1-") for _ in range(rng.randrange(14))) for _ in range(3000)]
    joined = [re.sub(r"\b([a-zA-Z])( [a-zA-Z])+\b", lambda m: m.group().replace(" ", ""), t, flags=re.ASCII) for t in texts]
    assert column(spark, texts, normalize.join_spaced_letters) == joined


def test_invite_pattern_equals_the_nested_one(spark):
    rng = random.Random(2)
    texts = ["join " + "".join(rng.choice("ab1,. :,  23") for _ in range(rng.randrange(16))) + rng.choice(["", "123", ", 4567"]) for _ in range(3000)]
    nested = re.compile(r"join\s+(?:my\s+)?server|\bip:\s*[a-z0-9.\s]+|\bjoin\s+\w+(?:\s*,?\s*\w+)+[,.:]\s*\d{3,5}", re.I | re.A)
    assert column(spark, texts, domains.invite_phrase) == [bool(nested.search(t)) for t in texts]
    assert column(spark, ["join " + "word " * 20_000 + "end, 1234"], domains.invite_phrase) == [True]


LEXICON = Lexicon.of(("badword", "frick", "dang", "zap"), ("crud", "notfix"))
DICTIONARY = ("the", "word", "danger", "not", "fix", "bad", "cat", "danish", "bandana")
DECISIONS = [
    ("badword", True), ("b@dw0rd", True), ("b a d w o r d", True), ("the badwordish", True), ("badwrod", True), ("danger", False), ("dang", True), ("dong", False),
    ("dan", True), ("daanng", True), ("xxzap", True), ("zapper", True), ("xzapx", False), ("crud", True), ("cruds", False), ("not fix", True), ("you not fix", False),
    ("bad word", True), ("fri ck", True), ("bandana ngo", False), ("hello", False), ("", False), ("  ", False),
]


def test_golden_word_decisions(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DECISIONS)], "i int, t string")
    rows = rows.withColumn("t", normalize.collapse_repeats(normalize.normalize(F.col("t"))))
    dictionary = spark.createDataFrame([(w,) for w in DICTIONARY], "word string")
    rows = words.with_common_words(rows, words.candidates(F.col("t"), LEXICON), dictionary, "i")
    hit = words.bad_message(F.col("t"), F.col("common"), LEXICON) | words.obfuscated(F.col("t"), F.col("common"), LEXICON)
    got = {r.i: r.hit for r in rows.select("i", hit.alias("hit")).collect()}
    assert {t: got[i] for i, (t, _) in enumerate(DECISIONS)} == dict(DECISIONS)


def test_first_match_equals_scalar_model(spark):
    rng = random.Random(3)
    lex = ["ab", "abc", "bc", "c", "cab", "aab"]
    texts = ["".join(rng.choice("abcx") for _ in range(rng.randrange(12))) for _ in range(500)]
    best = [min(((t.find(w) + len(w), -len(w), w) for w in lex if w in t), default=(0, 0, None))[2] for t in texts]
    assert column(spark, texts, lambda t: words.first_match(t, words.strings(lex))) == best


def test_lexicon_rejects_what_it_cannot_hold():
    with pytest.raises(ValueError):
        Lexicon.of(("é",))
    with pytest.raises(ValueError):
        Lexicon.of((), (f"w{i}" for i in range(words.MOST_WORDS + 1)))


@pytest.mark.parametrize(
    ("rule", "cases"),
    [
        (lambda t: rules.too_long(t, 3), {"abc": False, "abcd": True, "a😀": False, "ab😀": True}),
        (lambda t: rules.repeated_character(t, 5), {"aaaaa": False, "aaaaaa": True, "aaa\naaa": False, "aaaAAA": False}),
        (lambda t: domains.ip_address(t, ModerationConfig()), {"999.1.1.1": True, "1,2,3,4": True, "0x1.2.3.4": True, "1.2.3": False, "v1.2.3.4567": False}),
        (lambda t: domains.ip_address(t, ModerationConfig(ip_hex=False, ip_obfuscated=False)), {"1,2,3,4": False, "0xa.b.c.d": False, "1.2.3.4": True}),
        (lambda t: rules.illegal_characters(t, ("BASIC_LATIN", "GENERAL_PUNCTUATION", "NO_SUCH")), {"abc…": False, "é": True, "😀": True, "": False}),
        (rules.formatting_tag, {"<red>": True, "</B>": True, "<hover:show x='1'>": True, "<a b>": False, "a < b": False}),
        (rules.color_code, {"&a": True, "§K": True, "Âf": True, "&z": False, "&x&1&2&3&4&5&6": True, "& a": False}),
        (lambda t: rules.mixed_script(t), {"aб": False, "éб": True, "é б": False, "бג": True}),
        (lambda t: rules.server_name(t, ("Hyper", "abc")), {"at HYPER!": "hyper", "hyperx": None, "hyper\nx": None, "abc hyper": "abc", "éabc": "abc"}),
        (domains.discord_invite, {"discord.gg/abc": True, "discord (dot) com/invite/x": True, "discord gg": False}),
    ],
)
def test_rule_cases(spark, rule, cases):
    assert dict(zip(cases, column(spark, list(cases), rule), strict=True)) == cases
    assert not column(spark, [None], rule)[0]


def test_domains_with_names_and_dictionary(spark):
    cases = {"go to leaf.com": True, "leafcom": True, "neatshop": False, "RowanShop": False, "well,me": True, "so-to": False, "visit play.net:25565": True, "hello there": False, "danger.io": True}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    dictionary = spark.createDataFrame([("neat",), ("so",), ("danger",)], "word string")
    rows = words.with_common_words(rows, domains.domain_candidates(F.col("t"), fixed.TLDS), dictionary, "i")
    config = ModerationConfig()
    names = words.strings(["rowan"])
    got = {r.t: r.hit for r in rows.select("t", domains.domain(F.col("t"), F.col("common"), names, config, fixed.TLDS).alias("hit")).collect()}
    # "me" and "to" are two-letter words, of which only those of the fixed list are common
    assert got == cases | {"well,me": True}


def test_name_variants(spark):
    assert column(spark, ["N1ghtOwL_name", "Cooool"], normalize.name_variants) == [["n1ghtowl_name", "nightowl_name", "nightowlname"], ["cooool", "cool"]]


def test_config_loading(spark, caplog):
    document = {"max_message_length": {"max_length": 0, "enabled": "yes"}, "flood_detection": {"similarity_threshold": 1}, "character_whitelist": {"allowed_unicode_blocks": ["BASIC_LATIN"]}, "server_name_block_message": "no %name%", "custom_rules": [{"name": "a", "pattern": "x+"}, {"pattern": "("}, {"name": "none"}]}
    config = load_config(document, java_regex_check(spark))
    assert (config.max_length, config.length_enabled, config.flood_similarity, config.allowed_blocks) == (0, True, 1.0, ("BASIC_LATIN",))
    assert config.custom_rules == (CustomRule("a", "x+"),) and config.server_name_message == "no %name%"
    assert len([m for m in caplog.messages if "Invalid regex" in m or "max_length" in m]) == 2
    assert custom_rules(None) == () and ModerationConfig().problems() == []


def test_dictionary_is_looked_up_or_joined_alike(spark):
    texts = ["the cat sat", "the the cat 1234 12345", "no", "", None, "cat", "x " * 30000 + "cat"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    dictionary = spark.createDataFrame([("the",), ("cat",), ("cat",), ("1234",), ("12345",), ("no",), (None,)], "word string")
    found = [{r.i: (r.t, sorted(r.common)) for r in words.with_common_words(rows, words.tokens(F.col("t")), dictionary, "i", most=most).collect()} for most in (10, 3, 0)]
    assert found[0] == found[1] == found[2] and found[0][1][1] == ["12345", "cat", "the"] and found[0][4] == (None, [])
    empty = words.with_common_words(rows.filter("i < 0"), words.tokens(F.col("t")), dictionary.filter("word = ''"), "i")
    assert empty.columns == ["i", "t", "common"] and empty.count() == 0
