"""Decisions, limits, gates, reports, lists, sources and streams."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from modengine.config import CustomRule, ModerationConfig
from modengine.functions.words import Lexicon
from modengine.operators import gates, lexicon, limits, reports
from modengine.operators.decide import Moderator, RuleSet, dry_run
from modengine.sources import lists, messages
from modengine.streaming import limits as streams
from modengine.streaming.run import run_to_end

START = datetime(2024, 1, 1)
SCHEMA = "msg_id long, ts timestamp, user_id string, text string"


def chatter(n=500, seed=0):
    rng, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += rng.choice([0, 0, 1, 3, 10, 40])
        rows.append((i, START + timedelta(seconds=at), rng.choice(["hot", "hot", "b", "c"]), rng.choice(["hello", "hallo", "other text", ""])))
    return rows


def simulate(rows, seconds, alike=None, least=0.85):
    recent, out = defaultdict(list), {}
    for i, ts, user, text in sorted(rows, key=lambda r: (r[1], r[0])):
        recent[user] = [m for m in recent[user] if m[0] >= ts - timedelta(seconds=seconds)]
        if alike is None:
            recent[user].append((ts, text))
            out[i] = len(recent[user])
        else:
            out[i] = sum(alike(text, t) >= least for _, t in recent[user])
            recent[user].append((ts, text))
    return out


def ratio(a, b):
    longer = max(len(a), len(b))
    return 1.0 if longer == 0 else 1 - streams._distance(a, b) / longer


@pytest.mark.parametrize("span", [2, 64])
def test_rate_equals_queue(spark, monkeypatch, span):
    monkeypatch.setattr(limits, "SPAN", span)
    rows = chatter()
    got = {r.msg_id: r.in_window for r in limits.rate_counts(spark.createDataFrame(rows, SCHEMA), 10).collect()}
    assert got == simulate(rows, 10)
    limited = {r.msg_id for r in limits.rate_limited(spark.createDataFrame(rows, SCHEMA), 3, 10).collect()}
    assert limited == {i for i, n in got.items() if n > 3}


@pytest.mark.parametrize("span", [2, 64])
def test_flood_equals_queue(spark, monkeypatch, span):
    monkeypatch.setattr(limits, "SPAN", span)
    rows = chatter(seed=1)
    got = {r.msg_id for r in limits.flooded(spark.createDataFrame(rows, SCHEMA), 30, 0.75, 2, "text").collect()}
    assert got == {i for i, n in simulate(rows, 30, ratio, 0.75).items() if n >= 2}


def test_streams_equal_queue(spark, tmp_path):
    rows = chatter(300, seed=2)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/m")
    source = lambda: spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/m")
    rate = {r.msg_id: r.in_window for r in run_to_end(streams.rate_counts_stream(source(), 10), "t").collect()}
    assert rate == simulate(rows, 10)
    flood = {r.msg_id: r.similar for r in run_to_end(streams.flood_counts_stream(source(), 30, 0.75, "text"), "t").collect()}
    assert flood == simulate(rows, 30, ratio, 0.75)


def test_stats_sink_repeats_safely(spark, tmp_path):
    sink = streams.stats_sink(f"file://{tmp_path}")
    found = lambda n: spark.createDataFrame([("a", START)] * n + [("b", START)], "user_id string, ts timestamp")
    sink(found(2), 0)
    sink(found(3), 1)
    sink(found(3), 1)
    got = {r.user_id: r.violation_count for r in spark.read.parquet(f"file://{tmp_path}/version=1").collect()}
    assert got == {"a": 5, "b": 2}


def test_first_rule_decides(spark):
    config = ModerationConfig(custom_rules=(CustomRule("zed", "z{3}", "no z"), CustomRule("off", "o", enabled=False)), mixed_enabled=True)
    moderator = Moderator(config, Lexicon.of(("frick",)), ("hyper",))
    texts = ["ok", "é" * 30, "<b>é", "<b>" + "x" * 30, "&aaaaaaaa", "aaaaaaa 1.2.3.4", "1.2.3.4", "leaf.com", "f.r.i.c.k", "on hyper", "zzz", None, "join my server"]
    want = [None, "Illegal Characters", "Illegal Characters", "MiniMessage", "Color Code", "Repeated Character Spam", "IP", "Domain", "Swear", "Server Name", "Custom: zed", None, "Domain"]
    rows = spark.createDataFrame([(i, START, "u", t) for i, t in enumerate(texts)], SCHEMA)
    got = {r.msg_id: r for r in moderator.decide(rows, spark.createDataFrame([("ok",)], "word string")).collect()}
    assert [got[i].rule for i in range(len(texts))] == want
    assert got[9].block_message == "&cPlease don't say other servers name (hyper)" and all(got[i].blocked == (w is not None) for i, w in enumerate(want))


def test_limits_see_only_what_passed(spark):
    config = ModerationConfig(rate_enabled=True, rate_max=2, rate_seconds=60, flood_enabled=True, flood_max=1, flood_seconds=60, domain_enabled=False)
    texts = [("a", "hello"), ("a", "é"), ("a", "hello"), ("a", "other"), (None, "x"), (None, "x"), (None, "x"), ("vip", "é"), ("b", "q")]
    rows = spark.createDataFrame([(i, START + timedelta(seconds=i), u, t) for i, (u, t) in enumerate(texts)], SCHEMA)
    exempt = spark.createDataFrame([("vip",)], "user_id string")
    got = {r.msg_id: (r.bypassed, r.rule) for r in Moderator(config).decide(rows, exempt=exempt).collect()}
    assert got == {0: (False, None), 1: (False, "Illegal Characters"), 2: (False, "Flood"), 3: (False, "Rate Limit"), 4: (False, None), 5: (False, None), 6: (False, None), 7: (True, None), 8: (False, None)}


def test_adding_rules_never_unblocks(spark):
    rows = spark.createDataFrame([(i, START, "u", t) for i, t in enumerate(["abc", "1.2.3.4", "ab cd " * 8, "<i>", "plain", ""])], SCHEMA)
    before = {r.msg_id for r in Moderator(ModerationConfig(length_enabled=False)).decide(rows).filter("blocked").collect()}
    after = {r.msg_id for r in Moderator(ModerationConfig()).decide(rows).filter("blocked").collect()}
    assert before < after
    assert RuleSet().add("x", lambda o, n, k: F.lit(True), "m", enabled=False).rules == []


def test_dry_run_counts_but_never_violates(spark):
    made = dry_run(Moderator(), spark.createDataFrame([(0, "1.2.3.4"), (1, "fine")], "msg_id long, text string"))
    assert reports.summary(made).first().asDict() == {"checked": 2, "blocked": 1, "block_rate": 50.0}
    assert reports.violations(made).count() == 0


def test_reports(spark):
    rows = [(i, f"u{i % 4}", f"m{i}", "IP" if i % 2 else "Swear", START + timedelta(seconds=i // 2)) for i in range(30)]
    found = spark.createDataFrame(rows, "id long, user_id string, message string, reason string, ts timestamp")
    stats = reports.user_stats(found)
    assert [(r.rank, r.user_id, r.violation_count) for r in reports.top_violators(stats, 1, 3).collect()] == [(1, "u0", 8), (2, "u1", 8), (3, "u2", 7)]
    assert [(r.rank, r.user_id) for r in reports.top_violators(stats, "2", 3).collect()] == [(4, "u3")]
    assert sorted(r.id for r in reports.newest(found, 2).collect()) == [22, 23, 24, 25, 26, 27, 28, 29]
    assert [r.message for r in reports.history(found, "u1", -1, 3).collect()] == ["m29", "m25", "m21"]
    merged = reports.merge_stats(reports.user_stats(found.filter("id < 10")), found.filter("id >= 10"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, stats.collect()))
    assert {(r.reason, r.violations, r.users) for r in reports.violations_by_rule(found).collect()} == {("IP", 15, 2), ("Swear", 15, 2)}
    assert [reports.page_number(x) for x in ("0", -1, "x", None, "3")] == [1, 1, 1, 1, 3]
    empty = spark.createDataFrame([], "blocked boolean")
    assert reports.summary(empty).first().asDict() == {"checked": 0, "blocked": 0, "block_rate": 0.0}
    line = spark.range(1).select(reports.render("%a% %b% %%", {"a": F.lit(1), "b": F.lit(None).cast("string")}), reports.percent(F.lit(2.345678)))
    assert tuple(line.first()) == ("1 never %%", "2.35")


def test_gates(spark):
    users = spark.createDataFrame([("1234567890", "Bob", True), ("x", "bob", False), ("y", "Al", False)], "user_id string, name string, is_op boolean")
    asked = spark.createDataFrame([("BOB",), ("al",), ("zoe",)], "name string")
    assert {r.name: r.user_id for r in gates.resolve_names(asked, users).collect()} == {"BOB": "1234567890", "al": "y", "zoe": None}
    ids = spark.createDataFrame([("y",), ("abcdefghij",)], "user_id string")
    assert {r.user_id: r.name for r in gates.display_names(ids, users).collect()} == {"y": "Al", "abcdefghij": "abcdefgh"}
    exempt = gates.bypass_users(ids.limit(0), None, users, ops=True)
    flags = gates.bypass_flag(spark.createDataFrame([(1, "1234567890"), (2, None), (3, "y")], "msg_id long, user_id string"), exempt)
    assert {r.msg_id: r.bypassed for r in flags.collect()} == {1: True, 2: False, 3: False}


def test_word_lists(spark):
    fuzzy = spark.createDataFrame([("one", 2)], "word string, level int")
    fuzzy = lexicon.add_word(lexicon.add_word(fuzzy, "TWO"), "one")
    assert sorted(map(tuple, fuzzy.collect())) == [("one", 2), ("two", 2)]
    assert lexicon.has_word(fuzzy, "Two") and not lexicon.has_word(lexicon.remove_word(fuzzy, "TWO"), "two")
    basic = spark.createDataFrame([("b",)], "word string")
    assert [tuple(r) for r in lexicon.list_words(fuzzy, basic).collect()] == [("b", "basic"), ("one", "fuzzy"), ("two", "fuzzy")]
    assert lists.lexicon(fuzzy, basic) == Lexicon(("one", "two"), ("b",))
    users = spark.createDataFrame([(1,)], "user_id long")
    assert sorted(r[0] for r in lexicon.toggle_user(users, 2).collect()) == [1, 2] and lexicon.toggle_user(users, 1).count() == 0
    assert [r[0] for r in lexicon.complete(fuzzy, "T").collect()] == ["two"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "words.txt").write_text("a, b,,c\n\n Dee ,a\n")
    assert sorted(r.word for r in lists.read_dictionary(spark, f"file://{tmp_path}/words.txt").collect()) == ["Dee", "a", "b", "c"]
    good = "0000aaaa-0000-0000-0000-00000000000B"
    (tmp_path / "white.json").write_text(f'[\n "{good}",\n "no id"]')
    kept = lists.read_user_set(spark, f"file://{tmp_path}/white.json")
    assert [r.user_id for r in kept.collect()] == [good.lower()]
    lists.write_user_set(kept, f"file://{tmp_path}/out")
    assert lists.read_user_set(spark, f"file://{tmp_path}/out").count() == 1
    (tmp_path / "broken.json").write_text("[oops")
    assert lists.read_user_set(spark, f"file://{tmp_path}/broken.json").count() == 0
    raw = spark.createDataFrame([("/MSG bob hi there",), ("/r hello world",), ("/say x y",), ("/w bob",)], "text string")
    assert sorted(r.text for r in messages.private_messages(raw).collect()) == ["hi there", "world"]
    decided = spark.createDataFrame([(1, START, "u", "Bob", "IP", "1.2.3.4", True), (2, START, "u", "Bob", None, "ok", False)], "msg_id long, ts timestamp, user_id string, user_name string, rule string, text string, blocked boolean")
    messages.write_audit(decided, f"file://{tmp_path}/audit")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/audit").collect()] == ["[2024-01-01 00:00:00] Bob (u) | IP | 1.2.3.4"]
    found = reports.violations(decided)
    messages.write_violations(found, f"file://{tmp_path}/violations")
    assert messages.read_violations(spark, f"file://{tmp_path}/violations").count() == 1
