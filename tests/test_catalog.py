"""Registered queries against scalar models over small tables, where SQL says less than the operator."""

from __future__ import annotations

import re

from modengine.functions import fixed
from modengine.plans.catalog import QUERIES


def test_name_variants_are_whole(spark, tmp_path):
    names = ["Customer#000000001", "N1ght_Owl", "a-b'c", "Cooool--x", "x", "", None]
    spark.createDataFrame(list(enumerate(names)), "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    want = set()
    for name in filter(lambda n: n is not None, names):
        lower = name.lower()
        decoded = lower.translate(str.maketrans(fixed.LEET_CHARS, fixed.LEET_AS))
        bare = re.sub(r"(?<=[^\W\d_])[*_'\-|](?=[^\W\d_])", "", decoded)
        want |= {lower, decoded, bare, re.sub(r"(.)\1{2,}", r"\1\1", bare)}
    got = [r.variant for r in QUERIES["name_variants"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([*want, None], key=str) and {"customer#ooi", "nightowl", "abc", "cool--x"} <= want


def test_private_messages_with_line_breaks(spark, tmp_path):
    texts = ["bob hi there", "Esbo.\nDe. Los", "bob\r\n hi", "a\tb", "bob one\ntwo", "bob one\rtwo", "x\u2028y z", "bob x\u0085", "one", "", None, " bob  \n last "]
    rows = [(conv, turn, "user", t) for conv in range(3) for turn, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    message = re.compile(r"(?i)/(?:msg|tell|w|whisper|reply|r)\s+(\S+)\s+([^\n\r\x85\u2028\u2029]*)", re.ASCII)
    found = [(conv, turn, message.fullmatch(("/Msg bob ", "/reply ", "/say ")[conv] + t)) for conv, turn, _, t in rows if t is not None]
    got = [tuple(r) for r in QUERIES["private_message_source"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((conv, turn, m[2]) for conv, turn, m in found if m) and (1, 1, "De. Los") in got


def test_server_names_on_all_lines(spark, tmp_path):
    text = "the one\r\nder\r\nthe two\nnone\nder x"
    spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.msg_id % 1000000: r.name for r in QUERIES["rule_server_name"](spark, str(tmp_path)).collect()}
    assert got == {0: None, 1: None, 2: "the", 3: None, 4: None}
