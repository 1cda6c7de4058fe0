"""Quality rules, licences, token files, chat format and packing against brute force, with hard inputs."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from modengine.llm import chat, licenses, packing, quality, token_files, tokens
from modengine.llm.license_rules import RULES, Rule

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = [None, "", " \n\t\x0b", "one", "a b c d e a b c d e", "x " * 400, "Line\n\nLine\nother\n \nLine", "it's o'clock, 'tis... \"q\" don't!! a.'b'.", "tab\there  nbsp em", "été́ naïve Ünïcode İI ﬁ ½ x² ٣", "<|endoftext|> </s> 日本語 текст 😀", "  lead  double   triple \n\n end \n", "$" * 50 + " &&& word", "a" * 5000, "\x00\x7f\x1c\x85z"]


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, label string, n_words string"):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(2)
    rows = [(i, t, "en", "s", "l", "n") for i, t in enumerate(HARD)]
    for i in range(300):
        body = [f"{rng.choice('abcdefg')}{rng.randrange(300)}" for _ in range(rng.randrange(8, 80))]
        if i % 10 == 0:
            body = [w + "###" for w in body]
        if i % 15 == 0:
            body = body[:4] * 20
        rows.append((100 + i, "\n".join(" ".join(body[k : k + 7]) for k in range(0, len(body), 7)), None if i % 7 == 0 else "en", f"s{i % 2}", "l", "n"))
    return [*rows, rows[-1], (None, "no id here", "de", None, "l", "n")]


def brute_measures(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_measures_and_verdicts(spark, documents):
    rows = quality.quality_report(frame(spark, documents)).collect()
    assert len(rows) == len(documents)
    want = defaultdict(list)
    for d in documents:
        want[d[0]].append(brute_measures(d[1]))
    for r in rows:
        m = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert m in want[r.doc_id]
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        assert not (r.base_failed and r.kept)
    texts = {d[0]: d[1] or "" for d in documents}
    good = [r for r in rows if not r.base_failed and "###" not in texts[r.doc_id] and (r.doc_id or 0) >= 100]
    assert len(good) > 200 and all(r.kept for r in good)
    assert not any(r.kept for r in rows if texts[r.doc_id].count("###") > 5)


def test_quality_keeps_rows_and_columns(spark, documents):
    docs = frame(spark, documents)
    kept = {r.doc_id for r in quality.quality_report(docs).filter("kept").collect()}
    out = quality.keep_good(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept
    assert quality.keep_good(docs.limit(0)).count() == 0 and quality.quality_report(docs.limit(0)).count() == 0


def test_salted_limits_equal_broadcast_ones(spark, documents):
    measured = quality.measures(frame(spark, documents), "text", "m").cache()
    limits = quality.learned_limits(measured, "m")
    one, two = (sorted((r.doc_id or -1, r.kept) for r in quality.judged(measured, "m", "kept", limits, broadcast_groups=n).collect()) for n in (10, 0))
    assert one == two
    measured.unpersist()


def test_sketch_merging_is_addition_and_quantiles_are_close(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.integers(0, 3000, 4000), [0, 1, 63, 64, 10**12]])
    low = [r[0] for r in spark.createDataFrame([(int(v),) for v in values], "v long").select(quality.bucket(quality.F.col("v"))).collect()]
    assert all(b <= v < b * (1 + 1 / 32) + 1 for b, v in zip(low, values.tolist(), strict=True))
    rows = [("a", "s1", "m", b, 1) for b in low[::2]] + [("a", "s2", "m", b, 1) for b in low[1::2]]
    sketch = spark.createDataFrame(rows, "lang string, source string, measure string, bucket long, n long")
    q = quality._quantiles(quality.merged(sketch, ["lang"]), ["lang"]).first()
    exact = np.quantile(values, [0.1, 0.5, 0.9], method="inverted_cdf")
    assert q.total == len(values)
    assert all(e * 31 / 32 - 1 <= got <= e for got, e in zip((q.q10, q.q50, q.q90), exact, strict=True))


def test_license_base_phrases(spark):
    texts = [*HARD, "CC-BY. cc by, General\nPublic License all rights RESERVED cc  by", "acc by ccby cc byé générál public license", "© 2020 x. Licensed under the Apache License, Version 2.0; see LICENSE file", ("word " * 3000) + "all rights reserved"]
    rows = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, [(i, t, "", "", "", "") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        places = [(p, label) for phrase, label in licenses.BASE.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
    assert "apache-2.0" in rows[len(texts) - 2].labels.split(",") and "license-mention" in rows[len(texts) - 2].labels.split(",")


def test_license_rules_compile_and_keywords_do_not_hide_matches():
    assert len(RULES) > 200
    scanner = licenses.Scanner()
    examples = {"bsd-3-clause": "3-clause BSD license", "gpl-2.0-or-later": "GNU General Public License, version 2, or (at your option) any later version", "lgpl-2.1-only": "LGPL 2.1 only", "cc-by-nc-sa-4.0": "CC BY-NC-SA 4.0", "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy", "isc": "the ISC license", "odbl-1.0": "Open Database License v1.0", "wtfpl": "WTFPL", "unlicense": "The Unlicense", "reserved-de": "Alle Rechte vorbehalten"}
    for label, text in examples.items():
        assert label in {k[0] for k in scanner.scan(text.lower())[1]}, label
    for rule in RULES:
        licenses.whole_words(rule.pattern)


def test_suppression_equals_pairwise_definition():
    rng = random.Random(0)
    for _ in range(300):
        found = [(Rule(f"r{rng.randrange(4)}", rng.randrange(3), 1.0, (), ""), a, a + rng.randrange(1, 9)) for a in (rng.randrange(20) for _ in range(rng.randrange(12)))]
        kept = []
        for rule, a, b in sorted(found, key=lambda x: (-x[0].priority, x[1], -x[2], x[0].label)):
            if not any(c <= a and b <= d for _, c, d in kept):
                kept.append((rule, a, b))
        assert licenses.suppress(found) == kept


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_remembered_ids_equal_the_library(path, monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rng = random.Random(1)
    pool = ["word", "don't", "'s", "L'été", " ", "  ", "\n", "\n\n", ".", "...", "!?", "'", "''", ",'", "9", "12", "é", "ß", "È", "«a»", "–", "x.y", "\t", " ", "я", "́", "ª", "×", "_", "A"]
    texts = [t or "" for t in HARD] + ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    monkeypatch.setattr(tokens, "REMEMBERED", 500)
    encoder = tokens.Encoder(path)
    for i in range(0, len(texts), 200):
        for end in (None, 7):
            ids, ends = encoder.encode(pa.array(["cut off", None, *texts[i : i + 200]]).slice(1), end)
            own = [] if end is None else [end]
            at = np.concatenate([[0], ends])
            for text, a, b in zip(["", *texts[i : i + 200]], at[:-1], at[1:], strict=True):
                assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids + own, text
            assert len(ids) == ends[-1]
    assert encoder.encode(pa.array([], pa.string()))[0].tolist() == []
    # every pair of characters of all classes, and blanks around them
    edge = [*"aZéÿ×÷0٣.'’…€ \n\t\xa0\u2003\u3000\u1680\x85\x1cя́日😀ªſ_", "'s", "'ll", "\r\n"]
    texts = ["".join(x) for x in itertools.product(edge, repeat=3)]
    ids, ends = encoder.encode(pa.array(texts))
    for text, a, b in zip(texts, [0, *ends[:-1]], ends, strict=True):
        assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids, text


def ids_of(path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    return lambda text: np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_token_files_round_trip(spark, documents, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 4000)  # several parts
    encode, start, want = ids_of(BYTES), 0, []
    for d in sorted(documents, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or "")):
        ids = encode(d[1])
        want.append((d[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_files.token_round_trip(frame(spark, documents), BYTES).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.token_round_trip(frame(spark, documents).limit(0), BYTES).count() == 0


def test_token_files_have_the_layout(spark, documents, tmp_path):
    import pyarrow.parquet as pq

    token_files.write_token_files(frame(spark, documents), f"file://{tmp_path}/t", BYTES)
    parts = list((tmp_path / "t").glob("*.parquet"))
    meta = pq.ParquetFile(parts[0]).metadata
    encodings = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i).encodings for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in encodings["doc_id"] and any("RLE_DICTIONARY" in e for p, e in encodings.items() if p.startswith("tokens"))
    assert meta.row_group(0).column(0).has_offset_index and meta.row_group(0).column(0).has_column_index


def test_packing_places_every_piece(spark, documents):
    encode = ids_of(WORDS)
    rows = packing.pack(frame(spark, documents), WORDS, length=64, most_open=4).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    want = defaultdict(list)
    for d in documents:
        ids = encode(d[1])
        want[d[0]] += [(k, k * 64, len(ids[k * 64 : k * 64 + 64]), zlib.crc32(ids[k * 64 : k * 64 + 64].tobytes())) for k in range(-(-len(ids) // 64))]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(frame(spark, documents).limit(0), WORDS).count() == 0


def test_bins_are_best_fit_and_bounded():
    rng = random.Random(4)
    bins, free, opened = packing.OpenBins(100, 5), {}, 0
    for _ in range(2000):
        n = rng.randrange(1, 101)
        fits = {b: f for b, f in free.items() if f >= n}
        least = min(fits.values(), default=100)
        number, offset = bins.place(n)
        assert offset == 100 - least and (not fits or free[number] == least)
        free.pop(number, None)
        if least - n:
            if len(free) == 5:  # the fullest closes
                closed = min(free.values())
                gone = [b for b, f in free.items() if f == closed][-1]
                open_ = {b for stack in bins.by_free for b in stack}
                gone = next(b for b, f in free.items() if f == closed and b not in open_) if len([f for f in free.values() if f == closed]) > 1 else gone
                del free[gone]
            free[number] = least - n
        assert bins.open == len(free) <= 5
    lengths = [rng.randrange(1, 1500) for _ in range(20_000)]
    bins = packing.OpenBins()
    for n in lengths:
        bins.place(n)
    assert bins.made <= 1.02 * sum(lengths) / 2048


CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (1, 3, "assistant", "a<|end|>\nb"), (2, 1, "assistant", "two"), (2, 0, "system", "<|turn:0|>user\nx"), (3, 0, "user", "</s>[INST] ok [/INST]"), (3, 1, "assistant", "%3C%25 <s>[[INST]"), (4, 0, None, ""), (4, 0, "user\n<|end|>", "tie"), (4, 0, "assistant", "<<SYS>> <</SYS>> \\ %"), (None, 0, "assistant", "no id"), (5, 7, "assistant", "x" * 3000), (5, 7, "assistant", "x" * 3000)]


def test_chat_digest_equals_brute_force(spark):
    rows = chat.chat_digest(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    want = {}
    for conv in {c[0] for c in CHATS}:
        turns = sorted((t, r or "", x or "") for c, t, r, x in CHATS if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[conv] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == want
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_digest(empty).count() == 0


def test_chat_escapes_only_what_conflicts(spark):
    rows = chat.render_turns(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")).collect()
    for r in rows:
        conflict = any(c in r.role + "\0" + r.text for c in chat.CONTROL) or "\n" in r.role
        assert r.block.startswith("<|turn:1|>" if conflict else "<|turn:0|>")
        inner = r.block[len("<|turn:0|>") : -len(chat.END)]
        assert not any(c in inner for c in chat.CONTROL)
    formatted = chat.format_conversations(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string"))
    for r in formatted.collect():
        assert "".join(s.text for s in r.segments) == r.formatted


def expansions(parsed):
    """Texts that a pattern matches: all alternatives, each repeat with its least count and one more."""
    out = [""]
    for op, value in parsed:
        kind = str(op)
        if kind == "LITERAL":
            ends = [chr(value)]
        elif kind == "IN":
            ends = [chr(v) if str(o) == "LITERAL" else {"CATEGORY_DIGIT": "0", "CATEGORY_NOT_SPACE": "x"}[str(v)] for o, v in value]
        elif kind == "BRANCH":
            ends = [e for branch in value[1] for e in expansions(branch)]
        elif kind == "SUBPATTERN":
            ends = expansions(value[3])
        else:
            assert kind == "MAX_REPEAT", kind
            least, most, body = value
            ends = [e * n for n in range(least, min(least + 1, most) + 1) for e in expansions(body)]
        out = [a + b for a in out for b in dict.fromkeys(ends)]
    return out


def test_every_match_of_a_license_pattern_passes_its_gate():
    for rule in RULES:
        pattern = licenses.whole_words(rule.pattern)
        for text in expansions(re._parser.parse(rule.pattern)):
            assert pattern.search(text) and all(k in text for k in rule.keywords), (rule, text)
    scanner = licenses.Scanner()
    cases = {"released under the free content licence": "license-mention", "grant of patent licence": "patent-grant", "see the accompanying licence file": "license-file", "licence ouverte version 2 0": "etalab-2.0", "open rail m licence": "openrail"}
    cases |= {"asl 2 0": "apache-2.0", "creative commons attribution no derivs": "cc-by-nd", "creative commons attribution non commercial no derivs": "cc-by-nc-nd"}
    for text, label in cases.items():
        assert label in {k[0] for k in scanner.scan(text)[1]}, text
