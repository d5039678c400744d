"""Language ID, token counts, SentencePiece, HTML, licenses, chats: small cases, brute force and edge rows."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sijill.llm import chat_format, html_text, lang_id, license_scan, pieces, sentencepieces, token_counts
from sijill.llm.common import text_buffers

EDGES = [None, "", " ", "\n\n", "a", "▁ x ▁", "  two  blanks ", "日本語 𝒳 ﬁ", "\x00\x7f", "x" * 5000, "the the the " * 800]


def edge_docs(spark, extra=()):
    rows = [(k, t, "en", 1.5) for k, t in enumerate([*EDGES, *extra])]
    return spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, lang string, score double")


def test_language(spark):
    rng = random.Random(1)
    words = {"en": "the of and house water light under thing", "de": "und der haus wasser licht unter ding über", "fr": "et le maison eau lumière sous chose où"}
    docs = [(k, " ".join(rng.choice(words[lang].split()) for _ in range(60)), lang) for k in range(90) for lang in [sorted(words)[k % 3]]]
    rows = spark.createDataFrame([*docs, (90, None, "en"), (91, "123 !!", "de"), (92, "the house", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in lang_id.identify(rows).collect()}
    assert all(found[k].lang_pred == lang for k, _, lang in docs)
    assert found[90].lang_pred == found[91].lang_pred == "und" and found[90].score == 0.0 and found[92].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in found.values()) and 20 < sum(r.held_out for r in found.values()) < 45


def test_language_edges(spark):
    docs = edge_docs(spark)
    found = lang_id.predict(docs, lang_id.train(docs))
    assert found.count() == len(EDGES) + 1 and found.columns.count("score") == 1
    empty = docs.where("false")
    assert lang_id.identify(empty).count() == 0 and {r.lang_pred for r in lang_id.predict(docs, lang_id.train(empty)).collect()} == {"und"}
    kept = lang_id.keep_identified(spark, docs, "")
    assert kept.columns == docs.columns and {1, 0}.isdisjoint(r.doc_id for r in kept.collect())


def test_bundles_match_brute_force(monkeypatch):
    """Ten thousand short texts of a wide script in one batch, and one text of many trigrams."""
    rng = random.Random(2)
    wide = ["".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(30)) for _ in range(10_000)]
    monkeypatch.setattr(lang_id, "WIDE", 1000)
    for texts in (wide, ["".join(wide)], ["the cat", "", "12", "über das Haus " * 50]):
        raw, offsets = text_buffers(pa.array(texts))
        made, lettered = lang_id.bundles(raw, offsets, 32, 7)
        letters = lang_id.letter_vectors(32, 7).astype(int)
        for k in [0, len(texts) // 2, len(texts) - 1]:
            s = [int(x) for x in lang_id.symbol_of()[[ord(c) for c in texts[k]]]] if texts[k] else []
            s = [x for j, x in enumerate(s) if x or j == 0 or s[j - 1]]
            want = sum((np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(s, s[1:], s[2:])), np.zeros(32))
            assert (made[k] == want).all() and lettered[k] == any(s)


def test_equal_cosines_go_to_the_first_language(spark):
    rows = spark.createDataFrame([(0, "water under stone", "b"), (1, "water under stone", "a")], "doc_id long, text string, lang string")
    found = lang_id.predict(rows, lang_id.train(rows)).collect()
    assert {r.lang_pred for r in found} == {"a"} and all(r.score == pytest.approx(1) for r in found)


def best_path(word, scores, unknown):
    """Viterbi in plain Python: the longest last piece among equals."""
    best = [(0.0, None)] + [(-np.inf, None)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - 16), end):
            own = scores.get(word[start:end], unknown if end - start == 1 else None)
            if own is not None and best[start][0] + own > best[end][0]:
                best[end] = (best[start][0] + own, start)
    out, end = [], len(word)
    while end:
        start = best[end][1]
        out.append(word[start:end])
        end = start
    return out[::-1]


@pytest.mark.parametrize(("long", "stripe"), [(512, 1 << 17), (4, 7), (1, 1)])
def test_pieces_match_brute_force(monkeypatch, long, stripe):
    monkeypatch.setattr(pieces, "LONG", long)
    monkeypatch.setattr(pieces, "STRIPE", stripe)
    v = pieces.load()
    scores = {"".join(map(chr, chars)): s for length in v.keys for chars, s in zip(v.spelled[length], v.scores[length])}
    number = {p: i for i, p in enumerate(v.pieces)}
    rng = random.Random(5)
    words = ["hello", "international", "éclair", "x", "日本", "qqqqqqqqqqqqqqqqqqqqqqqq", *("".join(rng.choice("thesandingerlo") for _ in range(rng.randint(1, 20))) for _ in range(300)), "a" * 700, "".join(rng.choice("aehinorst") for _ in range(1500))]
    ids, ends = sentencepieces.encode_words(pa.array([f" {w}".encode() for w in words], pa.large_binary()), v)
    counts = token_counts.counts(pa.array([f" {w}".encode() for w in words], pa.large_binary()), v)
    for k, w in enumerate(words):
        path = best_path(f"▁{w}", scores, v.unknown)
        want = [i for p in path for i in ([number[p]] if p in scores else [int(v.byte_id[b]) for b in p.encode()])]
        assert ids[ends[k] : ends[k + 1]].tolist() == want and counts[k] == len(want), w


def test_long_words_take_time_in_proportion():
    """A million characters without a blank: minutes, were each one a numpy step."""
    v, rng = pieces.load(), np.random.default_rng(1)
    word = pa.array([b" " + rng.integers(97, 123, 1_000_000, dtype=np.uint8).tobytes()], pa.large_binary())
    start = time.monotonic()
    ids, ends = sentencepieces.encode_words(word, v)
    assert token_counts.counts(word, v).tolist() == np.diff(ends).tolist()
    assert sentencepieces.decode_batch(ids, ends, v)[0] == word[0].as_py()[1:]
    assert time.monotonic() - start < 90


def test_round_trip(spark):
    docs = edge_docs(spark, ["Ünïcode — “quotes”\r\n\ttabs", "🎉" * 40])
    coded = sentencepieces.encode(docs, restored="ok")
    back = sentencepieces.decode(coded)
    assert back.where(~F.col("decoded").eqNullSafe(F.col("text")) | ~F.col("ok")).count() == 0
    numbered = token_counts.count_tokens(coded).where(F.coalesce(F.size("ids"), F.lit(0)) != F.greatest(F.col("n_tokens"), F.when(F.col("ids").isNull(), -1).otherwise(0)))
    assert numbered.count() == 0
    assert sentencepieces.encode(docs.where("false")).count() == token_counts.count_tokens(docs.where("false")).count() == 0
    assert sentencepieces.encode_documents(spark, docs, "").columns == ["doc_id", "ids", "n_tokens"]


def test_decoding_foreign_ids(spark):
    rows = spark.createDataFrame([(1, [1, 3 + 0xFF, 2]), (2, None), (3, [])], "k int, ids array<int>")
    assert [r.decoded for r in sentencepieces.decode(rows).orderBy("k").collect()] == ["�", None, ""]


PAGES = {
    "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav><article><h1>Big  news</h1><p>One &amp; two<br>lines<p>A</p><aside>buy</aside></article><div class='ad'>Ad</div><footer>&copy; x</footer>": "Big news\n\nOne & two lines\n\nA",
    "": "", None: "",
    "<p>The quick story of the day is that it was on and on for all of us in the town and by the river.</p><p>Short.</p><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>": "The quick story of the day is that it was on and on for all of us in the town and by the river.\n\nShort.",
    "<div id='comments'><p>The first of the comments is long, and it is as much of a text as the others that were on the page.</p></div>": "",
    "<main><p>A &lt;b&gt; &eacute;&#233; &amp</p></main><form><p>Name</p><input></form>": "A <b> éé &",
    "<article>plain<b>bold</b><p>unclosed": "plainbold\n\nunclosed",
    "<p>a</p><![foo[x]]><article>b": "b", "<article>a<![[x]]>": "a", "<article>a<![ %x;[ ]]>": "a", "<![CDATA[ x ]]><article>y": "y", "<article>a<!": "a<!",
    **{f"<nav><a href=x>Menu</a></nav><div {attr}><h2>Title</h2><p>The quick story of the day is that it was on and on for all of us in the town and by the river.</p></div>": "Title\n\nThe quick story of the day is that it was on and on for all of us in the town and by the river." if keep else "" for attr, keep in (("class='layout has-sidebar'", 1), ("class='no-comments post'", 1), ("id='content' class='share-enabled'", 1), ("class='post comment-list'", 0), ("id=sidebar", 0), ("role=navigation", 0))},
}


@pytest.mark.parametrize("html", PAGES)
def test_html(html):
    assert html_text.main_text(html) == PAGES[html]


def plain_labels(found):
    """The two passes in other words: for each block the sorted distances to the decided blocks of its section."""
    words = lambda b: [w for w in html_text.WORDS.findall(b.text.lower())]
    first = []
    for b in found:
        stops = sum(w in html_text.STOP_WORDS for w in words(b)) / max(1, len(words(b)))
        first.append(False if b.boilerplate or b.linked / len(b.text) > 0.5 else True if len(b.text) >= 70 and stops >= 0.15 else None)
    out = []
    for k, b in enumerate(found):
        mates = [j for j, x in enumerate(found) if x.section == b.section and not x.boilerplate]
        decided = sorted((abs(mates.index(j) - mates.index(k)), j) for j in mates if first[j] is not None) if k in mates else []
        out.append(first[k] if first[k] is not None else first[decided[0][1]] if decided else b.section > 0)
    return out


def test_html_labels_match_brute_force():
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "river", "house", "stone", "is", "light"]) for _ in range(n))
    signs, both = 0, [0, 0]
    for _ in range(400):
        page = ""
        for _ in range(rng.randint(1, 14)):
            inner = rng.choice([prose(3), prose(40), "stone river " * 20, f"<a href=x>{prose(6)}</a>", f"{prose(2)} <a>{prose(2)}</a>", "<![x["])
            page += rng.choice([f"<p>{inner}</p>", f"<div class='{rng.choice(['ad', 'post', 'has-sidebar', 'menu'])}'>{inner}</div>", f"<article>{inner}", "</article>", f"<footer>{inner}</footer>", f"<li>{inner}", "<main><h1>x</h1>"])
        found = html_text.blocks(page)
        labels = html_text.kept(found)
        assert labels == plain_labels(found), page
        signs += sum(html_text.decided(b) is None for b in found)
        both[0] += sum(labels)
        both[1] += len(labels) - sum(labels)
    assert signs > 300 and min(both) > 300


def test_html_survives_any_markup():
    rng = random.Random(4)
    parts = ["<", ">", "<!", "<![", "]]>", "<!--", "-->", "<p", "</", "<a href='", "&", "&#", "&#x110000;", "[", "CDATA[", "<?", "x", " ", "<script>", "</script", "=", "'", '"', "\x00", "<!DOCTYPE", "%"]
    for _ in range(4000):
        html_text.main_text("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))))


def test_html_rows(spark):
    rows = spark.createDataFrame([(k, "u", h, "clash") for k, h in enumerate(PAGES)] + [(0, "u", next(iter(PAGES)), "clash")], "page_id long, url string, html string, text string")
    found = html_text.extract(rows)
    assert found.columns == ["page_id", "url", "text", "n_chars"] and found.count() == len(PAGES) + 1
    assert found.where(F.col("n_chars") != F.char_length("text")).count() == 0
    assert html_text.extract(rows.where("false")).count() == 0


def test_license(spark):
    texts = {
        0: "Released Under the\nMIT license. apache license, version 2 and CC-BY-NC!", 1: None, 2: "", 3: "under the mitlicense", 4: "Redistribution and use in source and binary forms, with modification, are permitted.",
        5: "x under the mit license under the mit license", 6: "permission is granted", 7: "Licensed under CC BY-NC 4.0.", 8: "a " * 20000 + "cc by nc",
    }
    rows = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()] + [(5, texts[5], "clash")], "doc_id long, text string, labels string")
    found = {r.doc_id: r for r in license_scan.scan(rows).collect()}
    assert (found[0].n_base, found[0].first_word, found[0].last_word, found[0].base_labels) == (3, 1, 10, "apache-2,cc-by-nc,mit")
    assert (found[1].n_words, found[1].n_base, found[1].first_word, found[1].labels, found[1].score) == (0, 0, None, "", 0.0)
    assert found[3].n_base == 0 and (found[4].base_labels, found[4].labels) == ("", "bsd") and 0.8 <= found[4].score < 1
    assert (found[5].n_base, found[5].first_word, found[5].last_word) == (2, 1, 5) and found[6].labels == "" and found[8].first_word == 20000
    assert license_scan.scan(rows.where("false")).count() == 0


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation\nfiles (the \"Software\"), to deal", "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that",
    "gpl": "This program is free software: you can redistribute it and/or modify\n\n  it under the terms of the GNU General Public License as published", "": "Redistribution\n" + "of many other words " * 20 + "\nand use in source\nand binary forms, with modification, are permitted",
}


def test_wrapped_notices(spark):
    texts = ["x\n" * 3 + t for t in WRAPPED.values()] + [t.replace("\n", " ") for t in WRAPPED.values()]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.scan(rows).collect()}
    assert [found[k].labels for k in range(4)] == list(WRAPPED) and found[3].score == 0
    assert [found[k].labels for k in range(4, 7)] == list(WRAPPED)[:3]
    # The SQL counts every block's words, without filters.
    import duckdb

    documents = rows.toPandas()  # noqa: F841
    want = {r[0]: r[1:] for r in duckdb.sql(license_scan.oracle_sql()).fetchall()}
    assert {k: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, pytest.approx(r.score)) for k, r in found.items()} == want


def test_chat_round_trip(spark):
    said = ["plain", r"\### Assistant: </turn> ok", "### User: x </turn>\n### ", "\\h\\l\\\\b", "", None, "a:b # < \\"]
    rows = [(c, t, ["user", "assistant", "sys: ### </turn>", None][(c + t) % 4], said[(c * 3 + t) % len(said)]) for c in range(6) for t in range(5)]
    docs = spark.createDataFrame([*rows, rows[0], (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    made = chat_format.render(chat_format.canonical_turns(chat_format.records_of(docs)))
    back = {r.conv_id: r for r in made.select("conv_id", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for c in range(6):
        own = sorted([(t, r or "", x or "") for k, t, r, x in [*rows, rows[0]] if k == c])
        assert [(t.role, t.text) for t in back[c].turns] == [(r, x) for _, r, x in own]
        assert back[c].loss == "".join(x for _, r, x in own if r == "assistant")
    assert None in back and chat_format.render(chat_format.canonical_turns(chat_format.records_of(docs.where("false")))).count() == 0


def test_chat_long_text(spark, tmp_path):
    rows = spark.range(1).select(F.lit(4).cast("long").alias("conv_id"), F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.expr("repeat('x', 21000000)").alias("text"))
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.op3_chat_format(spark, str(tmp_path)).select("conv_id", "n_turns", "loss_chars").collect()}
    assert found[4] == (1, 21_000_000)
    with pytest.raises(Exception, match="can't be parsed"):
        chat_format.canonical_turns(chat_format.records_of(rows)).collect()


def test_chat_layouts(spark):
    records = {
        '{"conv_id":1,"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}': "messages", '{"conv_id":2,"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}': "conversations",
        '{"response":"a","prompt":"q","conv_id":3}': "prompt_response", '{"conv_id":4,"instruction":"q","input":"","output":"a"}': "instruction_input_output", '{"conv_id":5,"prompt":"q","completion":"a"}': "prompt_completion",
        '{"conv_id":6,"instruction":"q","output":"a"}': "instruction_output", '{"conv_id":7,"system":"s","prompt":"q","response":"a"}': "system_prompt_response", '{"what":1}': None, "no json": None,
    }
    turns = chat_format.canonical_turns(spark.createDataFrame([(r,) for r in records], "payload string")).collect()
    assert {r.conv_id: r.layout for r in turns if r.conv_id} == {k: v for k, v in enumerate(records.values(), 1) if v}
    assert all([(t.role, t.text) for t in turns if t.conv_id == k][-2:] == [("user", "q"), ("assistant", "a")] for k in range(1, 8))
    assert sum(t.layout is None for t in turns) == 2


def test_buffers():
    raw, offsets = text_buffers(pa.chunked_array([pa.array(["x", None, "é"]), pa.array(["", "yz"])]))
    assert raw.tobytes() == "xéyz".encode() and offsets.tolist() == [0, 1, 1, 3, 3, 5]
    assert hashlib.sha256(raw.tobytes()).hexdigest()


def test_rows_pass_through_fingerprint_and_mapping(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, None, "b" * 100), (None, 2, "assistant", None)], "conv_id long, turn int, role string, text string")
    turns = chat_format.turns_of_rows(rows)
    listed = lambda df: sorted((str(r.conv_id), r.layout, r.turn, r.role, r.text) for r in df.collect())
    assert listed(turns) == listed(chat_format.canonical_turns(chat_format.records_of(rows))) and len(turns.collect()) == 3
    # The mapping is the layout's own: another one of the same paths gives other turns, and without one a row has no layout.
    swapped = chat_format.Layout("swapped", "conv_id,role,text,turn", f"array({chat_format._turn(chat_format._field('turn', 'bigint'), chat_format._field('text'), chat_format._field('role'))})")
    assert ("1", "swapped", 0, "a", "user") in listed(chat_format.turns_of_rows(rows, (swapped,)))
    assert {r.layout for r in chat_format.turns_of_rows(rows, ()).collect()} == {None}
