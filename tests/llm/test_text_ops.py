"""Operators that treat texts one by one, against brute force."""

import collections
import dataclasses
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftlink.llm import byte_cnn, decontaminate, licenses, lm, pii, quality_rules, queries
from weftlink.llm.common import table, words_of

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@given(st.lists(st.text(max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_of_splits_and_hashes(texts):
    batch = [t.encode("utf-8", "ignore") for t in texts]
    w = words_of(batch)
    flat = [x for b in batch for x in b.split()]
    assert w.n.tolist() == [len(b.split()) for b in batch]
    assert [bytes(w.raw[a:b]) for a, b in zip(w.begin, w.end)] == flat
    assert len(set(w.hashes.tolist())) == len(set(flat))
    assert {(x, h) for x, h in zip(flat, w.hashes.tolist())} == set(zip(flat, words_of([b" ".join(flat)]).hashes.tolist()))


def stats(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


@pytest.fixture(scope="module")
def model(spark, sample):
    return quality_rules.train(sample, table(spark, SF, "labels"))


def test_quality_statistics(docs, sample, empty, model):
    for source in (docs, sample):
        for r in quality_rules.quality_rules(source, model).collect():
            want = stats(r.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
            assert not (r.base_failed and r.kept) and 0 <= r.quality_score <= 1
    assert quality_rules.quality_rules(empty, model).count() == 0
    assert docs.count() == quality_rules.quality_rules(docs, model).count()


def test_quality_accuracy_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    held = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"
    from pyspark.sql import functions as F

    model = quality_rules.train(docs, labels, only=~F.expr(held))
    scored = quality_rules.quality_rules(docs.where(held), model, keep_text=False).join(labels, "doc_id").toPandas()
    said = scored.quality_score >= quality_rules.KEEP_AT
    assert (said == (scored.quality == 1)).mean() > 0.98
    net = byte_cnn.train(docs, labels, only=~F.expr(held))
    scored = byte_cnn.cnn_scores(docs.where(held), net, keep_text=False).join(labels, "doc_id").toPandas()
    rank = scored.score.rank()
    good = scored.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.97


def test_quality_scores_against_features():
    """The score of a text by its vector of words and characters, built without arrays."""
    rng = np.random.default_rng(4)
    weights = rng.normal(0, 1, quality_rules.GROUPS * quality_rules.GROUP + 1)
    batch = [t.encode() for t in ("plain words, plain words again", "", "x", "Ünï çødé und 漢字 漢字 😀 text", "aa aa bb", "日本語")]
    got = quality_rules.raw_scores(weights, batch, words_of(batch))
    for t, z, (at, val) in zip(batch, got, quality_rules.features(batch), strict=True):
        assert z == pytest.approx(weights[-1] + (weights[at] * val).sum()), t
        assert [chr(int.from_bytes(int(c).to_bytes(4, "little").rstrip(b"\0").decode().encode("utf-32-le"), "little")) for c in quality_rules.characters(np.frombuffer(t, np.uint8))] == list(t.decode())
    three = np.concatenate([quality_rules.group_indexes(quality_rules.characters(np.frombuffer(x.encode(), np.uint8)), words_of([b"a"]).hashes)[2] for x in ("漢字x", "漢字y", "abc")])
    assert len(three) == 3 and len(set(three.tolist())) == 3  # one n-gram of three characters each, whatever their bytes


def test_cnn_against_a_plain_convolution():
    """Each chunk and filter by a plain product over its windows."""
    rng = np.random.default_rng(6)
    net = byte_cnn.ByteCnn(rng.normal(0, 0.5, (256, byte_cnn.EMBED)), rng.normal(0, 0.2, (byte_cnn.WIDTH * byte_cnn.EMBED, byte_cnn.FILTERS)), rng.normal(0, 0.1, byte_cnn.FILTERS), rng.normal(0, 0.3, 2 * byte_cnn.FILTERS), 0.1, 0.7, -0.2)
    for text in (b"", b"short", rng.integers(0, 256, 700).astype(np.uint8).tobytes()):
        raw = byte_cnn.padded(text) + bytes(byte_cnn.PAD)
        blocks, tops = byte_cnn.blocks_of(text), []
        for b in range(max(1, blocks - 1)):
            reach = range(b * byte_cnn.BLOCK, min(b + 2, blocks) * byte_cnn.BLOCK, byte_cnn.STRIDE)
            z = [net.embed[list(raw[k : k + byte_cnn.WIDTH])].ravel() @ net.filters for k in reach]
            tops.append(np.maximum(np.max(z, 0) + net.bias, 0))
        z = np.concatenate([np.mean(tops, 0), np.max(tops, 0)]) @ net.out + net.offset
        assert byte_cnn.probabilities(net, [text])[0] == pytest.approx(1 / (1 + np.exp(-(net.slope * z + net.shift))), abs=1e-3)


def test_clashing_names_in_any_case(spark, sample):
    few = sample.limit(20)
    model, net = quality_rules.train(sample, table(spark, SF, "labels")), byte_cnn.train(spark.createDataFrame([], sample.schema), table(spark, SF, "labels"))
    runs = {
        "N_Words": lambda d: quality_rules.quality_rules(d, model), "Score": lambda d: byte_cnn.cnn_scores(d, net), "Sentence_Ids": licenses.scan_licences,
        "N_Hit": lambda d: decontaminate.find_leaks(d, table(spark, SF, "benchmark")), "N_Email": lambda d: pii.pseudonymise(d, b"k"),
    }
    for name, run in runs.items():
        out = run(few.withColumn(name, F.lit("mine")))
        assert out.count() == 20 and [c.lower() for c in out.columns].count(name.lower()) == 1


def test_queries_return_what_is_asked(spark, sample):
    """The columns that queries derive, from plain Python; their operators are tested above."""
    ids = {r.doc_id: r.text for r in sample.collect()}
    out = {r.doc_id: r for r in queries.op3_quality_rules(spark, SF).collect()}
    assert out.keys() == ids.keys() and all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats(ids[k]) and r.kept == (not r.base_failed and r.quality_score >= quality_rules.KEEP_AT) for k, r in out.items())
    items = [(str(r.item_id), r.text) for r in table(spark, SF, "benchmark").collect()]
    for r in queries.op6_decontamination(spark, SF).where("doc_id % 4 = 0").collect():
        n, hit, found = brute_leaks(ids[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)
    for r in queries.op7_byte_cnn(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    for r in queries.op10_log_bilinear_lm(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.n_tokens == len(words(ids[r.doc_id])) + 1 and r.score < 0
    assert {r.doc_id for r in queries.op8_licence_scans(spark, SF).collect()} == {r.doc_id for r in queries.op9_pseudonyms(spark, SF).collect()} == ids.keys()


def test_no_labels_gives_a_constant(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_rules.quality_rules(docs, quality_rules.train(docs, none)).collect()
    assert {r.quality_score for r in rows} == {0.5}
    assert {r.score for r in byte_cnn.cnn_scores(docs, byte_cnn.train(docs, none)).collect()} == {0.5}


def test_cnn_sees_the_whole_text_and_only_the_text(docs, empty, spark, sample):
    net = byte_cnn.train(sample, table(spark, SF, "labels"))
    rows = byte_cnn.cnn_scores(docs, net).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[r.text or ""].add(r.score)
    assert all(len(x) == 1 for x in by_text.values())
    assert byte_cnn.cnn_scores(empty, net).count() == 0
    junk = b"###$$$ %%% &&& " * 20
    one, two = byte_cnn.probabilities(net, [b"plain words " * 400, b"plain words " * 400 + junk])
    assert one != two  # what stands at the end counts


def test_cnn_learns_from_all_of_a_text(spark):
    """What tells the labels apart stands in one part of long texts, which four spread chunks of each would miss."""
    rng = np.random.default_rng(5)
    text = lambda: bytes(rng.choice(np.frombuffer(b"abcdefghijklmnopqrst      ", np.uint8), 41 * 256 - 90)).decode()
    texts = [x[:700] + "#### $$$$ " * 240 + x[3100:] if k // 4 % 2 else x for k, x in enumerate(text() for _ in range(720))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    net = byte_cnn.train(docs, docs.selectExpr("doc_id", "cast(doc_id div 4 % 2 AS int) AS quality"), only=F.col("doc_id") < 600)
    p = byte_cnn.probabilities(net, [t.encode() for t in texts[600:]])
    marked = np.arange(600, 720) // 4 % 2 == 1
    assert p[marked].min() > 0.5 > p[~marked].max()


def test_cnn_gradients():
    """Against differences of the loss, on texts of one block, two and many."""
    rng = np.random.default_rng(3)
    net = byte_cnn.ByteCnn(rng.normal(0, 0.5, (256, byte_cnn.EMBED)), rng.normal(0, 0.2, (byte_cnn.WIDTH * byte_cnn.EMBED, byte_cnn.FILTERS)), rng.normal(0, 0.1, byte_cnn.FILTERS), rng.normal(0, 0.3, 2 * byte_cnn.FILTERS), 0.1)
    texts = [rng.integers(32, 127, k).astype(np.uint8).tobytes() for k in (0, 100, 400, 9000)]
    n, y = np.array([byte_cnn.blocks_of(t) for t in texts]), np.array([0.0, 1, 1, 0])
    raw = np.frombuffer(b"".join(map(byte_cnn.padded, texts)), np.uint8)

    def loss(net):
        z = byte_cnn.pool(net, raw, n).features @ net.out + net.offset
        return (np.log1p(np.exp(z)) - y * z).mean()

    got = byte_cnn.gradients(net, byte_cnn.pool(net, raw, n, places=True), y, len(y))
    for name in ("embed", "filters", "bias", "out"):
        way = rng.normal(0, 1, getattr(net, name).shape) * (got[name] != 0)
        step = [loss(dataclasses.replace(net, **{name: getattr(net, name) + e * way})) for e in (1e-3, -1e-3)]
        assert abs((step[0] - step[1]) / 2e-3 - (got[name] * way).sum()) < 0.02 * np.abs(got[name] * way).sum() + 1e-4, name


def brute_leaks(text, items):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    w, hit, found = split(text), set(), set()
    for name, item in items:
        i = split(item)
        for k in range(max(1, len(i) - 9)) if i else ():
            x = i[k : k + 10]
            for at in range(len(w) - len(x) + 1):
                if w[at : at + len(x)] == x:
                    hit.update(range(at, at + len(x)))
                    found.add(name)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 60])
def test_leaks(spark, sample, docs, empty, block_words):
    bench = table(spark, SF, "benchmark")
    extra = spark.createDataFrame([(100, "the LAZY dog"), (101, None), (102, ""), (None, "漢字 in a text"), (100, "the lazy dog"), (103, "word " * 12)], "item_id long, text string")
    for source, marks in ((sample.limit(60), bench), (docs, extra)):
        items = [("" if r.item_id is None else str(r.item_id), r.text) for r in marks.collect()]
        for r in decontaminate.find_leaks(source, marks, block_words=block_words).collect():
            assert (r.n_words, r.n_hit, r["items"]) == brute_leaks(r.text, items)
            assert sum(b - a for a, b in zip(r.hit_starts, r.hit_ends)) == r.n_hit and (r.longest > 0) == (r.n_hit > 0)
    assert decontaminate.find_leaks(empty, extra).count() == 0
    clean = decontaminate.decontaminate(docs, extra)
    assert clean.columns == docs.columns and not {0, 1, 2, 8, 9} & {r.doc_id for r in clean.collect()}


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(3)
    for top, n in ((1, 40), (3, 200), (1 << 20, 50)):
        ids = rng.integers(0, top + 1, n)
        got = decontaminate.suffix_array(ids, top, n)
        assert got.tolist() == sorted(range(n), key=lambda k: (ids[k:].tolist()))


@given(st.integers(2, 3000), st.integers(0, 10**6))
@settings(max_examples=50, deadline=None)
def test_feistel_is_a_permutation(size, value):
    value %= size
    assert pii.permute(pii.permute(value, size, "t", b"k"), size, "t", b"k", back=True) == value
    if size < 300:
        assert sorted(pii.permute(v, size, "t", b"k") for v in range(size)) == list(range(size))


def test_pseudonyms_keep_format_links_and_come_back(spark, docs, empty):
    text = "mail und.34@mail7.example.com or +1 (017) 555-7713, (803) 555-5351, 97.51.17.173 and 4037590409210456; 4111-1111-1111-1111 1999-02-28 31/12/2005 12/31/2005 01.02.1990 123-45-6789"
    same = "8638481074853888 2023-02-30 999.1.1.1 1.2.3 000-12-3456 681c09b8e90e7e8c9575180f595f646cf2969054"
    rows = spark.createDataFrame([(1, text), (2, same), (3, "again 4037590409210456."), (4, None), (5, "")], "doc_id long, text string")
    out = pii.pseudonymise(rows, b"k")
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].text == same and got[4].text is None and got[5].text == ""
    shape = lambda t: re.sub(r"[a-z]", "a", re.sub(r"\d", "9", t))
    assert shape(got[1].text) == shape(text)
    for value in re.findall(r"\S*\d[\d./-]*\S*", text):
        if len(value) > 8:
            assert value not in got[1].text
    number = re.search(r"\d{16}", got[1].text)[0]
    assert pii.check_digit(number[:-1]) == number[-1] and got[3].text == f"again {number}."
    assert (got[1].n_email, got[1].n_phone, got[1].n_ip, got[1].n_card, got[1].n_date, got[1].n_ssn) == (1, 2, 1, 2, 4, 1)
    assert {r.doc_id: r.text for r in pii.pseudonymise(out, b"k", back=True).collect()} == {r.doc_id: r.text for r in rows.collect()}
    assert {(r.doc_id, r.text) for r in pii.pseudonymise(docs, b"k").collect()} == {(r.doc_id, r.text) for r in docs.collect()}
    assert pii.pseudonymise(empty, b"k").count() == 0
    assert {r.text for r in pii.pseudonymise(rows, b"other").collect()} != {r.text for r in out.collect()}
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymise(rows, b"")


def test_licences(spark, docs, empty):
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\n you may not use this file except in compliance with the License.\n You may obtain a copy of the License at\n\n http://www.apache.org/licenses/LICENSE-2.0\n'
    rows = {1: "Text here.\nReleased under the MIT License.", 2: apache, 3: "x. This work is licensed under the GNU General Public License, version 3. y", 4: "licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", 5: "The license of the car.", 6: "All rights reserved"}
    out = {r.doc_id: r for r in licenses.scan_licences(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert {k: r.licences for k, r in out.items()} == {1: ["MIT"], 2: ["Apache-2.0"], 3: ["GPL-3.0-only"], 4: ["CC-BY-NC-4.0"], 5: [], 6: ["Proprietary"]}
    assert [m.asDict() for m in out[2].matches] == [{"licence": "Apache-2.0", "first": 0, "count": 3}]
    assert {len(r.licences) for r in licenses.scan_licences(docs).collect()} == {0} and licenses.scan_licences(empty).count() == 0


NOTICES = {
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.": ["GPL-2.0-or-later"],
    "# This library is free software: you can redistribute it and/or modify it under the terms of the\n GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": ["LGPL-3.0-or-later"],
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.": ["MPL-2.0"],
    "SPDX-License-Identifier: AGPL-3.0-only": ["AGPL-3.0-only"],
    "// SPDX-License-Identifier: BSD-3-Clause\nint main;": ["BSD-3-Clause"],
    "Licensed under the BSD 3-Clause License.": ["BSD-3-Clause"],
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA-4.0"],
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": ["ISC"],
    "Redistributions are nice. This software is good. Under the tree, anyone is free.": [],
}


def plain_scan(text):
    """Identifiers by a plain search of each known sentence in the words of the text, at the ends of pieces, the longest first."""
    pieces, at = [], 0
    for m in licenses.ENDS.finditer(text):
        pieces.append(licenses.normal(text[at : m.start()]))
        at = m.end()
    pieces = [p for p in [*pieces, licenses.normal(text[at:])] if p]
    ids, k = [], 0
    while k < len(pieces):
        fits = [(j, licenses.KNOWN[b" ".join(pieces[k:j])]) for j in range(k + 1, min(len(pieces), k + 80) + 1) if b" ".join(pieces[k:j]) in licenses.KNOWN]
        k = fits[-1][0] if fits else k + 1
        ids += [fits[-1][1]] if fits else []
    out, k = [], 0
    while k < len(ids):
        rule = next((r for r in licenses.RULES if tuple(ids[k : k + len(r[1])]) == r[1]), None)
        out += [(rule[0], k, len(rule[1]))] if rule else []
        k += len(rule[1]) if rule else 1
    return ids, out


def test_licence_notices_and_a_plain_scan(sample):
    for text, want in NOTICES.items():
        _, ids, found = licenses.scan(text.encode())
        assert sorted({x for x, *_ in found}) == want and (ids, found) == plain_scan(text.encode()), text
    for r in sample.collect():
        _, ids, found = licenses.scan(r.text.encode())
        assert (ids, found) == plain_scan(r.text.encode()), r.doc_id


def test_licences_of_the_sample_against_plain_search(sample):
    plain = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "General Public License, version 3.": "GPL-3.0-only"}
    for r in licenses.scan_licences(sample).collect():
        assert {v for k, v in plain.items() if k in r.text} <= set(r.licences), r.doc_id


@pytest.mark.parametrize("known_words", [lm.KNOWN_WORDS, 50])
def test_lm_counts_and_gain(spark, known_words):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = {r.doc_id: r for r in lm.lm_scores(docs, lm.split() != 2, known_words=known_words).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {r.doc_id: [*words(r.text.translate(lower)), None] for r in docs.collect()}
    held = {k for k in tokens if zlib.crc32(str(k).encode()) % 7 == 2}
    c = collections.Counter(t for k, x in tokens.items() if k not in held for t in x)
    n, v = sum(c.values()), len(c)
    for k, x in tokens.items():
        r = rows[k]
        assert (r.learned, r.n_tokens, r.n_known, r.train_tokens) == (k not in held, len(x), sum(t in c for t in x), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[t] + 1) / (n + v + 1)) for t in x), abs=1e-6)
    gain = [rows[k].score - rows[k].base_score for k in held]
    assert sum(gain) / sum(len(tokens[k]) for k in held) > 0.1


def test_lm_is_normalised_and_takes_odd_rows(spark, docs, empty):
    counts = np.arange(lm.HEAD, 0, -1)
    hashes = np.arange(10, 10 + lm.HEAD, dtype=np.uint64)
    corpus = lm.Corpus(10, 3, 2, hashes, np.arange(lm.HEAD), counts, hashes, counts, np.ones(lm.STEPS, int), np.ones(lm.STEPS, int))
    model = lm.new_model(corpus)
    outputs = [(0, -1), *((1 + w // lm.SLOTS, w) for w in range(lm.HEAD)), *((y, -1) for y in range(1 + lm.CLASSES, lm.STEPS))]
    n = len(outputs)
    t = lm.Tokens(np.ones(2 * n, np.uint64), np.full(n, 2), np.tile([1, 0], n), np.array([x for y, _ in outputs for x in (65, y)]), np.array([x for _, w in outputs for x in (-1, w)]))
    assert np.exp(lm.log_probabilities(model, t)[1::2]).sum() == pytest.approx(1, abs=1e-4)
    rows = lm.lm_scores(docs, docs["doc_id"] % 2 == 0).collect()
    assert len(rows) == docs.count() and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
    assert lm.lm_scores(empty, empty["doc_id"] % 2 == 0).count() == 0
    none = lm.lm_scores(docs, docs["doc_id"] < 0).collect()
    assert {r.n_known for r in none} == {0} and {r.train_tokens for r in none} == {0}


def plain_log10(model, corpus, text):
    """The text's log10 probability token by token, each by plain sums over all outputs; unknown words and the tail by the counts."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = [x.encode() for x in words((text or "").translate(lower))]
    t = lm.tokens([" ".join(x.decode() for x in parts).encode()], corpus.head, corpus.rank)
    known, before, total = dict(zip(corpus.known.tolist(), corpus.known_counts.tolist())), [0] * lm.CONTEXT, 0.0
    for k, y in enumerate(t.outputs.tolist()):
        r = sum(model.embed[c].astype(float) @ model.turn[j * lm.DIM : (j + 1) * lm.DIM] for j, c in enumerate(before))
        z = model.out[:, :-1] @ r + model.out[:, -1]
        total += np.log10(np.exp(z[y]) / np.exp(z).sum())
        if t.words[k] >= 0:
            own = slice((y - 1) * lm.SLOTS, y * lm.SLOTS)
            z = model.word[own, :-1] @ r + model.word[own, -1]
            total += np.log10(np.exp(z[t.words[k] % lm.SLOTS]) / np.exp(z).sum())
        elif y:
            total += np.log10((known.get(int(t.hashes[k]), 0) + 1) / (corpus.class_tokens[y] + corpus.class_words[y] + 1))
        before = [int(t.inputs[k]), *before[:-1]]
    return total


def test_lm_against_plain_sums_and_other_partitions(spark, sample, monkeypatch):
    """The model's scores token by token; and the same model whatever the partitions, also with several shards."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 5000)
    made = {}
    train = lm.trained
    monkeypatch.setattr(lm, "trained", lambda docs, corpus, *more: made.setdefault(len(made), (train(docs, corpus, *more), corpus))[0])
    one, two = ({r.doc_id: r.score for r in lm.lm_scores(d, lm.split() != 2).collect()} for d in (sample.coalesce(1), sample.orderBy(F.desc("doc_id")).repartition(13)))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], rel=1e-5) for k in one)
    assert np.abs(made[0][0].word - made[1][0].word).max() < 1e-5
    for r in sample.where("doc_id < 4").collect():
        assert one[r.doc_id] == pytest.approx(plain_log10(*made[0], r.text), rel=1e-4)
