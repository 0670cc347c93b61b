"""Language ID, BPE, token files, licences and media against brute force, the library and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evenhand.llm import bpe, langid, licences, media, tokenfile
from evenhand.llm.common import documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "It's we'LL ΑΣ ΣΑΣ ﬁ İ é x\x1cy\x85z 日本語テスト 🎉🎉 ½ a_b <|endoftext|>z <|ENDOFTEXT|>", "é" * 300, "a" * 5000, "the " * 3000, "!?" * 900, "Straße\n\n\tñ"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 5) for i, t in enumerate(ODD)] + [(2, ODD[3], None, None), (2, ODD[3], None, None), (None, "no id", None, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, IDS string, score int")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_lookahead_of_small_merge_lists():
    # ab waits for nothing to its right but b; with (b, c) first, c decides whether b is free, with (c, d) before that, d too
    length = {c: 1 for c in "abcd"}
    assert bpe.sufficient_lookahead([("a", "b")], dict(length, ab=2)) == 1
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b")], dict(length, ab=2, bc=2)) == 2
    assert bpe.sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")], dict(length, ab=2, bc=2, cd=2)) == 3


def test_streaming_equals_merging_at_once():
    coder = bpe.Transducer(bpe.load(PATH))
    rng = random.Random(5)
    for letters in ("ab", "aeinrsth", "the"):
        for n in (coder.window - 1, coder.window + 1, 4000):
            word = [rng.choice(letters) for _ in range(n)]
            assert list(coder.stream(iter(word))) == coder.merge(word.copy())


def test_bpe_is_the_library(odd, library):
    out = bpe.digests(odd, PATH).collect()
    assert len(out) == odd.count()
    want = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out)


def test_bpe_columns_and_text(odd, library, spark):
    out = bpe.encode(odd, PATH)
    assert out.columns == ["doc_id", "text", "score", "ids", "decoded"]
    for r in out.collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.encode(odd.limit(0), PATH).count() == 0
    back = bpe.Decoder(bpe.Transducer(bpe.load(PATH)), surface=False)
    ids = library.encode("naïve 日本語 words", add_special_tokens=False).ids
    assert "".join(back.push([i]) for i in ids) + back.end() == "naïve 日本語 words "


def test_bpe_of_the_given_texts(spark, sf, library):
    texts = [r.text for r in documents(spark, sf).collect()]
    coder, back = bpe.Transducer(bpe.load(PATH)), bpe.Decoder(bpe.Transducer(bpe.load(PATH)))
    for t, p in zip(texts, coder.encode_all(texts), strict=True):
        e = library.encode(t or "", add_special_tokens=False).ids
        assert coder.ids(p).tolist() == e
        assert back.push(e) + back.end() == library.decode(e, skip_special_tokens=False)


@pytest.mark.parametrize(("n", "u"), [(0, 1), (1, 1), (1, 10**9), (1000, 10**6), (3000, 3000), (300, 2**50), (1000, 5)])
def test_elias_fano(n, u):
    v = np.sort(np.random.default_rng(n).integers(0, u, n))
    e, _ = tokenfile.EliasFano.read(memoryview(tokenfile.EliasFano.of(v).to_bytes()), 0)
    assert (e.all() == v.astype(np.uint64)).all() and all(e.select(i) == v[i] for i in range(n))
    if n >= 1000:
        assert 8 * len(e.high) <= 3 * n + 16


def test_token_file(odd, library):
    rows = odd.unionByName(odd.select((F.col("doc_id") - 5).alias("doc_id"), "text", "IDS", "score"))
    got = sorted(tokenfile.written_and_read(rows, PATH).collect(), key=lambda r: r.start)
    own = rows.withColumn("tie", F.xxhash64("text")).orderBy(F.asc_nulls_first("doc_id"), "tie").collect()
    at = 0
    for g, r in zip(got, own, strict=True):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert tuple(g) == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenfile.written_and_read(odd.limit(0), PATH).count() == 0


def test_small_segments(tmp_path, spark, sf, library):
    docs, to = documents(spark, sf), str(tmp_path / "tokens")
    tokenfile.write_tokens(docs, PATH, to, segment_ids=3000, parts=5)
    assert spark.read.parquet(to).count() > 5
    got = {r.doc_id: r.start for r in tokenfile.read_tokens(spark, to).collect()}
    at = 0
    for r in docs.orderBy("doc_id").collect():
        assert got[r.doc_id] == at
        at += len(library.encode(r.text or "", add_special_tokens=False).ids) + 1


def test_languages_of_held_out_documents(spark, sf):
    docs = documents(spark, "/root/testdata/sf0.01")
    found = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in found)
    assert right >= 0.97 * len(found) and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)


def test_language_spans_and_odd_rows(spark, sf):
    docs = documents(spark, "/root/testdata/sf0.01")
    model = langid.fit(docs)
    by = {r.lang: r.text for r in docs.where("length(text) between 600 and 2000").collect()}
    mixed = by["en"][:500] + " " + by["fr"][:500]
    rows = spark.createDataFrame([(1, mixed, 3), (2, None, 3), (3, "", 3), (4, "123 ... 4", 3), (None, by["de"], 3), (None, by["de"], 3)], "doc_id bigint, text string, SCORE int")
    out = langid.identify(rows, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "spans"]
    got = out.collect()
    spans = next(r.spans for r in got if r.doc_id == 1)
    assert {s.lang for s in spans} >= {"en", "fr"} and spans[0].start == 0 and spans[-1].stop == len(mixed)
    assert all(a.stop == b.start for a, b in zip(spans, spans[1:], strict=False))
    assert abs(next(s.start for s in spans if s.lang == "fr") - 501) < 40
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (2, 3, 4)] == [("und", 0.0)] * 3
    assert [r.lang_pred for r in got if r.doc_id is None] == ["de", "de"]
    nobody = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(rows, nobody).collect()} == {"und"}
    assert langid.accept(docs).count() > 0.97 * docs.count()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    from itertools import product

    lengths = np.array([5, 0, 3, 6])
    score = rng.normal(size=(lengths.sum(), 3)) * 3
    starts = np.cumsum(lengths) - lengths
    path = langid.viterbi(score, starts, lengths, 2.0)
    for a, n in zip(starts, lengths, strict=True):
        worth = lambda p: sum(score[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: B023, E731
        if n:
            assert abs(worth(path[a : a + n]) - max(worth(p) for p in product(range(3), repeat=int(n)))) < 1e-9


def test_licences(spark, sf):
    texts = [None, "", "no such thing", "He is licensed to drive.", "a b\nReleased under the MIT License.\nc", "x. Licensed under the Apache License, Version 1.1.", "so released under the mit  license. Licensed under CC BY-NC 4.0. All rights reserved.",
             'Permission is hereby granted, free of charge, to any person obtaining a copy of\nthis software and associated documentation files (the "Software"), to deal in\nthe Software without restriction, including']
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[4], 2), (None, texts[4], 2)], "doc_id bigint, text string, Licence int")
    got = [(r.doc_id, r.licence, r.differing) for r in licences.scan(rows).orderBy("doc_id", "start").collect()]
    assert got == [(None, "MIT", 0)] * 2 + [(4, "MIT", 0), (6, "MIT", 0), (6, "CC-BY-NC-4.0", 0), (6, "All rights reserved", 0), (7, "MIT permission", 0)]
    assert licences.scan(rows.limit(0)).count() == 0
    s = licences.scan(rows).where("doc_id = 4").first()
    assert texts[4][s.start : s.stop] == "Released under the MIT License" and s.saved > 0.3


def test_licences_in_other_words_and_together():
    scanner = licences.Scanner(licences.TEMPLATES | licences.SHORT_FORMS, 0.15)
    names = lambda t: [f[2] for f in scanner.scan(t)]
    assert names("Licensed under the MIT License.") == names("Distributed under the MIT License.") == ["MIT"]
    assert names("It is licensed under a CC BY 4.0 license.") == ["CC-BY-4.0"]
    assert names("Released under the MIT License and licensed under CC BY-NC 4.0") == ["MIT", "CC-BY-NC-4.0"]
    assert names("Licensed under the Apache License, Version 2.0, or released under the MIT License, or licensed under CC BY-SA 4.0.") == ["Apache-2.0", "MIT", "CC-BY-SA-4.0"]
    assert names("// SPDX-License-Identifier: Apache-2.0\n#include <x>") == ["Apache-2.0 SPDX"] and names("The MIT License") == ["MIT short"]
    assert names("Released under the 2-clause BSD License.") == names("Licensed under CC BY 3.0.") == names("She studied at MIT and holds a driving licence.") == []


def test_media_round_trip_and_transform():
    rng, matrix, z = np.random.default_rng(1), media.inverse_transform(), media.zigzag()
    assert z[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(z) == list(range(64))
    k = np.arange(8)
    for n in (1, 2, 5, 17, 40):
        payload = rng.integers(0, 256, 64 * n).astype(np.uint8).tobytes()
        stored = media.store(payload)
        frame, slow = media.coefficients(stored), media.coefficients(stored, fixed=False)
        assert media.payload_of(frame) == payload
        assert all((a["coef"] == b["coef"]).all() for a, b in zip(frame["parts"].values(), slow["parts"].values(), strict=True))
        natural = np.zeros(64)
        natural[z] = frame["parts"][1]["coef"][0]
        basis = np.array([[(0.125**0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in k] for x in k])
        want = np.clip(np.rint(basis @ natural.reshape(8, 8) @ basis.T + 128), 0, 255)
        assert np.abs(media.tensor(frame, matrix)[:8, :8, 0] - want).max() <= 1


def bits(*fields):
    s = "".join(fields)
    s += "1" * (-len(s) % 8)
    return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8))


def test_progressive_scans_with_runs_and_colour():
    # one block of each component at full resolution: interleaved DC, then AC with a run, a band's end over blocks, and refinement
    one = [1] + [0] * 15
    two = [0, 2] + [0] * 14
    data = b"".join([
        b"\xff\xd8", media.segment(0xDB, bytes([0]) + bytes([2] * 64)), media.segment(0xC2, b"\x08" + (8).to_bytes(2, "big") + (8).to_bytes(2, "big") + bytes([3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])),
        media.code_table(0, 0, [0, 3] + [0] * 14, [0, 3, 5]), media.code_table(1, 0, [0, 3] + [0] * 14, [0x00, 0x21, 0x03]), media.code_table(1, 1, two, [0x00, 0x11]),
        media.segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0])) + media.stuffed(bits("10", "10100", "01", "010", "00")),  # 20, -5, 0
        media.segment(0xDA, bytes([1, 1, 0, 1, 10, 0x01])) + media.stuffed(bits("10", "101", "01", "0", "00")),  # 5 << 1 at 1, -1 << 1 at 4, end
        media.segment(0xDA, bytes([1, 1, 1, 1, 10, 0x10])) + media.stuffed(bits("01", "1", "1", "0", "00", "1")),  # at 3: new +1 after one zero and the correction of 1; then end and the correction of 4
        b"\xff\xd9",
    ])
    del one
    f = media.coefficients(data)
    c = [p["coef"][0] for p in f["parts"].values()]
    assert [x[0] for x in c] == [20, -5, 0]
    assert c[0][:6].tolist()[1] == 11 and c[0][3] == 1 and abs(c[0][4]) in (2, 3)
    rgb = media.tensor(f | {"comment": b""}, media.inverse_transform())
    assert rgb.shape == (8, 8, 3) and rgb.dtype == np.uint8
    blue = media.plane(f["parts"][2], f["quant"], media.inverse_transform())
    assert (blue == round(128 - 10 / 8)).all()


def test_media_columns(odd):
    got = media.stored_and_read(odd).collect()
    assert len(got) == odd.count()
    want = {}
    for r in odd.collect():
        raw = (r.text or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        want.setdefault(r.doc_id, (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert all((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id] for r in got if r.doc_id != 2)
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (0, 1)}) == 1
    assert media.stored_and_read(odd.limit(0)).count() == 0




def test_foreign_and_random_texts_are_not_accepted(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = ["Привет как дела сегодня мы идем гулять в парк", "今天天气很好我们去公园玩", "Η γλώσσα είναι καλή σήμερα", "xqzt wvkj prrt zzgh qwxk vbnq zzkw", "dGhpcyBpcyBhIHRlc3Q gAbCdEfG hIjKlMn", "½ ² Ⅷ", "", None]
    more = spark.createDataFrame([(10_000_000 + i, t, None, "web", 0) for i, t in enumerate(odd)], docs.schema)
    kept = {r["doc_id"] for r in langid.accept(docs.unionByName(more)).select("doc_id").collect()}
    assert not {i for i in kept if i >= 10_000_000}
    clean = {r["doc_id"] for r in docs.select("doc_id", "text").collect() if r["text"] and langid.LETTERS.search(r["text"])}
    assert len(clean - kept) <= 0.01 * len(clean)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predictions(docs.unionByName(more)).where("doc_id >= 10000000").collect()}
    assert [got[10_000_000 + i] for i in (5, 6, 7)] == ["und"] * 3 and "und" not in [got[10_000_000 + i] for i in range(5)]


def test_languages_are_learned_from_every_labelled_row(spark):
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.lit("common words").alias("text"), F.lit("en").alias("lang"))
    learned = docs.where(~langid.held_out()).count()
    assert langid.labelled_rows(docs, None).count() == learned and learned > 6_000
    # the counts are those of all these rows: two words each
    model = langid.fit(docs)
    once = np.bincount(np.concatenate([langid.grams([w])[0] for w in ("common", "words")]), minlength=langid.BUCKETS) * float(learned) + 0.5
    assert np.allclose(model.logp[:, 0], np.log(once / once.sum()), atol=1e-4)
    more = docs.where(~langid.held_out()).selectExpr("doc_id + 9000 doc_id", "text", "lang").unionByName(docs)
    many = langid.labelled_rows(more, None).count()
    assert many > 8_000 and many == more.where(~langid.held_out()).count()
