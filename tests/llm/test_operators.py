"""The operators on tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from shelfspark.llm import _batches, avi, bpe, iblt, langid, licenses, neighbours, packing, preference, queries, quality, sharding, simhash, skew
from tests.llm.test_plain import plain_base, plain_fingerprint

WORDS = "the of and stone river moon house light dark green walk talk open close bird tree".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, node string, score string, key string"


def prose(seed, n=60):
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * seed) % len(WORDS)] + ("." if i % 9 == 8 else "") for i in range(n))


TEXTS = [
    *(prose(i) for i in range(30)), prose(3), prose(3), prose(3) + " end", None, None, "", "   ", "!!! 123", "A", "a b", "x" * 30_000, prose(5, 4000),
    "All rights reserved. CC-BY, GNU General Public License; all  rights\nreserved", "one\ntwo\none\ntwo", "<|endoftext|>",
]
ROWS = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or ""), 7, "s", "n", "z", "k") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[2], ROWS[2], (None, "no id at all", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(docs, nothing):
    model = langid.fit(docs)
    out = langid.identify(docs, model).collect()
    assert len(out) == len(ROWS)
    for r in out:
        text = TEXTS[r.doc_id] if r.doc_id is not None else "no id at all"
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", text or "")) and 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert langid.identify(nothing, langid.fit(nothing)).count() == 0
    assert langid.keep_identified(docs, model).columns == docs.columns


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)


def test_quality(spark, docs, nothing):
    grades = spark.createDataFrame([(i, i % 3) for i in range(30)], "doc_id long, grade int")
    out = quality.rate(docs, quality.fit(docs, grades)).collect()
    assert len(out) == len(ROWS) and all(0 <= r.expected_grade <= 2 and 0 <= r.tail_prob <= 1 for r in out)
    assert all(r.expected_grade == 0 for r in out if r.doc_id is not None and not TEXTS[r.doc_id])
    assert quality.rate(nothing, quality.fit(nothing, grades.where("false"))).count() == 0


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    grades = queries.graded(labels)
    model = quality.fit(docs, grades.where("doc_id % 5 <> 0"))
    rows = quality.rate(docs, model).join(grades.withColumnRenamed("grade", "g"), "doc_id").where("doc_id % 5 = 0").collect()
    mean = {g: sum(r.tail_prob for r in rows if r.g == g) / max(1, sum(r.g == g for r in rows)) for g in (0, 1, 2)}
    assert mean[2] > mean[1] + 0.3 and mean[2] > mean[0] + 0.3


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    out, library = packing.pack_documents(docs, path).collect(), Tokenizer.from_file(path)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in out:
        windows[r.sequence_id].append((r.offset, r.length))
        if r.doc_id not in (2, None):
            pieces[r.doc_id].append(r)
    for i, text in enumerate(TEXTS):
        if i == 2:
            continue
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            raw = b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length])
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(raw))
            at += r.length
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(nothing, path).count() == 0


def test_licenses(docs, nothing):
    for r in licenses.scan(docs).where("doc_id is not null").collect():
        n, starts, labels = plain_base(TEXTS[r.doc_id] or "")
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert licenses.scan(nothing).count() == 0


def test_license_scores_stay_within_one(spark):
    header = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    texts = [header, "SPDX-License-Identifier: MIT. All rights reserved.", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0. All rights reserved.", header + " All rights reserved. cc by"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == 4 and all(0 < r.score <= 1 and r.labels for r in rows)


def test_every_language_is_learned(spark):
    """Labels beyond the most frequent ones can be predicted too."""
    rows = [(i, " ".join(f"{chr(97 + i % 20)}{chr(98 + i // 20 % 20)}{w}" for w in range(30)), f"x{i % 300:03}") for i in range(1200)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 300


def test_sharding(docs, nothing):
    out = sharding.assign(docs, shards=5, rows_per_slot_block=4).collect()
    assert len(out) == len(ROWS)
    by_shard, of_text = defaultdict(list), defaultdict(set)
    for r in out:
        by_shard[r.shard].append(r.slot)
        text = (TEXTS[r.doc_id] or "") if r.doc_id is not None else "no id at all"
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 16, zlib.crc32(text.encode()), "bytes", None)
        of_text[text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and all(len(s) == 1 for s in of_text.values())
    assert sharding.assign(nothing).count() == 0


def test_simhash(docs, nothing):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.label_components(docs).where("doc_id is not null").collect()}
    prints = {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if root[a] > root[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[a], changed = root[b], True
    assert got == {(i, f"{p:016x}"): root[i] for i, p in prints.items()}
    assert simhash.label_components(nothing).count() == 0


@pytest.mark.parametrize("radius", [4, 3, 2])
def test_large_buckets_give_the_same_components(spark, radius):
    """Many fingerprints near each other: pairs, and midpoints, agree with brute force."""
    prints = sorted({0x1234 << 40 | sum(1 << b for b in range(40) if i >> (b % 11) & 1 and b % 3 == i % 3) for i in range(300)})
    nodes = spark.createDataFrame([(p,) for p in prints], "node long")
    want = {}
    for p in prints:
        front, seen = [p], {p}
        while front:
            x = front.pop()
            new = [y for y in prints if y not in seen and (x ^ y).bit_count() <= radius]
            seen.update(new)
            front += new
        want[p] = min(seen)
    for small in (3, 1000):
        edges = simhash.links(nodes, radius, small=small)
        assert all((r.u ^ r.v).bit_count() <= radius for r in edges.collect())
        got = {r.node: r.root for r in simhash.components(edges).collect()}
        assert {p: got.get(p, p) for p in prints} == want


def test_hot_keys_are_dealt_over_parts(spark):
    rows = spark.range(5000).selectExpr("id", "if(id < 4000, null, if(id < 4900, 7, id)) as k").cache()
    unique = spark.createDataFrame([(7, "hot"), (4950, "one")], "k long, name string")
    assert skew.salted(rows, unique, ["k"], share=16).groupBy("name").count().orderBy("name").collect() == [("hot", 900), ("one", 1)]
    assert skew.salted(rows, unique, ["k"], "left", share=16).count() == 5000
    assert {r.k: r["_parts"] for r in skew.hot(rows.dropna(), ["k"], share=16).collect()} == {7: 15}
    places = skew.ranked(rows.withColumn("g", F.lit(1)), "g", ["id"], "place", 9).select("place").collect()
    assert sorted(p.place for p in places) == list(range(5000))


def test_bpe(docs, nothing):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in bpe.digest_documents(docs, path).where("doc_id is not null").collect():
        ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(docs, path).where("doc_id = 38").first().decoded == "A" and bpe.digest_documents(nothing, path).count() == 0


def test_media(docs, nothing):
    for r in avi.describe(docs).where("doc_id is not null").collect():
        payload = avi.padded((TEXTS[r.doc_id] or "").encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    clips = avi.clips(docs).where("doc_id = 41").orderBy("clip").collect()
    assert clips[0].start_s == 0 and all(a.end_s == b.start_s for a, b in zip(clips, clips[1:], strict=False))
    assert avi.describe(nothing).count() == 0


def test_preference(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "ok"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (3, 0, "user", None), (4, 0, None, "x"), (None, 0, "user", "lost"), (2, 1, "assistant", "no")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in preference.format_pairs(preference.borrowed_pairs(table)).collect()}
    assert set(out) == {1, 2, 3, 4}
    assert out[1].prompt == "<|user|>\nhi\n" and out[1].chosen_text == "<|assistant|>\nyes\n<|user|>\nok\n" and out[1].rejected_text == "<|assistant|>\nno\n<|user|>\nok\n"
    assert [tuple(x) for x in out[1].chosen_mask] == [(0, 14, 0), (14, 18, 1), (18, 27, 0), (27, 30, 0)]
    assert not out[3].distinct and out[3].prompt == "<|user|>\n\n"
    pairs = spark.createDataFrame([(1, None, [("user", "a")])], "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    assert preference.format_pairs(pairs).first().rejected_text == "<|user|>\na\n"
    assert preference.format_pairs(preference.borrowed_pairs(table.where("false"))).count() == 0
    clash = preference.format_pairs(pairs.selectExpr("id", "chosen", "rejected", "'mine' as prompt", "1 as chosen_text", "2 as extra"))
    assert len(set(clash.columns)) == len(clash.columns) and clash.first().extra == 2 and clash.first().prompt == ""


ENDS = regex.compile(r"\s(?<=[.!?\u2026\u061F\u06D4\u0964\u0965\u0589\u1362][\)\]\"'\u00BB\u201D\u2019]?\s)\s*|[\r\n]+", regex.ASCII)


def paragraphs(text):
    """Line and sentence ends of any script; longer runs are cut after words whose hash is a multiple of 8, and after 32 words."""
    out = set()
    for p in ENDS.split(re.sub("([\u3002\uFF01\uFF1F\uFF61])", "\\1\n", text)):
        p = p.strip(" ")
        if len(p) <= 240:
            out.add(p)
            continue
        words, piece = re.findall(r"\S{1,64}", p, re.ASCII), []
        for i, w in enumerate(words):
            piece.append(w)
            if (i + 1) % 32 == 0 or xxhash.xxh64_intdigest(w, 42) % 8 == 0:
                out.add(" ".join(piece))
                piece = []
        if piece:
            out.add(" ".join(piece))
    return out - {""}


def test_paragraphs_by_brute_force(spark):
    """Marks that close a sentence, scripts without white space, long runs, very long words: the digests are those of the plain version."""
    cyrillic = "Река была тиха. Луна стояла над домом! «Кто там?» Никто не ответил… " * 3
    odd = [cyrillic, "一。二！三？四", 'He said "no." Then (really!) he left. ' * 9, "word " * 700, "é" * 999, "a.b. c .\td?  e\r\n\r\nf", "x\x0b. y", "." * 300, " ".join(f"w{i}" for i in range(500)), "end.\u2019 next"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*odd, *(t or "" for t in TEXTS)])], "doc_id long, text string").select("text", iblt.digests(F.col("text")).alias("d")).collect()
    hashed = {p: h for r in rows for p in paragraphs(r.text) for h in [xxhash.xxh64_intdigest(p, 42) & ~0xFFFF]}
    for r in rows:
        assert {d & (2**64 - 1) & ~0xFFFF for d in r.d} == {hashed[p] for p in paragraphs(r.text)}, r.text[:60]


def test_sketches(spark, nothing):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, keys int, edited string")
    texts = [t or "" for t in TEXTS]
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = iblt.compare_next(docs).collect()
    assert Counter(r.doc_id for r in got)[0] == 2 and len(got) == len(rows)
    for r in got:
        i = r.doc_id // 3
        own, after = texts[i], texts[(i + 1) % len(texts)]
        cut = len(own) // 4
        edited = own[: len(own) - cut] + after[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(paragraphs(own), paragraphs(edited))) and r.near_next == pytest.approx(like(paragraphs(own), paragraphs(after)))
    assert iblt.compare_next(nothing).count() == 0
    assert iblt.compare_next(docs.limit(0).unionAll(docs.where("doc_id = 3"))).first().near_next == 1


def test_small_sketches_are_retried(spark):
    """Sketches that begin with one cell a subtable grow until their digests, and differences, can be listed."""
    keys = lambda a, b: F.transform(F.sequence(F.lit(a), F.lit(b)), lambda i: iblt.checked(F.xxhash64(i.cast("long"))))
    rows = spark.range(1).select("id")
    for a, b, c, d in ((1, 400, 361, 400), (1, 3, 2, 9), (1, 2000, 1, 2001), (1, 1, 1, 1)):
        made = rows.withColumns({"x": keys(a, b), "y": keys(c, d)})
        made = iblt.with_fingerprint(iblt.with_fingerprint(made, "f", "x", first=1, room=0), "g", "y", first=1, room=0)
        made = iblt.with_likeness(made, "like", "f", "g").select("f", "g", "like").first()
        x, y = set(range(a, b + 1)), set(range(c, d + 1))
        assert made.like == pytest.approx(len(x & y) / len(x | y)) and made.f.n == len(x) and made.f.m * 3 >= len(x)


def test_likeness_from_the_returned_strings(spark):
    """The returned fingerprints are what is compared: read back, they give the returned likeness."""
    docs = spark.createDataFrame([(i, "\n".join(f"line {j} of {i % 3}" for j in range(i * 7 % 50))) for i in range(20)] + [(i, None) for i in (20, 21)], "doc_id long, text string")
    out = spark.createDataFrame(iblt.compare_next(docs).collect())
    assert {r.fingerprint for r in out.collect() if r.n_chars == 0} == {"0;40;"}
    parsed = out.select("doc_id", "near_edited", iblt.read(F.col("fingerprint")).alias("f"), iblt.read(F.col("edited_fingerprint")).alias("g"))
    parsed = spark.createDataFrame(parsed.collect(), parsed.schema)
    for r in iblt.with_likeness(parsed, "again", "f", "g").collect():
        assert r.again == r.near_edited


def test_a_hot_id_is_dealt_over_parts(spark):
    """An id of most rows: each row's next is the next id, and the id before sees the first of them by hash."""
    rows = [(None, f"none {i}\nx") for i in range(40)] + [(5, f"five {i}\ny\nz") for i in range(60)] + [(9, "nine\nz"), (-(2**63), "least")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = iblt.compare_next(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter({None: 40, 5: 60, 9: 1, -(2**63): 1})
    for i, r in enumerate(sorted((r for r in got if r.doc_id == 5), key=lambda r: r.edited_sha256)):
        assert r.near_next == pytest.approx(1 / 4)
    assert {r.edited_sha256 for r in got if r.doc_id == 5} == {hashlib.sha256((t[: len(t) - len(t) // 4] + "nine\nz"[: len(t) // 4]).encode()).hexdigest() for i, t in rows if i == 5}


def test_next_in_order(spark):
    rows = spark.createDataFrame([(i * i,) for i in range(100)], "k long")
    got = {r.k: r.next_key for r in neighbours.with_next(rows, "k").collect()}
    assert got == {i * i: (i + 1) ** 2 if i < 99 else 0 for i in range(100)}


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        sizes.append(docs.count())
        assert name == "packing" or docs.columns == columns
    assert sizes[0] >= sizes[1] >= sizes[2] > sizes[3] > 0
    before = list(_batches.tables(spark))
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == docs.columns and _batches.tables(spark) == [*before, out._saved_at]


def test_run_by_brute_force(spark):
    """The whole pipeline on sf0.001: plain predictions, plain components, and pieces of what is left."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = langid.fit(docs)
    left = {i: t for i, t in texts.items() if (x := plain_language(model, t))[0] != "und" and x[1] >= 0.25}
    kept = docs.where(F.col("doc_id").isin(list(left)))
    rating = quality.fit(kept, queries.graded(spark.read.parquet(f"{sf}/labels.parquet")))
    left = {i: t for i, t in left.items() if plain_tails(rating, t)[-1] >= quality.LEAST}
    root = plain_near(left)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {i for i in left if root[i] == i}


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Rows that share an id, or have none, with unlike texts and like ones; null and empty texts; an extra column."""
    texts = [unlike(i) for i in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[5]), (9, texts[5]), (10, texts[5] + " end"), (11, None), (12, ""), (None, None), (13, " "), (14, "!!"), (15, texts[0])]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "n", [1]) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _node string, _id array<int>")


def test_near_dedup_keeps_unlike_rows(spark, odd_docs):
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.distinct(spark, odd_docs, "").collect())
    texts = [unlike(i) for i in range(6)]
    want = Counter([(15, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[5])])
    assert {k: n for k, n in got.items() if (k[1] or "").strip(" !")} == want
    rest = [k for k in got if not (k[1] or "").strip(" !")]
    assert sorted(rest, key=str) == [(11, None), (14, "!!")]  # texts without words are alike, and one word is a text


def test_stages_on_odd_rows_and_empty_tables(spark, odd_docs):
    for stage in (corpus_pipeline.language, corpus_pipeline.good, corpus_pipeline.distinct):
        out = stage(spark, odd_docs, "/root/testdata/sf0.001")
        assert out.columns == odd_docs.columns and out.count() <= odd_docs.count()
        assert stage(spark, odd_docs.limit(0), "/root/testdata/sf0.001").count() == 0
    pieces = corpus_pipeline.packed(spark, odd_docs, "").collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(r.doc_id for r in odd_docs.collect())
    assert corpus_pipeline.packed(spark, odd_docs.limit(0), "").count() == 0


def plain_language(model, text):
    """Family by the surest machine, then votes of pairs, one text and one trigram at a time."""
    if text is None or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    raw, low = text.encode(), bytearray()
    for i, b in enumerate(raw):
        if i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97:
            b += 32
        low.append(b if b >= 128 else (b | 32) if chr(b).isalpha() else 32)
    s = bytes([32, *low, 32])
    codes = [((s[i] << 16 | s[i + 1] << 8 | s[i + 2]) * 2654435761 % 2**32) >> (32 - langid.BITS) for i in range(len(s) - 2)]
    sure = lambda w: 1 / (1 + math.exp(-2 * max(-30, min(30, langid.SCALE * sum(float(w[c]) for c in codes) / len(codes) + w[-1]))))
    p = [sure(w) for w in model.family_w] if len(model.families) > 1 else [1.0]
    family, share = max(zip(model.families, p, strict=True), key=lambda x: x[1])
    own = [x for x in model.langs if langid.family_of(x) == family]
    votes, belief = Counter(), Counter()
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            q = sure(model.pairs[a, b])
            votes[a if q >= 0.5 else b] += 1
            belief[a] += q
            belief[b] += 1 - q
    best = max(own, key=lambda x: votes[x] + belief[x] / (2 * len(own)))
    return best, share / sum(p) * (belief[best] / (len(own) - 1) if len(own) > 1 else 1)


def test_language_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts, model = {r.doc_id: r.text for r in docs.collect()}, langid.fit(docs)
    got = queries.queries()["op2_language"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        lang, score = plain_language(model, texts[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4)


def plain_tails(model, text):
    """Each grade's tail from the distinct features of one text."""
    size = len(model.w)
    kind = lambda b: 0 if b in b" \t\n\x0b\x0c\r" else 1 if b >= 128 or chr(b).isalnum() else 2
    tokens = [(k, bytes(g)) for k, g in groupby((text or "").encode(), kind) if k]
    if not text:
        return [0.0] * len(model.thresholds)

    def hashed(raw):
        h = sum((b | 32 if 65 <= b <= 90 else b) * pow(0x100000001B3, i % 64 + 1, 1 << 64) for i, b in enumerate(raw)) % 2**64
        h ^= h >> 29
        h = h * 0xBF58476D1CE4E5B9 % 2**64
        return h ^ h >> 32

    hashes = [hashed(raw) for _, raw in tokens]
    places = {h % (size - quality.SHAPES) for h in hashes}
    words = [h for (k, _), h in zip(tokens, hashes, strict=True) if k == 1]
    n, other = max(len(words), 1), len(tokens) - len(words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    shapes = (min(same / n * 20, 9), min(other / n * 10, 15), min(len(places) / max(len(tokens), 1) * 10, 9) + 10 * int(min(math.log2(n), 15)))
    eta = sum(model.w[x] for x in places) + sum(model.w[size - quality.SHAPES + 512 * i + int(s)] for i, s in enumerate(shapes))
    return [1 / (1 + math.exp(-max(-30, min(30, eta - t)))) for t in model.thresholds]


def test_quality_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, queries.graded(spark.read.parquet(f"{sf}/labels.parquet")))
    got = queries.queries()["op1_quality"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        p = plain_tails(model, texts[r.doc_id])
        assert (r.expected_grade, r.tail_prob) == (pytest.approx(sum(p)), pytest.approx(p[-1])) and r.grade == sum(x >= 0.5 for x in p)


def test_fits_are_bounded(spark, monkeypatch):
    """Rows without an id and rows that repeat one do not swell what the driver collects."""
    seen = {}
    monkeypatch.setattr(langid, "train_svm", lambda rows, y, size, **_: seen.setdefault("language", len(rows)) * np.zeros(size + 1))
    rows = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text", "if(id % 3 = 0, 'en', if(id % 3 = 1, 'fr', 'ru')) as lang")
    without = spark.range(20000).selectExpr("cast(null as long)", "concat('other ', id)", "'en'")
    repeated = spark.range(20000).selectExpr("5000L", "'same'", "'en'")
    langid.fit(rows.unionAll(without).unionAll(repeated), rows_per_language=100)
    assert 100 < seen["language"] < 400
    monkeypatch.setattr(quality, "train", lambda rows, grades, levels, **_: seen.setdefault("quality", len(rows)))
    grades = spark.range(3000).selectExpr("id as doc_id", "cast(id % 3 as int) as grade").unionAll(spark.createDataFrame([(5000, 1), (5000, 0), (None, 2)], "doc_id long, grade int"))
    quality.fit(rows.unionAll(without).unionAll(repeated), grades, rows_per_grade=2000)
    assert seen["quality"] == 3001


def test_sharding_by_brute_force(spark):
    """Every shard holds what the heap gives it, class by class, and loads are near equal."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size, of = Counter(), {}
    for t in texts.values():
        size[t] += len(t.encode()) + 16
    for t, n in size.items():
        of[t] = n >> max(n.bit_length() - 10, 0) << max(n.bit_length() - 10, 0)
    count, whole = Counter(of.values()), Counter()
    for t, n in size.items():
        whole[of[t]] += n
    loads, want = [0.0] * 40, Counter()
    for c in sorted(of.values(), reverse=True):
        s = min(range(40), key=lambda s: (round(loads[s], 6), s))
        loads[s] += whole[c] / count[c]
        want[c, s] += 1
    rows = queries.queries()["op5_sharding"](spark, sf).collect()
    shard_of, held = {}, Counter()
    for r in rows:
        assert shard_of.setdefault(texts[r.doc_id], r.shard) == r.shard
        held[r.shard] += r.size
    assert Counter(of[t] for t in shard_of) == Counter(c for c, _ in want.elements())
    planned = [0.0] * 40
    for t, s in shard_of.items():
        planned[s] += whole[of[t]] / count[of[t]]
    assert sorted(planned) == pytest.approx(sorted(loads))  # equal loads may change places
    assert max(held.values()) - min(held.values()) <= max(size.values()) / 8


def test_clips_of_the_query(spark):
    from tests.llm.test_plain import plain_shots

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.queries()["op8_media"](spark, sf).collect():
        frames, fps = avi.read_avi(avi.store(texts[r.doc_id]))
        begin = plain_shots(avi.histograms(frames)[0].tolist())
        assert [c.first_frame for c in r.clips] == begin and [c.start_s for c in r.clips] == [b / fps for b in begin]
        assert r.clips[-1].end_s == len(frames) / fps and f"frames={len(frames)};shots={len(begin)};" in r.feature


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def unlike(seed):
    return " ".join(hashlib.md5(f"{seed} {i}".encode()).hexdigest()[:6] for i in range(80))


def plain_near(texts, least=0.8):
    """The smallest key reachable over similarities of ``least`` or more, for texts by key."""
    s = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in s:
        for b in s:
            if a < b and len(s[a] & s[b]) >= least * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in s}


def test_near_copies_by_brute_force(spark):
    """On all documents of sf0.01 every pair of 0.8 or more is linked and nothing else: recall 1."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_near({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == want and len(set(want.values())) < len(want)


def test_near_copies_at_the_boundary(spark):
    """Appended passages and replaced tails of either side of a similarity of 0.8, and a group of 60 unlike templates."""
    words = lambda seed, n: [hashlib.md5(f"{seed} {i}".encode()).hexdigest()[:7] for i in range(n)]
    rows, linked, apart = [], [], []
    for seed in range(150):
        base, other = words(seed, 404), words(f"other {seed}", 404)  # 400 shingles
        kinds = [(100, 0, True), (102, 0, False), (60, 0, True), (44, 44, True), (45, 45, False)]  # words added, words cut before, 0.8 or more
        more, cut, same = kinds[seed % 5]
        rows += [(2 * seed, " ".join(base)), (2 * seed + 1, " ".join(base[: 404 - cut] + other[:more]))]
        (linked if same else apart).append(2 * seed)
    common = words("template", 200)
    rows += [(1000 + i, " ".join(common + words(f"t{i}", 60))) for i in range(60)]  # 0.62
    label = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in linked if label[i] != label[i + 1]] == []
    assert [i for i in apart if label[i] == label[i + 1]] == []
    assert all(label[1000 + i] == 1000 + i for i in range(60))


def test_candidates_of_near_copies():
    """Nearly all pairs at 0.8 share a band, though their edit is one passage."""
    words = lambda seed, n: [hashlib.md5(f"{seed} {i}".encode()).hexdigest()[:7] for i in range(n)]
    a = [" ".join(words(s, 404)) for s in range(1000)]
    b = [" ".join(words(s, 404) + words(f"other {s}", 100)) for s in range(1000)]
    (ka, la, _), (kb, lb, _) = (simhash.band_keys(*simhash.shingle_sets(simhash.pa.array(t)), 1000) for t in (a, b))
    assert (simhash.jaccard(simhash.pa.array(a), simhash.pa.array(b)) == 0.8).all()
    assert ((ka == kb).any(1)).sum() >= 998
    assert ((la == lb).sum(1) >= simhash.fewest(0.8)).sum() >= 999


def test_edited_quarter_leaves_shared_digests(spark, tmp_path):
    """One-line texts in Cyrillic, capitals, Chinese and without any sentence end, through the registered query."""
    words = lambda n: [hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(n)]
    texts = [" ".join(f"Слово {i} стоит тут." for i in range(60)), " ".join(f"NUMBER {i} STANDS." for i in range(60)), "".join(f"第{i}句话。" for i in range(60)), " ".join(words(400)), " ".join(f"A line {i} says so." for i in range(60))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op10_fingerprint"](spark, str(tmp_path)).collect()
    assert len(got) == 5 and all(0.3 < r.near_edited < 0.95 for r in got), [(r.doc_id, r.near_edited) for r in got]


def test_versions_right_after_the_name():
    scanner = licenses.Scanner()
    for text, label in (("GPLv3", "gpl-3.0"), ("LGPLv2.1", "lgpl-2.1"), ("AGPLv3", "agpl-3.0"), ("MPLv2", "mpl-2.0"), ("GPLv2 or later", "gpl-2.0-or-later")):
        assert [r.label for _, _, r in scanner.detections(licenses.lower_ascii(f"Under {text}, as is"))[1]] == [label]
    assert not scanner.detections("gplvx and gplv are no versions")[1]
