"""The operators' kernels against plain versions, without Spark."""

import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm import avi, bpe, langid, licenses, packing, quality, sharding, simhash
from shelfspark.llm.queries import vocabulary

ODD = ["", " ", "a", "A b", "a b c d", " x\n\ny  z w q ", "É\x0bz", "ñ" * 50, "x" * 20_000, "Eron, Eron, Eron"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_bpe_equals_the_library(name):
    from tokenizers import Tokenizer

    own, library = bpe.BatchBPE(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
    rng = random.Random(3)
    letters = [*"aab Ss'tTrevmld.,!1²½Ⅷ٣éÉΣςİſ́\n\t\r   \x1c\x85​😀字ñ<|>_", "'ll", "s", " 's", "<|endoftext|>", "  ", "hello", " the", "aaaa"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(1500)] + ODD
    ids, bounds = own.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want
    plain = [t for t in texts if "<|endoftext|>" not in t]
    ids, bounds = own.encode(plain)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [e.ids for e in library.encode_batch(plain, add_special_tokens=False)]
    if name.startswith("byte"):
        assert own.decode(ids, bounds) == plain
        assert own.decode(np.array([255, 255], np.uint32), np.array([0, 2])) == [library.decode([255, 255], skip_special_tokens=False)]


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("columns", [7, 4096])
def test_blocks_by_brute_force(columns):
    """What a block connects is what pairs of 0.8 or more connect."""
    rng = random.Random(6)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(4)]
    texts = []
    for i in range(80):
        words = list(base[i % 4])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += ["", None, " ", "one", "one"]
    label = simhash.block_links(pa.array(texts), 0.8, 5, columns)
    sets = [{tuple((t or "").split()[j : j + 5]) for j in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set() for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    assert [[x == y for y in label] for x in label] == [[x == y for y in root] for x in root]


def test_fingerprints():
    assert simhash.fingerprints(pa.array([*ODD, None])).tolist() == [plain_fingerprint(t) for t in [*ODD, None]]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="aB \t\né1", max_size=30), max_size=8))
def test_fingerprints_of_any_texts(texts):
    assert simhash.fingerprints(pa.array(texts, pa.string())).tolist() == [plain_fingerprint(t) for t in texts]


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(1, 384), max_size=300))
def test_packing_holds_everything_once(sizes):
    windows = packing.pack(sizes) if sizes else []
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= packing.CAPACITY for w in windows)


def test_packing_pads_little():
    rng = random.Random(2)
    sizes = [rng.randint(1, 384) for _ in range(2048)]
    assert len(packing.pack(sizes)) <= 1.01 * sum(sizes) / packing.CAPACITY + 1


def plain_base(text):
    words = re.findall(licenses.WORD + "+", licenses.lower_ascii(text))
    places = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, label in licenses.BASE.items()}
    return len(words), sorted(i for v in places.values() for i in v), sorted(k for k, v in places.items() if v)


def test_license_rules():
    scanner = licenses.Scanner()
    assert len(scanner.rules) > 300
    labels = lambda t: [r.label for _, _, r in scanner.detections(licenses.lower_ascii(t))[1]]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("GPL v3 or later") == ["gpl-3.0-or-later"]
    assert labels("cc-by-sa 4.0; the MIT License") == ["cc-by-sa-4.0", "mit"]
    assert labels("mit der Zeit, an agple") == []


def test_intervals_inside_others_are_suppressed():
    spans = []
    assert [licenses._inside(spans, *x) for x in ((5, 9), (6, 8), (1, 7), (5, 9), (0, 20), (6, 19))] == [False, True, False, True, False, True]


def plain_schedule(sizes, shards):
    loads, went = [0.0] * shards, []
    for size in sorted(sizes, reverse=True):
        s = min(range(shards), key=lambda s: (loads[s], s))
        loads[s] += size
        went.append((size, s))
    return loads, Counter(went)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 60), max_size=400), st.integers(1, 6))
def test_schedule_is_longest_first(sizes, shards):
    """Whole classes at once give each shard what the heap gives it one by one."""
    loads, went = [0.0] * shards, Counter()
    for size, upto in sharding.schedule([(s, n, s * n) for s, n in Counter(sizes).items()], shards):
        for s, n in enumerate(b - a for a, b in zip([0, *upto], upto, strict=False)):
            loads[s] += n * size
            went[size, s] += n
    assert (loads, +went) == plain_schedule(sizes, shards)


def test_many_added_tokens_are_cut_at_once():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    texts = ["<|endoftext|>" * 8000, "a<|endoftext|><|endoftext|>b", "", "<|endoftext|> x", "plain"]
    ids, bounds = bpe.BatchBPE(path).encode(texts)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


@pytest.mark.parametrize("text", [None, "", "a", "x" * 576, "é" * 3000, "\x00ÿ" * 700])
def test_media_round_trip(text):
    frames, fps = avi.read_avi(avi.store(text))
    hist, payload = avi.histograms(frames)
    assert payload == avi.padded((text or "").encode()) and fps == 25
    assert len(hist) == len(frames) and np.allclose(hist.sum(1), 1)


def test_media_frames_are_baseline_jpeg():
    payload = os.urandom(576 * 2)
    coefficients, _, width, height = avi.decode_jpeg(avi.jpeg_frames(payload)[1])
    data = np.frombuffer(payload[576:], np.uint8).reshape(9, 64).astype(int)
    assert (width, height) == (24, 24) and (coefficients == np.where(data < 128, data - 255, data)).all()
    with pytest.raises(ValueError):
        avi.read_avi(b"RIFF....WAVE")


def test_shots_follow_the_material():
    calm = np.tile([1.0, 0, 0, 0], (20, 1))
    other = np.tile([0, 0, 0, 1.0], (20, 1))
    assert avi.shots(np.concatenate([calm, other]))[0].tolist() == [0, 20]


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(4)
    grades = rng.integers(0, 3, 900)
    rows = [np.unique(np.concatenate([[10 + g], rng.integers(100, 4000, 20)])) for g in grades]
    model = quality.train(rows, grades, 3)
    assert (np.diff(model.thresholds) >= 0).all()
    eta = np.array([model.w[r].sum() for r in rows])
    assert eta[grades == 0].mean() < eta[grades == 1].mean() < eta[grades == 2].mean()
    texts = pa.array([None, "", "word"])
    assert model.tails(texts)[:2].sum() == 0


@pytest.mark.parametrize("levels", [2, 4, 6])
def test_thresholds_stay_ordered(levels):
    rng = np.random.default_rng(levels)
    grades = np.sort(rng.integers(0, levels, 600)) if levels != 4 else np.repeat([0, 3], 300)  # of four grades two are never given
    rows = [np.unique(rng.integers(100, 3000, 15)) for _ in grades]
    assert (np.diff(quality.train(rows, grades, levels).thresholds) > 0).all()


def plain_shots(hist, window=12, times=2.0, least=0.05):
    d = [sum(abs(x - y) for x, y in zip(a, b, strict=True)) / 2 for a, b in zip(hist, hist[1:], strict=False)]
    begin = [0]
    for i, x in enumerate(d):
        before = d[max(0, i - window) : i]
        mean = sum(before) / len(before) if before else 0
        limit = max(mean + times * (sum((y - mean) ** 2 for y in before) / len(before)) ** 0.5, least) if len(before) >= 3 else 2 * least
        if x > limit:
            begin.append(i + 1)
    return begin


def test_shots_by_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(40):
        steps = rng.random((rng.integers(1, 60), 16)) ** rng.integers(1, 9)
        hist = steps / steps.sum(1, keepdims=True)
        assert avi.shots(hist)[0].tolist() == plain_shots(hist.tolist())


def test_plus_versions_and_spdx_lines():
    scanner = licenses.Scanner()
    for text, labels in (("GPLv2+", ["gpl-2.0-or-later"]), ("LGPLv2.1+", ["lgpl-2.1-or-later"]), ("SPDX-License-Identifier: (Apache-2.0 OR MIT)", ["spdx", "apache-2.0", "mit"]), ("SPDX-License-Identifier: GPL-2.0-or-later", ["spdx", "gpl-2.0-or-later"]), ("released under the MIT License", ["mit"])):
        assert [r.label for _, _, r in scanner.detections(licenses.lower_ascii(text))[1]] == labels, text


def plain_detections(rules, low):
    """All rules on the text, without keywords; of two where one holds the other the more important stays."""
    hits = [(r, *(m.span("at") if "at" in m.re.groupindex else m.span())) for r in rules if not r.base for m in re.finditer(r.pattern, low)]
    hits.sort(key=lambda h: (-h[0].priority, h[1] - h[2], h[1], h[0].label))
    kept = []
    for r, a, b in hits:
        if not any(x <= a and b <= y for _, x, y in kept):
            kept.append((r, a, b))
    return sorted((a, b, r.label) for r, a, b in kept)


def sample(pattern, which):
    """A text that a signature means: of alternatives the first or last, of classes the first."""
    pattern = re.sub(r"\[(.)[^\]]*\](?:\{(\d)[^}]*\})?", lambda m: m[1] * int(m[2] or 1), pattern).replace(".{1,120}?", "some name").replace(".{1,40}?", "copy")
    while (new := re.sub(r"\(\?:([^()]*)\)[?*]?", lambda m: m[1].split("|")[which], pattern)) != pattern:
        pattern = new
    return re.sub(r"\\|.\?(?=\S)|\?", lambda m: m[0][0] if m[0][0].isalpha() else "", pattern)


def test_license_rules_by_brute_force():
    scanner = licenses.Scanner()
    texts = [sample(line.split(" | ", 3)[3], i) for line in licenses.SIGNATURES.strip().splitlines() for i in (0, -1)]
    assert sum(bool(scanner.detections(licenses.lower_ascii(t))[1]) for t in texts) > 0.9 * len(texts)
    texts += ["GPLv3, the GNU GPL v3 or later; LGPL-2.1-only. CC BY-SA 4.0 / cc-by-nc 3.0", "Creative Commons Attribution-ShareAlike 4.0 International", "x mitx license gplv3x", ""]
    texts.append(" ... ".join(texts))
    for text in texts:
        low = licenses.lower_ascii(text)
        assert sorted((a, b, r.label) for a, b, r in scanner.detections(low)[1]) == plain_detections(scanner.rules, low), text


def test_language_model_without_rows_knows_nothing():
    assert langid.LanguageModel().predict(pa.array(["hallo", None]))[0] == ["und", "und"]
    assert langid.family_of("fr") == langid.family_of("es") != langid.family_of("en") and langid.family_of("xx") == "xx"
