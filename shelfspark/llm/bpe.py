"""BPE encoding and decoding in batched numpy merge rounds.

The words of many texts are found at once by character classes, and each distinct word is encoded once in each run.  The symbols
of all these words lie in one flat array; a round looks all neighbouring pairs up by binary search over the sorted pair
keys, takes each word's lowest rank, and merges every place of that pair.  Words leave the array when no pair of
theirs has a rank, so the rounds shrink.

Defined results: null and empty texts have no ids and decode to the empty text; texts of any length are encoded
whole; an added token's string in a text becomes its id, as the tokenizers library has it; repeated rows are encoded
alike; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from shelfspark.llm._batches import runs, two

#: Bytes of text whose distinct words are encoded together.
RUN_BYTES = 6 << 20
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: What may follow an apostrophe as a word of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: White space of Unicode.
SPACES = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _classes() -> np.ndarray:
    first = {"L": LETTER, "N": NUMBER}
    table = np.array([first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[list(SPACES)] = SPACE
    return table


def _slot(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BatchBPE:
    """Ids of whole texts for a byte-level BPE tokenizer file, with or without word-end suffix."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cuts = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        vocab, names = model["vocab"], byte_names()
        self.first = np.array([vocab[c] for c in names], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in names], np.int32)
        size = max([*vocab.values(), *self.added.values()]) + 1
        left, right = (np.array([vocab[m[i]] for m in model["merges"]], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        self.size, key = size, left * size + right
        order = np.argsort(key)
        self.keys, self.made = key[order], made[order].astype(np.int32)
        self.ranks = np.append(order, len(key)).astype(np.int32)  # of each sorted key; a pair without one comes last
        self.padded = np.append(self.keys, -1)
        self.seen = np.zeros(1 << 21, bool)
        self.seen[_slot(self.keys)] = True
        back = {c: b for b, c in enumerate(names)}
        pieces = [b""] * size
        for word, i in vocab.items():
            pieces[i] = bytes(back[c] for c in word.removesuffix(self.suffix)) + (b" " if self.suffix and word.endswith(self.suffix) else b"")
        for word, i in self.added.items():
            pieces[i] = word.encode()
        self.piece_at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.classes = _classes()

    def normal(self, text: str) -> str:
        if not self.suffix or not text:
            return text
        text = text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def words(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word starts in an array of code points (texts begin at ``starts``), and whether each word counts."""
        n, kind = len(codes), self.classes[codes]
        begin = np.zeros(n + 1, bool)
        begin[starts], begin[n] = True, True  # of a text
        edge = begin[:n].copy()
        edge[1:] |= kind[1:] != kind[:-1]
        run = np.flatnonzero(edge)
        end = np.append(run[1:], n)
        # an apostrophe alone before letters, with no blank that belongs to it
        single = (codes[run] == 39) & (end - run == 1) & (end < n)
        single[single] &= (kind[end[single]] == LETTER) & ~begin[end[single]]
        if not self.suffix:
            blank_before = np.zeros(len(run), bool)
            blank_before[1:] = (codes[run[1:] - 1] == 32) & ~begin[run[1:]]
            single &= ~blank_before
        if self.suffix:
            edge[kind == NUMBER] = True
        else:
            space = kind[run] == SPACE
            more = space & ~begin[end]  # white space before a word of the same text
            last = end[more] - 1
            edge[last] = True
            edge[end[more][codes[last] == 32]] = False  # a blank goes with the word after it
        for i in np.flatnonzero(single):
            at, to = int(run[i]) + 1, int(end[i + 1])
            after = "".join(map(chr, codes[at : min(at + 2, to)]))
            got = next((c for c in CONTRACTIONS if after.startswith(c)), None)
            if got:
                edge[at] = False
                if at + len(got) < to:
                    edge[at + len(got)] = True
        at = np.flatnonzero(edge)
        return at, (kind[at] != SPACE) if self.suffix else np.ones(len(at), bool)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair stands among the sorted pair keys, or the place after the last."""
        key = left.astype(np.int64) * self.size + right
        maybe = np.flatnonzero(self.seen[_slot(key)])  # most pairs that have no rank need no search
        i = np.searchsorted(self.keys, key[maybe])
        out = np.full(len(key), len(self.keys), np.int64)
        out[maybe] = np.where(self.padded[i] == key[maybe], i, len(self.keys))
        return out

    def merge(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has; word w is ``raw[at[w]:at[w + 1]]``, none is empty."""
        n, none = len(at) - 1, len(self.keys)
        symbol, word = self.first[raw], np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
        symbol[at[1:] - 1] = self.last[raw[at[1:] - 1]]
        pair = np.full(len(symbol), none, np.int64)
        pair[:-1] = self._look_up(symbol[:-1], symbol[1:])
        pair[at[1:] - 1] = none
        rank = self.ranks[pair]
        done_symbol, done_word = [], []
        while len(symbol):
            edge = np.flatnonzero(word[1:] != word[:-1]) + 1
            edge = np.concatenate([[0], edge])
            sizes = np.diff(np.append(edge, len(word)))
            least = np.minimum.reduceat(rank, edge)
            going = least < none
            if not going.all():
                stay = np.repeat(going, sizes)
                done_symbol.append(symbol[~stay])
                done_word.append(word[~stay])
                symbol, word, pair, rank, least, sizes = symbol[stay], word[stay], pair[stay], rank[stay], least[going], sizes[going]
                if not len(symbol):
                    break
            place = np.flatnonzero(rank == np.repeat(least, sizes))
            # of places in a row (a a a) every second one is merged
            new = np.ones(len(place), bool)
            new[1:] = place[1:] != place[:-1] + 1
            if not new.all():
                nth = np.arange(len(place)) - np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
                place = place[nth % 2 == 0]
            symbol[place] = self.made[pair[place]]
            pair[place] = pair[place + 1]  # for now: tells whether the word ends there
            end = np.append(word[1:] != word[:-1], True)
            end[place] = end[place + 1]
            keep = np.ones(len(symbol), bool)
            keep[place + 1] = False
            at_new = place - np.arange(len(place))
            symbol, word, pair, rank, end = symbol[keep], word[keep], pair[keep], rank[keep], end[keep]
            touched = np.concatenate([at_new, at_new[at_new > 0] - 1])
            touched = touched[~end[touched]]
            pair[at_new] = none
            pair[touched] = self._look_up(symbol[touched], symbol[touched + 1])
            rank[at_new], rank[touched] = none, self.ranks[pair[touched]]
        word, symbol = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.uint32), np.bincount(word, minlength=n)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the bounds of each text's."""
        if any(t in x for x in texts for t in self.added):
            return self._encode_with_added(texts)
        texts = [self.normal(x) for x in texts]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        whole = "".join(texts)
        data = whole.encode("utf-8", "surrogatepass")
        if not data:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if len(data) == len(whole):
            codes, byte_at = np.frombuffer(data, np.uint8), None
        else:
            codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
            width = 1 + (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)
            byte_at = np.concatenate([np.zeros(1, np.int32), np.cumsum(width, dtype=np.int32)])
        at, counts = self.words(codes, (ends - lengths)[lengths > 0])
        to = np.append(at[1:], len(codes))
        bounds = np.append(at, len(codes)) if byte_at is None else byte_at[np.append(at, len(codes))]
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
        if not counts.all():
            pieces, to = pieces.filter(pa.array(counts)), to[counts]
        coded = pc.dictionary_encode(pieces)
        if not len(coded.dictionary):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        store, counts = self.merge(*_bytes_of(coded.dictionary))
        begin = np.cumsum(counts) - counts
        own = coded.indices.to_numpy()
        sizes = counts[own]
        out = np.concatenate([[0], np.cumsum(sizes)])
        ids = store[np.repeat(begin[own] - out[:-1], sizes) + np.arange(out[-1])]
        return ids, out[np.concatenate([[0], np.searchsorted(to, ends, side="right")])]

    def _encode_with_added(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts are cut at all added tokens by one expression, and what lies between is encoded at once."""
        cut = [self.cuts.split(text) for text in texts]  # plain, token, plain, token, ..., plain
        ids, bounds = self.encode([part for parts in cut for part in parts[::2]])
        tokens = np.array([self.added[t] for parts in cut for t in parts[1::2]], np.uint32)
        plain = np.array([(len(parts) + 1) // 2 for parts in cut])  # of each text; one more than it has tokens
        ends = np.cumsum(plain)
        last = np.zeros(len(bounds) - 1, bool)
        last[ends - 1] = True
        out = np.insert(ids, bounds[1:][~last], tokens)
        return out, np.concatenate([[0], bounds[ends] + np.cumsum(plain - 1)])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are not UTF-8 become U+FFFD."""
        sizes = self.piece_at[ids + 1] - self.piece_at[ids.astype(np.int64)] if len(ids) else np.zeros(0, np.int64)
        out = np.concatenate([[0], np.cumsum(sizes)])
        data = self.piece_bytes[np.repeat(self.piece_at[ids.astype(np.int64)] - out[:-1], sizes) + np.arange(out[-1])].tobytes()
        cut = out[bounds].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:], strict=False)]


def _bytes_of(words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def encode_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` for every row: the ids of the whole text and the text that they decode to."""
    return _each(docs, tokenizer, id_col, text_col, False)


def digest_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, digests of what :func:`encode_documents` returns, made beside it."""
    return _each(docs, tokenizer, id_col, text_col, True)


def _each(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BatchBPE(tokenizer)
        for batch in runs(batches, budget=RUN_BYTES):
            ids, bounds = bpe.encode([x or "" for x in batch.column("text").to_pylist()])
            texts = bpe.decode(ids, bounds)
            if digest:
                raw, cut = ids.astype("<u4").tobytes(), (bounds * 4).tolist()
                columns = [
                    pa.array(np.diff(bounds)),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)]),
                    pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in texts]),
                ]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return two(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded string")
