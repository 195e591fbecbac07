"""Secret scans: rules, and a character convolutional network over every candidate and what stands around it.

Candidates are the places of the rules (``assign``, ``access``, ``hex``) and every run of 16 or more key characters that holds
a digit or both small and capital letters.  The network reads a candidate whole, with 32 bytes before and 16 after it: a
convolution over characters (which know whether they lie inside the candidate), its largest value over the whole sequence and
its mean over the candidate, and one hidden layer.  It is trained on labelled findings: those that the rules label in a bounded sample of
documents, and examples written from the public forms of keys and of look-alikes.  A held-out part of them calibrates the
logits (Platt) and gives, for each group of findings, the highest threshold that keeps a stated recall; the lowest of these counts.

Spans of the rules always stay; what the network adds has the kind ``model`` and never overlaps them.

Defined results: a null text counts as empty; it has no spans, and ``base_sha256`` is that of the empty string; repeated rows
and rows without an id get a row each; equal texts get equal values; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm._batches import flat, runs, ship, two

#: The rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "model")

LEAST_RUN, BEFORE, AFTER, WIDTH = 16, 32, 16, 5
_KEY = np.zeros(256, bool)
_KEY[list(string.ascii_letters.encode() + string.digits.encode() + b"+/_=-")] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A code for each printable ASCII character, one for control characters, one for bytes of other letters, one for padding.
_CODE = np.array([c - 32 if 32 <= c < 127 else 95 if c < 128 else 96 for c in range(256)], np.int16)
PAD, CODES = 97, 98


def mixed(run: bytes) -> bool:
    """A run that may be a key: a digit, or both small and capital letters."""
    return re.search(rb"[0-9]", run) is not None or (re.search(rb"[a-z]", run) is not None and re.search(rb"[A-Z]", run) is not None)


def candidates(texts: pa.Array) -> Iterator[tuple[int, str, int, int]]:
    """``text, kind, start, end`` (bytes of the texts laid end to end) of all candidates, by text."""
    data, starts, ends = flat(texts)
    if not len(data):
        return
    raw = data.tobytes()
    key = _KEY[data]
    first = key.copy()
    first[1:] &= ~key[:-1]
    begins = starts[(starts < len(data)) & (ends > starts)]
    first[begins] = key[begins]  # a run never goes from one text into the next
    last = key.copy()
    last[:-1] &= ~key[1:]
    last[begins[1:] - 1] = key[begins[1:] - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = b - a >= LEAST_RUN
    a, b = a[long], b[long]
    of = np.searchsorted(starts, a, side="right") - 1
    while (empty := (ends[of] <= a)).any():  # an empty text may begin at the same byte
        of[empty] -= 1
    runs_of: dict[int, list[tuple[int, int]]] = {}
    for t, x, y in zip(of.tolist(), a.tolist(), b.tolist(), strict=True):
        runs_of.setdefault(t, []).append((x, y))
    low = raw.translate(_LOWER)
    for t, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        found = []
        if any(low.find(k, s, e) >= 0 for k in KEYWORDS):
            text = raw[s:e].decode()
            at, byte = 0, s
            for m in ASSIGN.finditer(text):
                if len(m[2]) >= LEAST_VALUE:
                    byte += len(text[at : m.start()].encode())
                    at = m.start()
                    found.append(("assign", byte, byte + len(m[0].encode())))
        for x, y in runs_of.get(t, ()):
            found += [("access", x + m.start(), x + m.end()) for m in ACCESS.finditer(raw[x:y]) if m.end() - m.start() >= LEAST_ACCESS]
            found += [("hex", x + m.start(), x + m.end()) for m in HEX.finditer(raw[x:y]) if m.end() - m.start() >= LEAST_HEX]
        taken = sorted((x, y) for _, x, y in found)
        for x, y in runs_of.get(t, ()):
            if mixed(raw[x:y]) and not any(p < y and x < q for p, q in taken):
                found.append(("model", x, y))
        for kind, x, y in found:
            yield t, kind, x, y


def sequences(data: np.ndarray, spans: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of ``text start, text end, start, end`` with context and padding; where each sequence begins, and its candidate begins and ends."""
    parts, at, inner, outer, n = [], [], [], [], 0
    for s, e, a, b in spans:
        lo, hi = max(s, a - BEFORE), min(e, b + AFTER)
        codes = np.full(hi - lo + WIDTH - 1, PAD, np.int16)
        codes[: hi - lo] = _CODE[data[lo:hi]]
        codes[a - lo : b - lo] += CODES  # inside
        parts.append(codes)
        at.append(n)
        inner.append(n + a - lo)
        outer.append(n + b - lo)
        n += len(codes)
    return np.concatenate(parts), np.array(at), np.array(inner), np.array(outer)


@dataclass
class Network:
    """Filters (tap, code, filter), their bias, the hidden layer, the output, the calibration and the threshold."""

    w: np.ndarray
    b: np.ndarray
    hidden: np.ndarray
    hidden_b: np.ndarray
    out: np.ndarray
    out_b: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def maps(self, codes: np.ndarray) -> np.ndarray:
        """The convolution, rectified, at each place; the last ``WIDTH - 1`` places of a sequence are padding."""
        n = len(codes) - WIDTH + 1
        h = np.broadcast_to(self.b, (n, len(self.b))).copy()
        for j in range(WIDTH):
            h += self.w[j][codes[j : j + n]]
        return np.concatenate([np.maximum(h, 0), np.zeros((WIDTH - 1, len(self.b)), h.dtype)])

    def pooled(self, codes: np.ndarray, at: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.maps(codes)
        h[codes == PAD] = 0
        most = np.maximum.reduceat(h, at)
        sums = np.concatenate([np.zeros((1, h.shape[1])), np.cumsum(h, axis=0, dtype=np.float64)])
        return np.concatenate([most, (sums[outer] - sums[inner]) / (outer - inner)[:, None]], axis=1), h

    def logits(self, data: np.ndarray, spans: list[tuple[int, int, int, int]], budget: int = 1 << 17) -> np.ndarray:
        """Of each span, in batches of about ``budget`` characters (a longer candidate stays whole)."""
        out, own, size = [], [], 0
        for i, x in enumerate(spans):
            own.append(x)
            size += x[3] - x[2] + BEFORE + AFTER
            if size >= budget or i + 1 == len(spans):
                pooled, _ = self.pooled(*sequences(data, own))
                out.append(np.tanh(pooled @ self.hidden + self.hidden_b) @ self.out + self.out_b)
                own, size = [], 0
        return np.concatenate(out) if out else np.zeros(0)

    def probabilities(self, data: np.ndarray, spans: list[tuple[int, int, int, int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(data, spans) + self.shift, -30, 30)))


Finding = tuple[str, str, str, bool, str]  # before, candidate, after, whether it is a secret, group


def _laid(findings: list[Finding]) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    parts, spans, n = [], [], 0
    for before, value, after, *_ in findings:
        x, y, z = before.encode(), value.encode(), after.encode()
        spans.append((n, n + len(x) + len(y) + len(z), n + len(x), n + len(x) + len(y)))
        parts.append(x + y + z)
        n = spans[-1][1]
    return np.frombuffer(b"".join(parts), np.uint8), spans


def train(findings: list[Finding], *, filters: int = 16, hidden: int = 12, rounds: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 12) -> Network:
    """Adam on the logistic loss, both classes of equal weight; gradients go to the places of the largest values and, for the mean, to all."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.1, (WIDTH, 2 * CODES, filters)), np.zeros(filters), rng.normal(0, 0.3, (2 * filters, hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), 0.0)
    data, spans = _laid(findings)
    y = np.array([f[3] for f in findings], np.float64)
    weight = np.where(y == 1, len(y) / max(2 * y.sum(), 1), len(y) / max(2 * (1 - y).sum(), 1))
    names = ("w", "b", "hidden", "hidden_b", "out")
    m, v = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    order, step = np.arange(len(spans)), 0
    for _ in range(rounds):
        rng.shuffle(order)
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            codes, at, inner, outer = sequences(data, [spans[i] for i in own])
            pooled, h = net.pooled(codes, at, inner, outer)
            z = np.tanh(pooled @ net.hidden + net.hidden_b)
            p = 1 / (1 + np.exp(-np.clip(z @ net.out + net.out_b, -30, 30)))
            d = (p - y[own]) * weight[own] / len(own)
            dz = np.outer(d, net.out) * (1 - z * z)
            dp = dz @ net.hidden.T
            g = {"out": z.T @ d, "hidden": pooled.T @ dz, "hidden_b": dz.sum(0), "w": np.zeros_like(net.w)}
            dh = np.zeros_like(h)
            for i, (a, b) in enumerate(zip(at, [*at[1:], len(codes)], strict=True)):
                dh[a + h[a:b].argmax(0), np.arange(filters)] += dp[i, :filters]
                dh[inner[i] : outer[i]] += dp[i, filters:] / (outer[i] - inner[i])
            dh *= h > 0
            n = len(codes) - WIDTH + 1
            for j in range(WIDTH):
                np.add.at(g["w"][j], codes[j : j + n], dh[:n])
            g["b"] = dh.sum(0)
            step += 1
            net.out_b -= rate * d.sum()
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                setattr(net, k, getattr(net, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8))
    net.w = net.w.astype(np.float32)
    return net


def calibrate(net: Network, findings: list[Finding], recall: float) -> Network:
    """Platt's slope and shift, then the threshold under which each group of secrets keeps ``recall``."""
    data, spans = _laid(findings)
    x, y = net.logits(data, spans), np.array([f[3] for f in findings], np.float64)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(100):  # Newton's steps on two numbers, drawn to 1 and 0 so that separable findings stay finite
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        r, s = p - target, p * (1 - p)
        grad, hess = np.array([r @ x + slope - 1, r.sum() + shift]), np.array([[s @ (x * x) + 1, s @ x], [s @ x, s.sum() + 1]])
        slope, shift = np.array([slope, shift]) - np.clip(np.linalg.solve(hess, grad), -0.1, 0.1)
    net.slope, net.shift = float(slope), float(shift)
    p = net.probabilities(data, spans)
    groups = {f[4] for f in findings if f[3]}
    of = np.array([f[4] for f in findings], object)
    highest = min(np.sort(own)[int((1 - recall) * len(own))] for own in (p[(y == 1) & (of == g)] for g in groups))
    below = p[p < highest].max(initial=0.0)
    net.threshold = float(highest + below) / 2  # the middle of the gap, so that no finding lies on the threshold itself
    return net


#: How some public kinds of keys begin, and how many characters follow.
FORMS = [("ghp_", 36), ("gho_", 36), ("glpat-", 20), ("sk_live_", 24), ("rk_live_", 24), ("AIza", 35), ("xoxb-", 40), ("xoxp-", 40), ("npm_", 36), ("SG", 60), ("hf_", 34), ("dop_v1_", 64), ("ya29", 60)]
#: What stands before keys, and before look-alikes.
SECRET_NAMES = ["aws_secret_access_key", "private_key", "auth", "client_secret", "access_key", "bearer", "credential", "signing_key", "apikey", "pwd"]
OTHER_NAMES = ["id", "uuid", "sha1", "commit", "version", "file", "path", "url", "order", "isbn", "phone", "card", "checksum", "class", "image", "page", "trace"]


def written(n: int = 2400, seed: int = 5) -> list[Finding]:
    """Labelled examples: public forms and random keys in contexts of secrets, look-alikes in others."""
    rng = random.Random(seed)
    pick = lambda letters, k: "".join(rng.choices(letters, k=k))
    alnum, hexa, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    word = lambda: pick("etaoinshrdlu", rng.randint(3, 9))
    prose = lambda: " ".join(word() for _ in range(rng.randint(0, 5)))

    def assigned(names: list[str]) -> str:
        name = rng.choice(names)
        return rng.choice([name, name.upper(), name.replace("_", "-")]) + rng.choice([" = ", "=", ": ", '="', "='", '": "', " "])

    def look_alike() -> str:
        kind = rng.randrange(9)
        if kind == 0:
            return "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
        if kind == 1:
            return pick(string.digits, rng.randint(16, 19))
        if kind == 2:
            return "/".join(word() for _ in range(rng.randint(3, 6))) + pick(string.digits, rng.randint(0, 3))
        if kind == 3:
            return "".join(word().title() for _ in range(rng.randint(3, 5))) + rng.choice(["", "2", "V3"])
        if kind == 4:
            return "_".join(word().upper() for _ in range(3)) + f"_{rng.randrange(100)}"
        if kind == 5:
            return f"20{rng.randrange(10, 30)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}-{word()}-{word()}"
        if kind == 6:
            return word().title() + pick("etaoinshrdlu", 16)
        if kind == 7:
            return f"{word()}-{word()}-{rng.randrange(10)}-{rng.randrange(100)}-{word()}"
        return "=" * rng.randint(4, 30) + f"{rng.randrange(10)}" + "-" * rng.randint(12, 30)

    out: list[Finding] = []
    for i in range(n):
        tail = rng.choice(["", '"', "'", ";", ",", "\n"]) + " " + prose()
        if i % 2:
            start, size = rng.choice(FORMS)
            if rng.random() < 0.5:
                out.append((f"{prose()} {assigned(SECRET_NAMES) if rng.random() < 0.6 else ''}", start + pick(alnum, size), tail, True, "form"))
            else:
                value = pick(rng.choice([alnum, b64]), rng.randint(20, 64)) if rng.random() < 0.7 else pick(string.ascii_uppercase + string.digits, rng.randint(20, 40))
                out.append((f"{prose()} {assigned(SECRET_NAMES)}", value, tail, True, "named"))
        else:
            value = look_alike()
            while len(value) < LEAST_RUN:
                value += pick("etaoin1", 4)
            out.append((f"{prose()} {assigned(OTHER_NAMES) if rng.random() < 0.5 else ''}", value, tail, False, "other"))
    return out


def sampled(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = 4000, longest: int = 512) -> list[Finding]:
    """Findings that the rules label in about ``rows`` documents: their own places, and the other candidates as no secrets.

    Only candidates of at most ``longest`` bytes and their contexts come to the driver, so the sample is bounded in bytes too.
    """
    n = docs.count()
    if not n:
        return []
    picked = two(docs, id_col, text_col).where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1 << 30)) < F.lit(min(1.0, rows / n) * (1 << 30))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            data, starts, ends = flat(batch.column("text"))
            raw, found = data.tobytes(), []
            for t, kind, a, b in candidates(batch.column("text")):
                if b - a <= longest:
                    cut = (raw[max(int(starts[t]), a - BEFORE) : a], raw[a:b], raw[b : min(int(ends[t]), b + AFTER)])
                    found.append((*(x.decode("utf-8", "replace") for x in cut), kind))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(4)], ["before", "value", "after", "kind"])

    got = picked.mapInArrow(work, "before string, value string, after string, kind string").distinct().limit(2 * rows).collect()
    return [(r["before"], r["value"], r["after"], r["kind"] != "model", r["kind"]) for r in sorted(got)]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = 4000, recall: float = 0.98) -> Network:
    """Train on two thirds of the labelled findings, calibrate and set the threshold on the rest."""
    findings = written() + sampled(docs, id_col=id_col, text_col=text_col, rows=rows)
    held = [calibrates(f) for f in findings]
    return calibrate(train([f for f, h in zip(findings, held, strict=True) if not h]), [f for f, h in zip(findings, held, strict=True) if h], recall)


def calibrates(finding: Finding) -> bool:
    """Whether a finding calibrates instead of training; by its text, so equal ones go together."""
    return hashlib.sha256(finding[1].encode()).digest()[0] % 3 == 0


def scan(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model, score`` for every row; score is the highest probability."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in runs(batches):
            texts = batch.column("text")
            data, starts, ends = flat(texts)
            found = list(candidates(texts))
            p = model.probabilities(data, [(int(starts[t]), int(ends[t]), a, b) for t, _, a, b in found]).tolist()
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            of: dict[int, list[tuple[int, int, int, float]]] = {}
            for (t, kind, a, b), q in zip(found, p, strict=True):
                if kind != "model" or q >= model.threshold:
                    base = points[starts[t]]
                    of.setdefault(t, []).append((int(points[a] - base), KINDS.index(kind), int(points[b] - base), q))
            rows = []
            for t in range(batch.num_rows):
                own = sorted(of.get(t, ()))
                named = [(k, f"{KINDS[k]}:{a}:{b}") for a, k, b, _ in own]
                base = ",".join(x for k, x in named if k < 3)
                n = [sum(k == i for k, _ in named) for i in range(4)]
                rows.append((*n[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in named), n[3], max((q for *_, q in own), default=0.0)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model", "score"])

    return two(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, score double")
