"""Secret scans: fixed patterns, and a character convolutional network over every candidate and its surroundings.

Candidates are the matches of the fixed patterns and all other long tokens that look random. The network sees the characters
of a candidate and of the text on both sides. It is trained here, in numpy, on labelled findings that a rule generates from a
seed: secrets of many makes in the contexts where they turn up, and what is easily taken for one. Its limit is set on findings
held back from training: calibrated probabilities, and the highest limit that still finds the required share of secrets of
every make.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import over_texts, text_or_empty

#: Kinds of spans in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=.@:%-]{12,}")

CONTEXT, WIDTH = 24, 64  # characters on each side, and of a candidate at a time; longer ones are read in windows
FINDINGS, CALIBRATION, SEED = 6000, 3000, 17
EPOCHS, BATCH, RATE = 6, 64, 3e-3
RECALL = 0.97
MOST = 0.9  # the limit is no higher than this, even if all secrets held back would pass a higher one
EMBED, FILTERS, KERNEL, HIDDEN = 10, 24, 5, 16
ALPHABET = {c: i + 2 for i, c in enumerate(string.ascii_letters + string.digits + string.punctuation + " \n")}  # 0: nothing, 1: other
CHUNK = 256  # windows that the network reads at a time
VIEWS = 2048  # windows that wait for it

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, in code points. Runs are maximal, so asking for the length in the pattern is the same as
    dropping short matches, except for assignments, whose short matches take part of the text with them."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Long tokens with a digit, or with both cases inside; of a token that fixed patterns touch, each stretch that they leave."""
    covered: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in taken):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    out, k = [], 0
    for m in TOKEN.finditer(text):
        token, (start, end) = m[0], m.span()
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        if any(c in token for c in string.digits) or (len(token) >= 20 and token[1:].lower() != token[1:] and token.upper() != token):
            at, i = start, k
            while i < len(covered) and covered[i][0] < end:
                out.append((at, covered[i][0]))
                at, i = covered[i][1], i + 1
            out.append((at, end))
    return [(a, b) for a, b in out if any(c.isalnum() for c in text[a:b])]


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Codes of a candidate and its context; the second row marks the candidate. A long candidate gives several windows."""
    out = []
    for a in range(start, end, WIDTH):
        b = min(end, a + WIDTH)
        left, right = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
        code, inside = np.zeros(WIDTH + 2 * CONTEXT, np.uint8), np.zeros(WIDTH + 2 * CONTEXT, np.uint8)
        shown = left + text[a:b] + right
        at = CONTEXT - len(left)
        code[at : at + len(shown)] = [ALPHABET.get(c, 1) for c in shown]
        inside[CONTEXT : CONTEXT + b - a] = 1
        out.append(np.stack([code, inside]))
    return out


@dataclass
class Net:
    """Embedding, one convolution, the largest response inside and outside the candidate, a hidden layer, a logit."""

    embed: np.ndarray
    kernel: np.ndarray
    shift: np.ndarray
    hidden: np.ndarray
    hidden_shift: np.ndarray
    out: np.ndarray
    out_shift: np.ndarray
    scale: float = 1.0  # calibration of the logit
    offset: float = 0.0
    limit: float = 0.5

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Net:
        fan = KERNEL * (EMBED + 1)
        return cls(
            rng.normal(0, 0.5, (len(ALPHABET) + 2, EMBED)), rng.normal(0, (2 / fan) ** 0.5, (fan, FILTERS)), np.zeros(FILTERS),
            rng.normal(0, (1 / FILTERS) ** 0.5, (2 * FILTERS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.shift, self.hidden, self.hidden_shift, self.out, self.out_shift]

    def forward(self, x: np.ndarray) -> dict:
        code, inside = x[:, 0].astype(np.int64), x[:, 1].astype(float)
        rows = np.concatenate([self.embed[code] * (code > 0)[:, :, None], inside[:, :, None]], axis=2)
        n, width, depth = rows.shape
        padded = np.pad(rows, ((0, 0), (KERNEL // 2, KERNEL // 2), (0, 0)))
        patches = np.concatenate([padded[:, k : k + width] for k in range(KERNEL)], axis=2)
        conv = np.maximum(patches.reshape(-1, KERNEL * depth) @ self.kernel + self.shift, 0).reshape(n, width, FILTERS)
        pools = [np.where((inside == side)[:, :, None], conv, 0) for side in (1, 0)]
        tops = [p.argmax(1) for p in pools]
        pooled = np.concatenate([np.take_along_axis(p, t[:, None], 1)[:, 0] for p, t in zip(pools, tops, strict=True)], axis=1)
        mid = np.maximum(pooled @ self.hidden + self.hidden_shift, 0)
        return {"code": code, "patches": patches, "tops": tops, "pooled": pooled, "mid": mid, "logit": mid @ self.out + self.out_shift[0], "depth": depth}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss, in the order of weights()."""
        f = self.forward(x)
        n, width = f["code"].shape
        d_logit = (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y) / n
        d_mid = d_logit[:, None] * self.out * (f["mid"] > 0)
        d_pooled = d_mid @ self.hidden.T * (f["pooled"] > 0)
        d_kernel, d_shift = np.zeros_like(self.kernel), np.zeros_like(self.shift)
        d_rows = np.zeros((n, width + KERNEL - 1, f["depth"]))
        every = np.arange(n)
        for side, top in enumerate(f["tops"]):
            d = d_pooled[:, side * FILTERS : (side + 1) * FILTERS]
            for j in range(FILTERS):
                patch = f["patches"][every, top[:, j]]
                d_kernel[:, j] += patch.T @ d[:, j]
                spread = (d[:, j : j + 1] * self.kernel[:, j]).reshape(n, KERNEL, -1)
                for k in range(KERNEL):
                    np.add.at(d_rows, (every, top[:, j] + k), spread[:, k])
            d_shift += d.sum(0)
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, f["code"], d_rows[:, KERNEL // 2 : KERNEL // 2 + width, :EMBED] * (f["code"] > 0)[:, :, None])
        return [d_embed, d_kernel, d_shift, f["pooled"].T @ d_mid, d_mid.sum(0), f["mid"].T @ d_logit, np.array([d_logit.sum()])]

    def probability(self, x: np.ndarray) -> np.ndarray:
        logits = np.concatenate([self.forward(x[i : i + CHUNK])["logit"] for i in range(0, len(x), CHUNK)]) if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.offset, -30, 30)))


def findings(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labelled findings by rule: windows, whether they show a secret, half and half, and the number of the make."""
    rng = np.random.default_rng(seed)
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits

    def pick(chars: str, low: int, high: int | None = None) -> str:
        return "".join(np.array(list(chars))[rng.integers(len(chars), size=rng.integers(low, (high or low) + 1))])

    def word() -> str:
        return pick(lower, 2, 9)

    def prose() -> str:
        """A word beside a finding, in any language; some end a sentence."""
        return pick(lower + "aeiouéèàçñöü", 2, 9) + pick("      .,", 1).strip()

    def number(low: int, high: int) -> str:
        return str(rng.integers(low, high))

    mixed = lower + upper + digits
    secrets = [
        lambda: "ghp_" + pick(mixed, 36), lambda: "xox" + pick("abp", 1) + "-" + pick(digits, 11) + "-" + pick(mixed, 24), lambda: "sk_live_" + pick(mixed, 24),
        lambda: "eyJ" + pick(mixed, 30) + "." + pick(mixed + "_-", 40) + "." + pick(mixed + "_-", 43), lambda: "AIza" + pick(mixed + "_-", 35), lambda: pick(mixed + "+/", 40),
        lambda: pick(mixed + "+/", 22, 86) + "==", lambda: "AKIA" + pick(upper + digits, 16), lambda: pick("0123456789abcdef", 24, 64), lambda: pick("0123456789abcdef", 40), lambda: pick(mixed, 24, 44),
        lambda: "postgres://" + word() + ":" + pick(mixed, 12, 20) + "@db." + word() + ".example:5432", lambda: "SG." + pick(mixed, 22) + "." + pick(mixed, 43), lambda: "npm_" + pick(mixed, 36),
    ]
    others = [
        lambda: word() + "." + number(1, 99) + "@mail" + number(0, 9) + ".example.com", lambda: pick("45", 1) + pick(digits, 15), lambda: ".".join(number(1, 255) for _ in range(4)),
        lambda: "https://www." + word() + ".example/" + word() + "/" + number(1, 9999), lambda: word() + word() + word() + number(0, 999), lambda: number(1990, 2030) + "-0" + number(1, 9) + "-1" + number(0, 9) + "T1" + number(0, 9) + ":00:00",
        lambda: "-".join(word() for _ in range(4)) + "-" + number(1, 99), lambda: "v" + number(0, 9) + "." + number(0, 99) + "." + number(0, 9999) + "-" + word(), lambda: word() + "_" + word() + "_" + word() + number(0, 9),
        lambda: "+" + number(1, 99) + "-" + pick(digits, 3) + "-" + pick(digits, 3) + "-" + pick(digits, 4), lambda: "978-" + pick(digits, 1) + "-" + pick(digits, 5) + "-" + pick(digits, 3), lambda: "".join(word().title() for _ in range(4)),
        lambda: word() + "=" + word() + ":" + number(1, 9999), lambda: "=" * int(rng.integers(12, 40)) + number(0, 9), lambda: "/usr/" + word() + "/" + word() + "/" + word() + number(0, 9) + ".py",
    ]
    hints = ["key: ", "Authorization: Bearer ", "export TOKEN_VALUE ", "client_secret ", "credentials ", "pass ", "DATABASE_URL ", "token   ", ""]
    plain = ["see ", "from ", "number ", "at ", "version ", "file ", "call ", "", "", ""]
    x, y, kinds = [], [], []
    while len(x) < n:
        label = len(x) % 2
        make = secrets if label else others
        kinds.append(int(rng.integers(len(make))))
        token = make[kinds[-1]]()
        lead = (hints if rng.random() < (0.5 if label else 0.05) else plain)
        left = " ".join(prose() for _ in range(rng.integers(0, 6))) + " " + lead[rng.integers(len(lead))]
        right = " " + " ".join(prose() for _ in range(rng.integers(0, 6)))
        quote = ["", '"', "'"][rng.integers(3)]
        text = left + quote + token + quote + right
        x.append(windows(text, len(left) + len(quote), len(left) + len(quote) + min(len(token), WIDTH))[0])
        y.append(label)
    return np.array(x), np.array(y, float), np.array(kinds)


@cache
def trained(recall: float = RECALL, seed: int = SEED) -> Net:
    """The network, trained once a process: Adam on FINDINGS, calibrated on CALIBRATION others, with the highest limit, MOST at most,
    by which this share of every make of secret among them is found."""
    rng = np.random.default_rng(seed)
    net = Net.fresh(rng)
    x, y, _ = findings(FINDINGS, seed)
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            own, step = order[i : i + BATCH], step + 1
            for w, g, m, v in zip(net.weights(), net.gradients(x[own], y[own]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    x, y, kinds = findings(CALIBRATION, seed + 1)
    logits = np.concatenate([net.forward(x[i : i + CHUNK])["logit"] for i in range(0, len(x), CHUNK)])
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt's sigmoid, with a pull towards a = 1 as separable classes would let it grow without bound
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        a -= 0.05 * (float(((p - y) * logits).mean()) + 0.1 * (a - 1))
        b -= 0.05 * float((p - y).mean())
    net.scale, net.offset, net.limit = a, b, MOST
    p = net.probability(x)
    for kind in np.unique(kinds[y == 1]):
        found = np.sort(p[(y == 1) & (kinds == kind)])
        net.limit = min(net.limit, float(found[int((1 - recall) * len(found))]))
    return net


Found = tuple[str, int, int, float]


def scan_texts(texts: Iterable[str], net: Net) -> Iterator[list[Found]]:
    """All spans of each text with the network's probability; those of the fixed patterns stay whatever it says.

    Candidates of several texts go through the network together, VIEWS windows or a little more at a time.
    """
    waiting: list[tuple[list[Span], list[tuple[int, int]], list[int]]] = []
    views: list[np.ndarray] = []

    def judged() -> Iterator[list[Found]]:
        p, at = net.probability(np.array(views)), 0
        for base, more, sizes in waiting:
            best = []
            for n in sizes:
                best.append(float(p[at : at + n].max()))
                at += n
            spans = [(*s, q) for s, q in zip(base, best, strict=False)]
            spans += [("model", a, b, q) for (a, b), q in zip(more, best[len(base) :], strict=True) if q >= net.limit]
            yield sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
        waiting.clear()
        views.clear()

    for text in texts:
        base = ordered(base_spans(text))
        more = candidates(text, base)
        own = [windows(text, a, b) for a, b in [*((a, b) for _, a, b in base), *more]]
        waiting.append((base, more, [len(v) for v in own]))
        views += [v for one in own for v in one]
        if len(views) >= VIEWS:
            yield from judged()
    yield from judged()


SPANS = "array<struct<kind:string,start:int,end:int,p:double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """One row for each row of docs: doc_id, spans. A null or empty text has none; candidates of any length are read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(recall))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[dict(zip(("kind", "start", "end", "p"), s, strict=True)) for s in spans] for spans in scan_texts(batch.column(1).to_pylist(), shared.value)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return over_texts(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), rows, f"doc_id long, spans {SPANS}")


def redact_text(text: str, spans: list[tuple], mark: str) -> str:
    out, at = [], 0
    for _, start, end, *_ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", recall: float = RECALL) -> DataFrame:
    """docs, all rows and columns, with every span of every text replaced by mark; overlapping spans by one. Null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(recall))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        plain = texts.where(texts.notna(), "").tolist()
        clean = [redact_text(t, spans, mark) for t, spans in zip(plain, scan_texts(plain, shared.value), strict=True)]
        return pd.Series(clean, texts.index, object).where(texts.notna(), None)

    return docs.withColumn(text_col, cleaned(F.col(f"`{text_col}`").cast("string")))
