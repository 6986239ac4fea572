"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens (runs without white space) are tagged begin, inside or outside. Features: the token's length,
character shape, share of digits and changes between letters and digits; the shapes of both
neighbours; whether a secret's key word stands before it; and, of the file, whether it names key words
or assignments at all. Weights are trained here by maximum likelihood on a bounded sample
(``sample`` texts with pattern matches and as many without), with the patterns' spans as labels; the
patterns' own spans are always kept, the field adds others. Tagging is Viterbi over whole texts, all
texts of a group in step; a text in which every token is outside by a margin that no transition can
make up for is settled without it.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, id_text, map_arrow, text_groups, uncarried, word_spans

# The base patterns and their least lengths, in the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "field")
KEY_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

BEGIN, INSIDE, OUTSIDE = 0, 1, 2
LENGTHS = np.array([4, 8, 12, 16, 24, 40])
N_SHAPES = 32
# feature blocks: bias, length, shape, digit share, changes, shape before, shape after, key word before, file
SIZES = (1, 7, N_SHAPES, 4, 4, N_SHAPES, N_SHAPES, 2, 4)
STARTS = np.cumsum((0,) + SIZES)
N_FEATURES = int(STARTS[-1])

_CLASS = np.full(256, 4, dtype=np.uint8)  # 0 lower, 1 upper, 2 digit, 3 of a secret's alphabet, 4 other
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[ord(c) for c in "+/_-="]] = 3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches in code points, by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in KEY_WORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


# ------------------------------------------------------------------ features


def token_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers by token and block, starts, ends, offsets of each text's tokens) over the texts joined by newlines."""
    buf = b"\n".join(texts)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, ends = word_spans(buf)
    off = np.searchsorted(starts, bounds)
    n = len(starts)
    features = np.zeros((n, len(SIZES)), dtype=np.int32)
    if not n:
        return features, starts, ends, off
    cls = _CLASS[np.frombuffer(buf, np.uint8)]
    length = ends - starts

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, dtype=np.int32)
        np.cumsum(mask, out=sums[1:])
        return sums[ends] - sums[starts]

    have = [count(cls == c) for c in range(5)]
    shape = sum((h > 0).astype(np.int32) << i for i, h in enumerate(have))
    change = np.zeros(len(cls), dtype=bool)
    change[1:] = ((cls[1:] == 2) != (cls[:-1] == 2)) & (cls[1:] < 4) & (cls[:-1] < 4)
    changes = count(change)
    digits = have[2]
    features[:, 1] = np.searchsorted(LENGTHS, length, side="right")
    features[:, 2] = shape
    features[:, 3] = np.where(digits == 0, 0, np.minimum(3, 1 + 3 * digits // np.maximum(length, 1)))
    features[:, 4] = np.searchsorted([1, 3, 6], changes, side="right")
    inner = np.ones(n, dtype=bool)
    inner[off[:-1][off[:-1] < n]] = False  # first token of a text
    features[1:, 5] = np.where(inner[1:], shape[:-1], 0)
    features[:-1, 6] = np.where(inner[1:], shape[1:], 0)
    low = buf.lower()
    if any(w.encode() in low for w in KEY_WORDS):
        named = np.zeros(n, dtype=bool)
        texts_named = np.zeros(len(texts), dtype=bool)
        for m in re.finditer(rb"(?:password|passwd|secret|token|api_?key)[\"']?", low):
            i = int(np.searchsorted(ends, m.start(), side="right"))
            texts_named[int(np.searchsorted(bounds, m.start(), side="right")) - 1] = True
            after = low[m.end():m.end() + 16].lstrip(b" ")
            if after[:1] in (b":", b"="):
                value = m.end() + (len(low[m.end():m.end() + 16]) - len(after)) + 1
                j = int(np.searchsorted(ends, value, side="right"))
                if j < n and starts[j] >= value or j == i:
                    named[j] = True
                elif j + 1 < n:
                    named[j + 1 if ends[j] <= value else j] = True
        features[:, 7] = named
        features[:, 8] += np.repeat(texts_named, np.diff(off)).astype(np.int32)
    assigns = np.array([b"=" in t for t in texts], dtype=np.int32)
    features[:, 8] += 2 * np.repeat(assigns, np.diff(off))
    return features + STARTS[:-1].astype(np.int32), starts, ends, off


# ------------------------------------------------------------------ the field


@dataclass
class Field:
    weights: np.ndarray       # by feature and state
    transitions: np.ndarray   # from state to state; outside to inside never happens
    first: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3), dtype=np.float32)
        w = self.weights.astype(np.float32)
        for block in range(features.shape[1]):
            out += w[features[:, block]]
        return out


NEVER = -1e4


def _in_step(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length: (order, their first tokens, their lengths)."""
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    return order, off[:-1][order], n[order]


def viterbi(scores: np.ndarray, off: np.ndarray, field: Field) -> np.ndarray:
    """Best state of every token; the sequences advance together, longest first."""
    states = np.full(len(scores), OUTSIDE, dtype=np.int8)
    order, at, n = _in_step(off)
    if not len(order):
        return states
    back = np.zeros((len(scores), 3), dtype=np.int8)
    best = scores[at] + field.first
    final = np.zeros((len(order), 3))
    live = len(order)
    for t in range(1, int(n[0]) + 1):
        still = int(np.searchsorted(-n[:live], -t, side="left"))  # those longer than t
        final[still:live] = best[still:live]
        live = still
        if not live:
            break
        step = best[:live, :, None] + field.transitions
        choice = step.argmax(axis=1)
        back[at[:live] + t] = choice
        best = np.take_along_axis(step, choice[:, None, :], axis=1)[:, 0, :] + scores[at[:live] + t]
    state = final.argmax(axis=1)
    for t in range(int(n[0]) - 1, -1, -1):
        live = int(np.searchsorted(-n, -t, side="left"))
        place = at[:live] + t
        states[place] = state[:live]
        state[:live] = back[place, state[:live]]
    return states


def tag(features: np.ndarray, off: np.ndarray, field: Field) -> np.ndarray:
    """States of all tokens. Texts whose tokens are all clearly outside need no search."""
    scores = field.scores(features)
    stay = field.transitions[OUTSIDE, OUTSIDE]
    # leaving and coming back takes two other transitions (or the start and one)
    gain = 2 * max(0.0, float(np.maximum(field.transitions.max(), field.first.max()) - min(stay, field.first[OUTSIDE])))
    unclear = scores[:, OUTSIDE] - scores[:, :2].max(axis=1) <= gain
    n = np.diff(off)
    doc = np.repeat(np.arange(len(n)), n)
    open_docs = np.zeros(len(n), dtype=bool)
    open_docs[doc[unclear]] = True
    keep = open_docs[doc]
    states = np.full(len(scores), OUTSIDE, dtype=np.int8)
    states[keep] = viterbi(scores[keep], np.concatenate([[0], np.cumsum(n[open_docs])]), field)
    return states


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _gradient(field: Field, features: np.ndarray, labels: np.ndarray, off: np.ndarray):
    """Gradient of the log-likelihood by forward and backward passes, all sequences in step."""
    scores = field.scores(features).astype(np.float64)
    order, at, n = _in_step(off)
    alpha, beta = np.zeros((len(scores), 3)), np.zeros((len(scores), 3))
    alpha[at] = scores[at] + field.first
    for t in range(1, int(n[0])):
        live = int(np.searchsorted(-n, -t, side="left"))
        p = at[:live] + t
        alpha[p] = _log_sum(alpha[p - 1][:, :, None] + field.transitions, 1) + scores[p]
    seen = np.zeros((3, 3))
    total = np.zeros(len(scores))
    z = _log_sum(alpha[at + n - 1], 1)
    for k in range(len(order)):
        total[at[k]:at[k] + n[k]] = z[k]
    for t in range(int(n[0]) - 1, 0, -1):
        live = int(np.searchsorted(-n, -t, side="left"))
        p = at[:live] + t
        ahead = field.transitions + (scores[p] + beta[p])[:, None, :]
        beta[p - 1] = _log_sum(ahead, 2)
        seen += np.exp(alpha[p - 1][:, :, None] + ahead - total[p][:, None, None]).sum(axis=0)
    marginal = np.exp(alpha + beta - total[:, None])
    truth = np.eye(3)[labels]
    weights = np.zeros_like(field.weights)
    for block in range(features.shape[1]):
        for s in range(3):
            weights[:, s] += np.bincount(features[:, block], weights=truth[:, s] - marginal[:, s], minlength=N_FEATURES)
    inner = np.ones(len(labels), dtype=bool)
    inner[at] = False
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (labels[:-1][inner[1:]], labels[1:][inner[1:]]), 1)
    return weights, pairs - seen, (truth[at] - marginal[at]).sum(axis=0)


def labelled(texts: list[tuple[str, list]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, states, offsets) of texts with their spans: tokens that hold a secret's value are begin, then inside."""
    raw = [t.encode() for t, _ in texts]
    features, starts, ends, off = token_features(raw)
    labels = np.full(len(starts), OUTSIDE)
    base = 0
    for i, (t, spans) in enumerate(texts):
        for a, b, kind in spans:
            if kind == 0:
                a = ASSIGN.match(t, a).start(2)
            lo, hi = base + len(t[:a].encode()), base + len(t[:b].encode())
            j, k = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(starts, hi, side="left"))
            labels[j:k] = INSIDE
            labels[j] = BEGIN
        base += len(raw[i]) + 1
    return features, labels, off


def fit(texts: list[tuple[str, list]], rounds: int = 50, rate: float = 1.0, decay: float = 0.05) -> Field:
    """Maximum likelihood over (text, spans) with a quadratic penalty, by adaptive gradient steps."""
    field = Field(np.zeros((N_FEATURES, 3)), np.zeros((3, 3)), np.zeros(3))
    field.transitions[OUTSIDE, INSIDE] = NEVER
    field.first[INSIDE] = NEVER
    features, labels, off = labelled(texts)
    if not len(labels):
        field.weights[0, OUTSIDE] = 10.0
        return field
    squares = [np.full_like(x, 1e-6) for x in (field.weights, field.transitions, field.first)]
    for _ in range(rounds):
        g = _gradient(field, features, labels, off)
        for x, d, s in zip((field.weights, field.transitions, field.first), g, squares):
            d = d - decay * np.where(x > NEVER / 2, x, 0)
            s += d * d
            x += np.where(x > NEVER / 2, rate * d / np.sqrt(s), 0)
    return field


def train(docs: DataFrame, sample: int = 200, longest: int = 3000) -> Field:
    """The field of a table. The bounded sample: ``sample`` texts of at most ``longest`` bytes that name a key word
    or hold a long hexadecimal run, and as many others, each the first by a hash of the text. The first half of
    the hits comes once more with the key words cut out, so that shape alone can mark a secret."""
    texts = id_text(docs).select("text").where(F.octet_length("text").between(1, longest))
    hit = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    chosen = [texts.where(f).orderBy(F.xxhash64("text"), "text").limit(sample).collect() for f in (hit, ~hit)]
    hits, others = ([r.text for r in rows] for rows in chosen)
    marked = [(t, base_spans(t)) for t in hits + others]
    bare = []
    for t in hits[: len(hits) // 2]:
        kept, at, spans = [], 0, []
        for a, b, kind in base_spans(t):
            if kind == 0 and a >= at:
                kept.append(t[at:a])
                lo = sum(map(len, kept))
                at = b
                kept.append(ASSIGN.match(t, a).group(2))
                spans.append((lo, lo + len(kept[-1]), 2))
        bare.append(("".join([*kept, t[at:]]), spans))
    return fit(marked + bare)


def field_spans(states: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of begin-inside runs."""
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(states != OUTSIDE):
        if states[i] == INSIDE and out and i and states[i - 1] != OUTSIDE:
            out[-1] = (out[-1][0], int(ends[i]))
        else:
            out.append((int(starts[i]), int(ends[i])))
    return out


_EDGE = b"\"'`,;()[]{}<>"


def all_spans(texts: list[bytes], field: Field) -> list[tuple[list, list]]:
    """For each text its base spans and all spans; a span that overlaps a base span adds nothing."""
    features, starts, ends, off = token_features(texts)
    states = tag(features, off, field)
    out, base = [], 0
    for i, raw in enumerate(texts):
        text = raw.decode()
        own = base_spans(text)
        more = []
        s = states[off[i]:off[i + 1]]
        if (s != OUTSIDE).any():
            for a, b in field_spans(s, starts[off[i]:off[i + 1]] - base, ends[off[i]:off[i + 1]] - base):
                piece = raw[a:b]
                a, b = a + len(piece) - len(piece.lstrip(_EDGE)), b - (len(piece) - len(piece.rstrip(_EDGE)))
                if b - a < 8:
                    continue
                x, y = len(raw[:a].decode()), len(raw[:b].decode())
                if all(y <= p or q <= x for p, q, _ in own):
                    more.append((x, y, 3))
        out.append((own, sorted(own + more, key=lambda v: (v[0], v[2]))))
        base += len(raw) + 1
    return out


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_field.

    Null text has no spans, null doc_id passes through, repeated rows each give a row, an empty table an
    empty result (and a field that tags nothing); further columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or train(docs))

    def run(batches):
        for batch in batches:
            for first, end, texts in text_groups(batch):
                found = all_spans(texts, shared.value)
                kinds = [[sum(k == kind for _, _, k in every) for _, every in found] for kind in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[first:end], *(pa.array(kinds[k], pa.int64()) for k in range(3)),
                     pa.array([hashlib.sha256(listed(own).encode()).hexdigest() for own, _ in found], pa.string()),
                     pa.array([listed(every) for _, every in found], pa.string()), pa.array(kinds[3], pa.int64())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_field"])

    return map_arrow(id_text(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_field long")


def redact(docs: DataFrame, field: Field | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The rows and columns of ``docs`` with every span replaced by ``mark``, n_chars following (null text stays null)."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train(docs))
    rows = carried(docs)

    def run(batches):
        for batch in batches:
            missing = batch.column("text").is_null().to_pylist()
            out = []
            for _, _, texts in text_groups(batch):
                for raw, (_, spans) in zip(texts, all_spans(texts, shared.value)):
                    text, at, parts = raw.decode(), 0, []
                    for a, b, _ in spans:
                        if a >= at:
                            parts += [text[at:a], mark]
                        at = max(at, b)
                    out.append("".join([*parts, text[at:]]))
            out = [None if gone else t for gone, t in zip(missing, out)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), batch.column("rest")], ["doc_id", "text", "rest"])

    return uncarried(map_arrow(rows, run, rows.schema), docs)
