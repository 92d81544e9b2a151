"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction has H units: z = hard_sigmoid(Wz[x] + Uz h), n = hard_tanh(Wn[x] + Un h), h += z * (n - h). Both states at a position
give a distribution over languages there; a document's is the mean over all its positions. The network is trained in numpy by
backpropagation through time on a bounded sample of labelled documents and applied to whole texts: states run from end to end of a
text, whatever its length (see predict).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNITS, CHUNK, LANES = 8, 512, 8192
PAD = 256
#: Bytes from which a lane's first state is guessed, and how far off a guess may be.
WARM, EXACT = 256, 1e-3
#: The classifier is fitted on at most about so many documents, shared equally by the languages, PIECES pieces of each.
TRAIN_DOCS, PIECES = 3000, 6
TRAIN_LENGTH, TRAIN_LANES, STEPS, SPEED = 64, 512, 360, 0.02
UNKNOWN = "und"


@dataclass
class Network:
    langs: list[str]
    table: np.ndarray  # (2, 2H, 257): what each byte adds to z and n, by direction
    turn: np.ndarray  # (2, 2H, H)
    out: np.ndarray  # (2, L, H)
    bias: np.ndarray  # (L, 1)

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.turn, self.out, self.bias]


def _fresh(langs: list[str], rng: np.random.Generator) -> Network:
    h = UNITS
    table = rng.normal(0, 0.3, (2, 2 * h, 257)).astype("f4")
    table[:, :, PAD] = 0
    return Network(langs, table, rng.normal(0, 0.3, (2, 2 * h, h)).astype("f4"), rng.normal(0, 0.1, (2, len(langs), h)).astype("f4"), np.zeros((len(langs), 1), "f4"))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-2, keepdims=True))
    return x / x.sum(-2, keepdims=True)


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over positions and its gradients. x: (T, B) bytes without padding; y: (B,) language of each lane."""
    t_max, b = x.shape
    h_units = UNITS
    both = np.stack([x, x[::-1]])  # (2, T, B): each direction in its own time
    states = np.zeros((2, t_max + 1, h_units, b), "f4")
    gates = np.empty((2, t_max, 2 * h_units, b), "f4")
    for t in range(t_max):
        g = np.matmul(net.turn, states[:, t])
        for d in (0, 1):
            g[d] += net.table[d].take(both[d, t], axis=1)
        gates[:, t] = g
        z, n = np.clip(0.5 + g[:, :h_units], 0, 1), np.clip(g[:, h_units:], -1, 1)
        states[:, t + 1] = states[:, t] + z * (n - states[:, t])
    own = np.stack([states[0, 1:], states[1, 1:][::-1]])  # by position
    p = _softmax(np.einsum("dlh,dthb->tlb", net.out, own, optimize=True) + net.bias)
    hot = np.zeros((len(net.langs), b), "f4")
    hot[y, np.arange(b)] = 1
    loss = -float(np.log(np.maximum((p * hot).sum(1), 1e-9)).mean())
    dp = (p - hot) / (t_max * b)
    d_out = np.einsum("tlb,dthb->dlh", dp, own, optimize=True)
    d_own = np.einsum("dlh,tlb->dthb", net.out, dp, optimize=True)
    d_own = np.stack([d_own[0], d_own[1][::-1]])
    d_turn, dh = np.zeros_like(net.turn), np.zeros((2, h_units, b), "f4")
    dg_all = np.empty_like(gates)
    for t in reversed(range(t_max)):
        dh = dh + d_own[:, t]
        g, h = gates[:, t], states[:, t]
        gz, gn = 0.5 + g[:, :h_units], g[:, h_units:]
        z, n = np.clip(gz, 0, 1), np.clip(gn, -1, 1)
        dg = np.concatenate([dh * (n - h) * ((gz > 0) & (gz < 1)), dh * z * ((gn > -1) & (gn < 1))], 1)
        dg_all[:, t] = dg
        d_turn += np.matmul(dg, h.transpose(0, 2, 1))
        dh = dh * (1 - z) + np.matmul(net.turn.transpose(0, 2, 1), dg)
    d_table = np.zeros_like(net.table)
    for d in (0, 1):
        flat = both[d].ravel()
        for k in range(2 * h_units):
            d_table[d, k] = np.bincount(flat, dg_all[d, :, k].ravel(), 257)
    return loss, [d_table, d_turn, d_out, dp.sum((0, 2))[:, None]]


def train(pieces: list[tuple[bytes, str]], seed: int = 7) -> Network:
    """A network fitted to pieces of text, each of TRAIN_LENGTH bytes or more. Adam with a falling rate."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in pieces})
    net = _fresh(langs, rng)
    by_lang = [[np.frombuffer(p, np.uint8) for p, x in pieces if x == lang] for lang in langs]
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    for step in range(1, STEPS + 1):
        y = rng.integers(0, len(langs), TRAIN_LANES)
        lanes = []
        for k in y.tolist():
            p = by_lang[k][rng.integers(len(by_lang[k]))]
            at = rng.integers(len(p) - TRAIN_LENGTH + 1)
            lanes.append(p[at : at + TRAIN_LENGTH])
        _, grads = gradients(net, np.array(lanes).T.astype(np.int64), y)
        rate = SPEED * (1 - step / (STEPS + 1))
        for w, g, m, v in zip(net.weights(), grads, first, second):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def predict(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean distribution over the positions of each text: (texts, languages). Empty texts get zeros.

    The recurrence runs over the whole text, but CHUNK bytes of a text are a lane, and all lanes run side by side: a lane starts from
    a guess of the state that its neighbour hands over (what the WARM bytes at that end give), and lanes whose guess proves to be off by
    more than EXACT run again from the state handed over, until none is. At worst, that is one lane after the other; gates forget, so
    it is few. Then all lanes are labelled once, from their right states."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    lanes = -(-sizes // CHUNK)
    owner = np.repeat(np.arange(len(texts)), lanes)
    total = np.zeros((len(texts), len(net.langs)))
    if not len(owner):
        return total
    flat = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.repeat(np.cumsum(sizes) - sizes, lanes) + (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * CHUNK
    end = np.minimum(begin + CHUNK, np.repeat(np.cumsum(sizes), lanes))
    next_ = np.append(owner[1:] == owner[:-1], False)  # lanes that another lane of the text follows

    def settled(d: int) -> np.ndarray:
        """The state that direction d has where each lane begins."""
        gives, to = (next_, 1) if d == 0 else (np.append(False, next_[:-1]), -1)
        states = np.zeros((UNITS, len(owner)), "f4")
        todo = np.flatnonzero(gives)
        for k in range(0, len(todo), LANES):
            at = todo[k : k + LANES]
            ends = (end[at] - WARM, end[at]) if d == 0 else (begin[at], np.minimum(begin[at] + WARM, end[at]))
            states[:, at + to] = _run(net, d, _bytes(flat, *ends), np.zeros((UNITS, len(at)), "f4"))
        while len(todo):
            wrong = []
            for k in range(0, len(todo), LANES):
                at = todo[k : k + LANES]
                handed = _run(net, d, _bytes(flat, begin[at], end[at]), states[:, at])
                off = np.abs(states[:, at + to] - handed).max(0) > EXACT
                wrong.append((at[off] + to, handed[:, off]))
            for at, handed in wrong:
                states[:, at] = handed
            todo = np.concatenate([at for at, _ in wrong])
            todo = np.sort(todo[gives[todo]])
        return states

    before, after = settled(0), settled(1)
    for k in range(0, len(owner), LANES):
        at = slice(k, k + LANES)
        sums = _lanes(net, _bytes(flat, begin[at], end[at]), before[:, at], after[:, at])
        for j in range(len(net.langs)):
            total[:, j] += np.bincount(owner[at], sums[j], len(texts))
    return total / np.maximum(sizes, 1)[:, None]


def _bytes(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(steps, lanes): bytes begin .. end of each lane, PAD behind them."""
    steps = int((end - begin).max())
    at = begin[None, :] + np.arange(steps)[:, None]
    return np.where(at < end[None, :], flat[np.minimum(at, len(flat) - 1)].astype(np.int32), PAD)


class _Step:
    """One step of a direction, in place, for many lanes."""

    def __init__(self, net: Network, lanes: int):
        table = net.table.copy()
        table[:, :UNITS] += 0.5
        table[:, :UNITS, PAD] = -1e9  # padding leaves the state as it is
        self.net, self.rows = net, np.ascontiguousarray(table.transpose(0, 2, 1))  # a byte's numbers side by side
        self.g, self.xi = np.empty((2 * UNITS, lanes), "f4"), np.empty((lanes, 2 * UNITS), "f4")

    def __call__(self, d: int, x: np.ndarray, s: np.ndarray) -> None:
        g, z, n = self.g, self.g[:UNITS], self.g[UNITS:]
        np.take(self.rows[d], x, axis=0, out=self.xi, mode="clip")
        np.matmul(self.net.turn[d], s, out=g)
        np.add(g, self.xi.T, out=g)
        np.clip(z, 0, 1, out=z)
        np.clip(n, -1, 1, out=n)
        np.subtract(n, s, out=n)
        np.multiply(n, z, out=n)
        np.add(s, n, out=s)


def _run(net: Network, d: int, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The state of direction d after the bytes x."""
    step, s = _Step(net, x.shape[1]), state.copy()
    for row in x if d == 0 else x[::-1]:
        step(d, row, s)
    return s


def _lanes(net: Network, x: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Sum of the distributions over the positions of each lane: (languages, lanes)."""
    steps, b = x.shape
    step = _Step(net, b)
    forward, s = np.empty((steps, UNITS, b), "f4"), before.copy()
    for t in range(steps):
        step(0, x[t], s)
        forward[t] = s
    s = after.copy()
    sums = np.zeros((len(net.langs), b), "f4")
    for t in reversed(range(steps)):
        step(1, x[t], s)
        p = net.out[0] @ forward[t]
        p += net.out[1] @ s
        p += net.bias
        np.minimum(p, 80, out=p)  # states are within -1 and 1, so only large weights come near that
        np.exp(p, out=p)
        p *= (x[t] != PAD) / p.sum(0)
        sums += p
    return sums


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network learned from text and lang of docs: at most about TRAIN_DOCS distinct documents, as many of each language, chosen by a
    hash of id and text; PIECES pieces of each, at places given by hashes. None if there is nothing to learn from.

    Null ids, texts and languages and texts without a letter are not learned from; rows equal in id, text and lang count once. A
    language is a class: there should be far fewer of them than TRAIN_DOCS. Other columns are ignored, whatever their names.
    """
    d = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = d.filter("id is not null and text is not null and lang is not null")
    place = F.xxhash64("id", "text", F.lit("train"))
    counts = {r[0]: r[1] for r in d.groupBy("lang").agg(F.approx_count_distinct(place, 0.02)).collect()}  # one row a class
    if not counts:
        return None
    share = TRAIN_DOCS / len(counts)
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, min(1.0, share / max(n, 1))).otherwise(chance)
    u = F.shiftrightunsigned(place, 11) / float(1 << 53)
    size = 2 * TRAIN_LENGTH
    places = [F.substring("text", (F.pmod(F.xxhash64("id", F.lit(k)), F.greatest(F.char_length("text") - size, F.lit(1))) + 1).cast("int"), F.lit(size)) for k in range(PIECES)]
    some = d.filter(F.col("text").rlike(r"\p{L}") & (u < chance)).groupBy("lang", place.alias("place")).agg(F.first(F.array(*places)).alias("parts"))
    pieces = []
    for lang, _, parts in sorted(some.orderBy("place").limit(2 * TRAIN_DOCS).collect(), key=lambda r: (r[1], r[0])):
        for p in parts:
            raw = p.encode("utf-8")
            pieces.append((raw * -(-TRAIN_LENGTH // len(raw)) if len(raw) < TRAIN_LENGTH else raw, lang))
    return train(pieces) if pieces else None


def identify(docs: DataFrame, net: Network | None, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the mean probability of that language over the positions of the text) added.

    Null texts and texts without a letter, and all texts if net is None, get `und` and 0. Whole texts are read, of any length, and the
    states run through them. An empty table stays empty. Columns of docs named like an added one are replaced, others may have any
    names; rows stand for themselves.
    """
    (plain,) = common.fresh(docs.columns, "plain")
    d = docs.withColumn(plain, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    schema = common.added(docs.schema, ("lang_pred", T.StringType()), ("score", T.DoubleType()))
    kept = [f.name for f in schema][:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, text_col):
                at = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                texts = [t.encode("utf-8") if ok and net else b"" for t, ok in zip(at[text_col].to_pylist(), at[plain].to_pylist())]
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if net:
                    p = predict(net, texts)
                    best = p.argmax(1)
                    lang = [net.langs[k] if t else UNKNOWN for k, t in zip(best.tolist(), texts)]
                    score = np.clip(p[np.arange(len(texts)), best], 0, 1)
                yield pa.RecordBatch.from_arrays([*[at[n] for n in kept], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[f.name for f in schema])

    return common.mapped(d, run, schema)
