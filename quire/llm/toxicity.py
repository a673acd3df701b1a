"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is read as units: its runs of letters and digits (a word of symbols alone is one), and of a run longer than
``LONG`` bytes the ``LONG`` bytes from each of its characters on, so that texts without spaces are read by every
character.  Overlapping windows of ``WINDOW`` units, ``STRIDE`` apart, cover the text.  Each unit enters as a sum of
embeddings: of itself (lower-cased), of its beginnings of several lengths and its end, and of all its overlapping
``GRAM``-byte grams (a unit of a long run: of the first, since its neighbours have the others).  A unit, piece or gram has an
embedding if the training sample holds it often enough, and adds nothing otherwise.  Two gated recurrent layers read
the window in either direction, attention pools their states, and a logistic unit scores the window.  The
document's score is calibrated from its highest window.

Documents are labelled, windows are not: training takes, from each document, the windows that hold the most
telling words by the smoothed log-odds of the training sample, and again, after half of the
epochs, those that the network itself scores highest.  It runs on the driver over a sample whose rows
and characters are bounded by parameters; the broadcast model has a fixed size.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_slices, labelled_sample, mix64, prepare, span_hashes, string_bytes, word_bounds

WINDOW, STRIDE = 32, 16
#: Bytes of the character pieces: beginnings, and (negative) ends.
PIECES = (4, 6, 8, -3)
INPUTS = 1 + len(PIECES)
#: Bytes of a gram and of the longest unit, and most grams of one.
GRAM, LONG = 5, 16
MOST = LONG - GRAM + 1
#: Most units, or pieces of one kind, that have an embedding.
KNOWN = 1 << 14
EMBED, HIDDEN, ATTEND = 12, 8, 8
#: Documents' worth of prior in a word's smoothed log-odds; documents of the sample, and their share, that must hold a known word.
PRIOR, LEAST, LEAST_SHARE = 20.0, 4, 0.005
#: Share of a training window's pieces and grams that are left out at random.
DROP = 0.4
#: Share of a training window's units that are read by their grams alone, as if other letters stood around them.
GLUED = 0.2
#: Share of clean training windows that become one word repeated.
REPEAT = 0.2
#: Windows scored at a time.
BATCH = 2048
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORDY = np.zeros(256, bool)
_WORDY[48:58] = _WORDY[65:91] = _WORDY[97:123] = _WORDY[128:] = True


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of all units, whether a unit is cut from a long run, and each text's n+1 unit offsets."""
    a, b, _ = word_bounds(data, off)
    n = len(data)
    if not n:
        return a, b, np.zeros(0, bool), np.zeros(len(off), np.int64)
    wordy = _WORDY[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = wordy.copy()
    first[1:] &= ~wordy[:-1] | edge[1:-1]
    last = wordy.copy()
    last[:-1] &= ~wordy[1:] | edge[1:-1]
    run, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    far = stop - run > LONG
    inside = np.zeros(n + 1, np.int8)
    inside[run[far]] += 1
    inside[stop[far]] -= 1
    # in a long run each character starts a unit, but for the last two bytes
    place = np.flatnonzero((np.cumsum(inside[:-1], dtype=np.int8) > 0) & ((data & 0xC0) != 0x80))
    end = stop[np.searchsorted(run, place, "right") - 1] if len(place) else place
    place, end = place[end - place >= 3], end[end - place >= 3]
    seen = np.concatenate([[0], np.cumsum(wordy)])
    bare = seen[a] == seen[b]  # no letter or digit: the symbols are the unit
    starts = np.concatenate([run[~far], a[bare], place])
    stops = np.concatenate([stop[~far], b[bare], np.minimum(place + LONG, end)])
    cut = np.repeat([False, True], [len(starts) - len(place), len(place)])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    return starts, stops[order], cut[order], np.searchsorted(starts, off)


def unit_inputs(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (inputs x units) of units and their pieces; hashes of the units' grams, and the unit of each, ascending."""
    if not len(starts):
        return np.zeros((INPUTS, 0), np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    base = int(starts[0])
    data = _LOWER[data[base:int(stops.max())]]
    a, b = starts - base, stops - base
    count = np.clip(b - a - GRAM + 1, 0, np.where(cut, 1, MOST))
    owner = np.repeat(np.arange(len(a)), count)
    at = a[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    whole = (data[at] & 0xC0) != 0x80
    owner, at = owner[whole], at[whole]
    spans = [(a, b)] + [(a, np.minimum(a + n, b)) if n > 0 else (np.maximum(b + n, a), b) for n in PIECES] + [(at, at + GRAM)]
    low = span_hashes(data, np.concatenate([x for x, _ in spans]), np.concatenate([y for _, y in spans]))
    low, grams = low[:INPUTS * len(a)].reshape(INPUTS, -1), low[INPUTS * len(a):]
    for k, n in enumerate(PIECES, 1):  # a unit no longer than the piece is told from the beginning of a longer one
        low[k] = mix64(low[k] + np.uint64(k) + np.uint64(1000) * (b - a <= abs(n)))
    return low, grams, owner


def look_up(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """1 + the place of each hash in the ascending vocabulary, or 0 where it is not in it."""
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == hashes, at + 1, 0) if len(vocabulary) else np.zeros(len(hashes), np.int64)


def windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, text) of the overlapping windows of all texts, by the texts' unit offsets; a text without units has none."""
    n = np.diff(words)
    count = np.where(n == 0, 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1)
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = words[:-1][text] + nth * STRIDE
    return start, np.minimum(start + WINDOW, words[1:][text]), text


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def new_parameters(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {f"e{k}": np.zeros((KNOWN, EMBED)) for k in range(INPUTS + 1)}
    for d in "fb":
        p["wx" + d] = rng.normal(0, EMBED ** -0.5, (EMBED, 3 * HIDDEN))
        p["u" + d] = rng.normal(0, 0.5 * HIDDEN ** -0.5, (HIDDEN, 3 * HIDDEN))
        p["b" + d] = np.zeros(3 * HIDDEN)
    p["wa"], p["ba"], p["va"] = rng.normal(0, 0.3, (2 * HIDDEN, ATTEND)), np.zeros(ATTEND), rng.normal(0, 0.3, ATTEND)
    p["wo"], p["bo"] = rng.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)
    return p


def forward(p: dict, gates, steps: int, valid: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Logits of windows.  ``gates(t, d)`` gives the input part of the gates at step t for direction d;
    ``valid`` (windows x steps) marks words.  ``keep`` collects what ``backward`` needs."""
    n = len(valid)
    kind = p["bo"].dtype
    states = np.zeros((steps, n, 2 * HIDDEN), kind)
    for k, d in enumerate("fb"):
        h = np.zeros((n, HIDDEN), kind)
        for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
            a, u = gates(t, d), h @ p["u" + d]
            zr = _sigmoid(a[:, :2 * HIDDEN] + u[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(a[:, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:])
            on = valid[:, t, None]
            new = np.where(on, c + z * (h - c), h)
            if keep is not None:
                keep.append((d, t, h, u[:, 2 * HIDDEN:], z, r, c, on))
            h = new
            states[t, :, k * HIDDEN:(k + 1) * HIDDEN] = h
    s = np.tanh(states @ p["wa"] + p["ba"])
    e = np.where(valid.T, s @ p["va"], -1e9)
    e = np.exp(e - e.max(0))
    alpha = e / e.sum(0)
    pooled = (alpha[:, :, None] * states).sum(0)
    if keep is not None:
        keep.append((states, s, alpha, pooled))
    return pooled @ p["wo"] + p["bo"][0]


def backward(p: dict, x: np.ndarray, keep: list, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of all parameters but the embeddings, and of the inputs ``x`` (windows x steps x EMBED)."""
    g = {k: np.zeros_like(v) for k, v in p.items() if k[0] != "e"}
    states, s, alpha, pooled = keep[-1]
    g["wo"], g["bo"] = pooled.T @ dlogit, np.array([dlogit.sum()])
    dpool = dlogit[:, None] * p["wo"]
    dalpha = (states * dpool).sum(2)
    de = alpha * (dalpha - (alpha * dalpha).sum(0))
    ds = de[:, :, None] * p["va"] * (1 - s * s)
    g["va"], g["ba"] = (de[:, :, None] * s).sum((0, 1)), ds.sum((0, 1))
    g["wa"] = np.einsum("tni,tnj->ij", states, ds)
    dstates = alpha[:, :, None] * dpool + ds @ p["wa"].T
    dx, carried = np.zeros_like(x), {}
    for d, t, h, un, z, r, c, on in reversed(keep[:-1]):
        k = "fb".index(d)
        dh = dstates[t, :, k * HIDDEN:(k + 1) * HIDDEN] + carried.get(d, 0)
        dnew = np.where(on, dh, 0)
        dc = dnew * (1 - z) * (1 - c * c)
        dz = dnew * (h - c) * z * (1 - z)
        dr = dc * un * r * (1 - r)
        da = np.concatenate([dz, dr, dc], 1)
        du = np.concatenate([dz, dr, dc * r], 1)
        g["u" + d] += h.T @ du
        g["wx" + d] += x[:, t].T @ da
        g["b" + d] += da.sum(0)
        dx[:, t] += da @ p["wx" + d].T
        carried[d] = np.where(on, dnew * z, dh) + du @ p["u" + d].T
    return g, dx


def embed(p: dict, ids: np.ndarray, inner: np.ndarray) -> np.ndarray:
    return sum(p[f"e{k}"][ids[k]] for k in range(INPUTS)) + p[f"e{INPUTS}"][inner].sum(-2)


@dataclass
class ToxicityModel:
    """Hashes of the known units, pieces and grams, input tables already multiplied by both directions' gate weights, the other parameters, the calibration."""

    known: list[np.ndarray]
    tables: list[np.ndarray]
    rest: dict[str, np.ndarray]
    scale: float
    shift: float


def window_logits(tables: list[np.ndarray], rest: dict, inputs, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Logits of all windows.  ``inputs(first, last)`` gives the ids of these units (inputs x units), of their known grams, and
    each gram's unit, counted from ``first``: no more than a batch of windows has to be at hand."""
    out = np.empty(len(start), np.float32)
    for i in range(0, len(start), BATCH):
        a, b = start[i:i + BATCH], stop[i:i + BATCH]
        first, last = int(a[0]), int(b.max())
        ids, grams, owner = inputs(first, last)
        gate = tables[0][ids[0]]
        for k in range(1, INPUTS):
            gate += tables[k][ids[k]]
        if len(grams):
            head = np.flatnonzero(np.diff(owner, prepend=-1))
            gate[owner[head]] += np.add.reduceat(tables[INPUTS][grams], head, axis=0)
        steps = int((b - a).max())
        place = a[:, None] - first + np.arange(steps)
        valid = place < (b - first)[:, None]
        place = np.minimum(place, last - first - 1)
        half = 3 * HIDDEN

        def gates(t, d):
            return gate[place[:, t], :half] if d == "f" else gate[place[:, t], half:]

        out[i:i + BATCH] = forward(rest, gates, steps, valid)
    return out


def _pack(p: dict) -> tuple[list[np.ndarray], dict]:
    wx = np.concatenate([p["wxf"], p["wxb"]], 1)
    bias = np.concatenate([p["bf"], p["bb"]])
    tables = [(p[f"e{k}"] @ wx + bias * (k == 0)).astype(np.float32) for k in range(INPUTS + 1)]
    return tables, {k: v.astype(np.float32) for k, v in p.items() if k in ("uf", "ub", "wa", "ba", "va", "wo", "bo")}


def _highest(logits: np.ndarray, text: np.ndarray, n: int, empty: float) -> np.ndarray:
    top = np.full(n, -np.inf)
    np.maximum.at(top, text, logits)
    return np.where(np.isfinite(top), top, empty)


def _telling(score: np.ndarray, text: np.ndarray, per_text: int) -> np.ndarray:
    """Indices of the ``per_text`` highest windows of each text."""
    order = np.lexsort((np.arange(len(score)), -score, text))
    first = np.concatenate([[True], text[order][1:] != text[order][:-1]])
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[nth < per_text]


def _sample_inputs(texts: list[str], step: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``unit_inputs`` of all texts and their unit offsets, a few texts at a time to keep its working arrays small."""
    parts, inner, owners, words = [], [], [], [np.zeros(1, np.int64)]
    for i in range(0, len(texts), step):
        enc = [t.encode() for t in texts[i:i + step]]
        data, off = np.frombuffer(b"".join(enc), np.uint8), np.cumsum([0] + [len(e) for e in enc])
        starts, stops, cut, w = units(data, off)
        h, g, owner = unit_inputs(data, starts, stops, cut)
        parts.append(h)
        inner.append(g)
        owners.append(owner + words[-1][-1])
        words.append(w[1:] + words[-1][-1])
    return np.concatenate(parts, 1), np.concatenate(inner), np.concatenate(owners), np.concatenate(words)


def train(sample: list[tuple[int, str]], *, epochs: int = 6, steps: int = 300, batch: int = 256, rate: float = 0.01, decay: float = 0.02, seed: int = 2,
          prior: float | None = None) -> ToxicityModel:
    """Adam on balanced cross-entropy over chosen windows, then a logistic calibration of the documents' highest windows.

    ``prior`` is the share of label 1 among all labelled rows, if the sample has another one.
    A small sample is gone through more than ``epochs`` times, until ``steps`` updates are made.

    Without rows of both classes every score is that of the one class, or 0.5."""
    rng = np.random.default_rng(seed)
    p = new_parameters(rng)
    y = np.array([y for y, _ in sample], float)
    if not len(y) or y.min() == y.max():
        tables, rest = _pack(p)
        return ToxicityModel([np.zeros(0, np.uint64)] * (INPUTS + 1), tables, rest, 0.0, 0.0 if not len(y) else (8.0 if y[0] else -8.0))
    hashes, grams, gram_unit, words = _sample_inputs([t for _, t in sample])
    start, stop, text = windows(words)
    owner = np.repeat(np.arange(len(y)), np.diff(words))
    # a fifth of the sample is left for the calibration
    held = rng.permutation(len(y)) < len(y) // 5
    if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        held[:] = False
    fitted_y = y[~held]
    share = fitted_y.mean()
    known, ids = [], np.zeros(hashes.shape, np.int32)
    strong = np.zeros(hashes.shape[1])
    for k in range(INPUTS + 1):
        values, holder = (hashes[k], owner) if k < INPUTS else (grams, owner[gram_unit])
        distinct, code = np.unique(values, return_inverse=True)
        seen = np.unique((holder * len(distinct) + code)[~held[holder]])
        toxic = np.bincount(seen % len(distinct), weights=y[seen // len(distinct)], minlength=len(distinct))
        total = np.bincount(seen % len(distinct), minlength=len(distinct))
        odds = np.log((toxic + PRIOR * share) / (total - toxic + PRIOR * (1 - share))) - np.log(share / (1 - share))
        enough = int((total >= max(LEAST, LEAST_SHARE * len(fitted_y))).sum())
        keep_at = np.sort(np.lexsort((distinct, -total * np.abs(odds)))[:min(KNOWN - 1, enough)])
        keep_at = keep_at[total[keep_at] >= LEAST]
        known.append(distinct[keep_at])
        odds = np.concatenate([[0.0], odds[keep_at]])
        p[f"e{k}"][:len(odds), k] = np.clip(odds, -4, 4) / 4
        if k < INPUTS:
            ids[k] = look_up(known[k], values)
            strong = np.maximum(strong, odds[ids[k]])
        else:
            grams = look_up(known[k], values).astype(np.int32)
            np.maximum.at(strong, gram_unit, odds[grams])
    del hashes, values, distinct, code, seen, holder
    grams, gram_unit = grams[grams > 0], gram_unit[grams > 0]
    # the known grams of each unit, filled up with zeros
    inner = np.zeros((len(strong), MOST), np.int16)
    inner[gram_unit, np.arange(len(grams)) - np.searchsorted(gram_unit, gram_unit)] = grams

    def inputs(first, last):
        i, j = np.searchsorted(gram_unit, [first, last])
        return ids[:, first:last], grams[i:j], gram_unit[i:j] - first

    strong = np.concatenate([[0], np.cumsum(strong ** 2)])
    score = strong[stop] - strong[start]
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    epochs = max(epochs, -(-steps // -(-max(1, min(len(text), 4 * len(y))) // batch)))
    for epoch in range(epochs):
        if epoch == epochs // 2:
            score = window_logits(*_pack(p), inputs, start, stop)
        if epoch in (0, epochs // 2):
            chosen = np.unique(np.concatenate([_telling(score, text, 2), rng.choice(len(text), min(len(text), 4 * len(y)), replace=False)]))
            best = np.zeros(len(text), bool)
            best[_telling(score, text, 2)] = True
            # a random window of a toxic document may be clean: only its telling ones count as toxic, the others are left out
            chosen = chosen[((y[text[chosen]] == 0) | best[chosen]) & ~held[text[chosen]]]
            target = y[text[chosen]]
            weight = np.where(target == 1, 0.5 / max(target.mean(), 1e-9), 0.5 / max(1 - target.mean(), 1e-9))
        order = rng.permutation(len(chosen))
        for s in range(0, len(order), batch):
            at = order[s:s + batch]
            w = chosen[at]
            place = start[w][:, None] + np.arange(WINDOW)
            # junk texts repeat a word: some clean windows are replaced by one of their words over and over
            again = (target[at] == 0) & (rng.random(len(at)) < REPEAT)
            place[again] = rng.integers(start[w], stop[w])[again, None]
            valid = place < stop[w][:, None]
            place = np.minimum(place, ids.shape[1] - 1)
            part, within = ids[:, place], inner[place]
            part = np.where(valid & (rng.random(valid.shape) >= GLUED) & (rng.random(part.shape) >= DROP), part, 0)
            within = np.where(valid[:, :, None] & (rng.random(within.shape) >= DROP), within, 0)
            x = embed(p, part, within)
            keep: list = []
            logit = forward(p, lambda t, d: x[:, t] @ p["wx" + d] + p["b" + d], WINDOW, valid, keep)
            dlogit = (_sigmoid(logit) - target[at]) * weight[at] / len(at)
            g, dx = backward(p, x, keep, dlogit)
            dx = dx.reshape(-1, EMBED)
            for k in range(INPUTS + 1):
                met = part[k].reshape(-1, 1) if k < INPUTS else within.reshape(-1, MOST)
                at_unit, nth = np.nonzero(met)
                g[f"e{k}"] = np.zeros((KNOWN, EMBED))
                np.add.at(g[f"e{k}"], met[at_unit, nth], dx[at_unit])
            step += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] * g[k] - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8) + rate * decay * p[k]
    tables, rest = _pack(p)
    top = _highest(window_logits(tables, rest, inputs, start, stop), text, len(y), float(p["bo"][0]))
    scale, shift = _calibrate(top[held], y[held], prior) if held.any() else _calibrate(top, y, prior)
    return ToxicityModel(known, tables, rest, scale, shift)


def _calibrate(x: np.ndarray, y: np.ndarray, prior: float | None) -> tuple[float, float]:
    """Ridge logistic regression of y on x by Newton steps, with the classes weighted to the ``prior`` of label 1."""
    middle, spread = x.mean(), x.std() + 1e-6
    a = np.stack([(x - middle) / spread, np.ones_like(x)], 1)
    c = np.ones_like(x) if prior is None else np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    w = np.zeros(2)
    for _ in range(50):
        q = _sigmoid(np.clip(a @ w, -30, 30))
        w -= np.linalg.solve((a * (c * q * (1 - q))[:, None]).T @ a + 0.05 * np.eye(2), a.T @ (c * (q - y)) + 0.05 * w)
    w[0] = max(w[0], 0.0) / spread
    return float(w[0]), float(w[1] - w[0] * middle)


def score_rows(model: ToxicityModel, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Score of each of the concatenated rows, from all its windows."""
    starts, stops, cut, words = units(data, off)
    start, stop, text = windows(words)

    def inputs(first, last):
        hashes, grams, owner = unit_inputs(data, starts[first:last], stops[first:last], cut[first:last])
        grams = look_up(model.known[INPUTS], grams)
        return np.stack([look_up(known, h) for known, h in zip(model.known, hashes)]), grams[grams > 0], owner[grams > 0]

    logits = window_logits(model.tables, model.rest, inputs, start, stop) if len(start) else np.zeros(0)
    top = _highest(logits, text, len(off) - 1, float(model.rest["bo"][0]))
    return 1 / (1 + np.exp(-np.clip(model.scale * top + model.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        per_class: int = 2500, max_chars: int = 8_000_000, seed: int = 2) -> ToxicityModel:
    """Learn from labelled rows whose ids satisfy ``keep`` (over ``_id``); see ``labelled_sample`` for the bounds."""
    sample = labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, keep=keep,
                             per_class=per_class, max_chars=max_chars, seed=seed)
    counts = {r["y"]: r["n"] for r in labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("y")).filter(keep).groupBy("y").agg(F.count("*").alias("n")).collect()}
    both = counts.get(0, 0) and counts.get(1, 0)
    return train(sample, seed=seed, prior=counts[1] / (counts[0] + counts[1]) if both else None)


def score(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default ``doc_id``), ``score`` (0 to 1) and ``predicted`` (score >= 0.5) for each row.

    Texts that are null, empty or without words have no window and the score of the output unit's
    bias; whole texts are read, whatever their length and whether or not they have spaces; repeated rows give repeated results; no other column is read."""
    spark = docs.sparkSession
    prepare(spark)
    carry = ["doc_id"] if carry is None else carry
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("_text"))
    schema = "".join(f"c{i} {src.schema[i].dataType.simpleString()}, " for i in range(len(carry)))

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, "_text", 1 << 20):
                p = score_rows(shared.value, *string_bytes(part.column("_text")))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p)], [*part.schema.names[:-1], "score"])

    out = src.mapInArrow(run, f"{schema}score double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
