"""Bidirectional LSTM over characters with a CRF on top, in numpy: training and batched decoding.

Gates use x / (1 + |x|), shifted and halved for the sigmoid-like ones: as smooth as needed for gradients and
several times cheaper than exponentials.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
HIDDEN = 8
TRAIN_WINDOW = 88
FORBIDDEN = -1e4
BATCH = 2048
ALONE = 0.7


def _alphabet() -> np.ndarray:
    """Class of each code point up to 128: 0 pads, digits are one class, ASCII case is folded, the rest is one class."""
    table = np.zeros(129, dtype=np.uint8)
    classes: dict[str, int] = {}
    for cp in range(128):
        c = chr(cp).lower()
        c = "0" if c.isdigit() else "\n" if c.isspace() and c != " " else c if c.isprintable() else "\x01"
        table[cp] = classes.setdefault(c, len(classes) + 1)
    table[128] = len(classes) + 1
    return table


ALPHABET = _alphabet()
SYMBOLS = int(ALPHABET.max()) + 1


def encode_chars(text: str) -> np.ndarray:
    return ALPHABET[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 128)]


def allowed() -> np.ndarray:
    """0 for transitions that BIO tags allow, else a large negative number; the last row is the start."""
    out = np.zeros((TAGS + 1, TAGS), dtype=np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = FORBIDDEN
        out[[inside - 1, inside], inside] = 0.0
    return out


def _sign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Tagger:
    """Parameters: input tables (2, symbols, 4H) with bias, recurrent (2, H, 4H), output (2H, tags), transitions (tags + 1, tags)."""

    def __init__(self, table, recurrent, output, bias, transitions):
        self.table, self.recurrent, self.output, self.bias, self.transitions = [np.asarray(a, dtype=np.float32) for a in (table, recurrent, output, bias, transitions)]

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.recurrent, self.output, self.bias, self.transitions]

    def hidden(self, codes: np.ndarray) -> np.ndarray:
        """(T, B, 2H) states of a (T, B) matrix of symbols that is padded with 0 at the ends."""
        steps, n = codes.shape
        out = np.empty((steps, n, 2 * HIDDEN), dtype=np.float32)
        for d in range(2):
            tables = np.ascontiguousarray(self.table[d].reshape(SYMBOLS, 4, HIDDEN).transpose(1, 0, 2))
            # states are kept at twice their size, so the recurrent weights count half
            mats = np.ascontiguousarray(self.recurrent[d].reshape(HIDDEN, 4, HIDDEN).transpose(1, 0, 2)) * np.float32(0.5)
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            z, r = np.empty((4, n, HIDDEN), np.float32), np.empty((4, n, HIDDEN), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                symbols = codes[t]
                for g in range(4):
                    tables[g].take(symbols, axis=0, out=z[g], mode="clip")
                np.matmul(h, mats, out=r)
                z += r
                np.abs(z, out=r)
                r += 1
                z /= r
                z[:3] += 1
                c *= z[1]
                np.multiply(z[0], z[3], out=r[0])
                c += r[0]
                c *= np.float32(0.5)
                np.abs(c, out=r[0])
                r[0] += 1
                np.divide(c, r[0], out=h)
                h *= z[2]
                if d and symbols[0] == 0:  # windows come shortest first
                    pad = symbols == 0
                    h[pad] = 0
                    c[pad] = 0
                out[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        out *= np.float32(0.5)
        return out

    def spans(self, windows: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) spans of each window of symbols by the best CRF path.

        Where, at every place of a window, no other tag can make up the lead of the outside tag even with the best
        transition, the path of outside tags is the best one, and the window is not searched.
        """
        found: list[list] = [[] for _ in windows]
        order = np.argsort([len(w) for w in windows], kind="stable")
        ways = self.ways()
        versus, offset = self.output[:, 1:] - self.output[:, :1], self.bias[1:] - self.bias[0] + ways
        for low in range(0, len(order), BATCH):
            some = order[low : low + BATCH]
            steps = len(windows[some[-1]])
            codes = np.zeros((len(some), steps), dtype=np.uint8)
            for i, w in enumerate(some):
                codes[i, : len(windows[w])] = windows[w]
            codes = np.ascontiguousarray(codes.T).astype(np.intp)
            states = self.hidden(codes)
            gain = np.dot(states.reshape(-1, 2 * HIDDEN), versus)
            hot = (gain > -offset).reshape(steps, len(some), TAGS - 1).any(axis=0).any(axis=1)
            open_ = np.flatnonzero(hot)
            if not len(open_):
                continue
            emit = states[:, open_].reshape(-1, 2 * HIDDEN) @ self.output + self.bias
            tags = self.best_path(emit.reshape(steps, len(open_), TAGS), codes[:, open_] > 0)
            for i, row in zip(open_, tags.T, strict=True):
                found[some[i]] = tag_spans(row)
        return found

    def ways(self) -> np.ndarray:
        """For each other tag the most it can gain over the outside tag besides its emission.

        A potential per tag, added where the tag is left and taken off where it is entered, changes no path from
        outside to outside; it is chosen so that leaving a span gains nothing and going on inside it
        gains no more than its own repetition does, which leaves the cost of entering to the first tag.
        """
        move, stay = self.transitions[:-1].astype(np.float64), float(self.transitions[0, 0])
        shift = stay - move[:, 0]
        for b in range(1, TAGS, 2):
            shift[b] = min(shift[b], move[b + 1, b + 1] - move[b, b + 1] + shift[b + 1])
        moved = move + shift[:, None] - shift[None, :]
        first = self.transitions[-1].astype(np.float64) - shift - self.transitions[-1, 0] + stay
        return (np.maximum(moved.max(axis=0), first)[1:] - stay).astype(np.float32)

    def best_path(self, emit: np.ndarray, real: np.ndarray) -> np.ndarray:
        """(T, B) tags; after a text's end they are outside tags."""
        steps, n, _ = emit.shape
        move = self.transitions[:-1]
        score = self.transitions[-1][None, :] + emit[0]
        back = np.zeros((steps, n, TAGS), dtype=np.int8)
        stay = np.arange(TAGS, dtype=np.int8)
        for t in range(1, steps):
            total = score[:, :, None] + move[None]
            best = total.argmax(axis=1)
            moved = np.take_along_axis(total, best[:, None, :], axis=1)[:, 0] + emit[t]
            score = np.where(real[t][:, None], moved, score)
            back[t] = np.where(real[t][:, None], best, stay)
        tags = np.zeros((steps, n), dtype=np.int8)
        tags[-1] = score.argmax(axis=1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t, rows, tags[t]]
        tags[~real] = 0
        return tags


def tag_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    out = []
    for t in np.flatnonzero((tags > 0) & (tags % 2 == 1)).tolist():
        e = t + 1
        while e < len(tags) and tags[e] == tags[t] + 1:
            e += 1
        out.append(((int(tags[t]) - 1) // 2, t, e))
    return out


def example_windows(base: Callable[[str], dict]):
    """mapInArrow step: of each text one window around each of its first labelled spans, and one elsewhere."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spans = sorted((s, e, k) for k, own in enumerate(base(text).values()) for s, e in own if e - s < TRAIN_WINDOW - 16)
                starts = [max(0, s - 20 - (s * 7) % 24) for s, _, _ in spans[:4]] + [len(text) * ((doc or 0) % 97) // 97]
                for at in starts:
                    end = at + TRAIN_WINDOW
                    inner = [{"kind": k, "start": s - at, "end": e - at} for s, e, k in spans if at <= s and e <= end]
                    if not any(s < end and e > at and not (at <= s and e <= end) for s, e, _ in spans):
                        rows.append((doc, at, text[at:end], inner))
            ids, at, texts, labels = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(texts, pa.string()), pa.array(labels, kind)], names=["doc_id", "at", "text", "labels"])

    return step


def invented(rng: np.random.Generator) -> tuple[int, str]:
    """A kind and a datum of it, in one of the forms people write."""

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def word() -> str:
        return "".join(rng.choice(list("abcdefghijklmnoprstuvwz"), int(rng.integers(3, 9))))

    kind = int(rng.integers(0, 4))
    if kind == 0:
        at = rng.choice(["@", "@", " [at] ", " (at) "])
        return 0, f"{word()}{rng.choice(['', '.', '_'])}{digits(2)}{at}{word()}.{rng.choice(['com', 'org', 'net', 'de'])}"
    if kind == 1:
        return 1, ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        gap = str(rng.choice(["", " ", "-"]))
        return 2, gap.join(digits(4) for _ in range(4))
    a, b, c = digits(3), digits(3), digits(4)
    return 3, str(rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {a} {b} {c}", f"{a}.{b}.{c}"]))


def labelled(examples: list, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(windows, tags): the given windows, and as many with an invented datum put between two words."""
    texts = [(t, list(spans)) for t, spans in examples]
    plain = [t for t, spans in texts if not spans and len(t) > 40] or ["lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam"]
    for _ in range(max(1500, len(texts) // 2)):
        t = plain[int(rng.integers(len(plain)))][: TRAIN_WINDOW - 28]
        cuts = [i for i, c in enumerate(t) if c == " "] or [len(t)]
        cut = cuts[int(rng.integers(len(cuts)))]
        kind, datum = invented(rng)
        t = f"{t[:cut]} {datum}{t[cut:]}"
        texts.append((t, [(kind, cut + 1, cut + 1 + len(datum))]))
    codes, tags = np.zeros((len(texts), TRAIN_WINDOW), np.uint8), np.zeros((len(texts), TRAIN_WINDOW), np.int8)
    for i, (t, spans) in enumerate(texts):
        c = encode_chars(t)[:TRAIN_WINDOW]
        codes[i, : len(c)] = c
        for kind, s, e in spans:
            if e <= TRAIN_WINDOW:
                tags[i, s], tags[i, s + 1 : e] = 1 + 2 * kind, 2 + 2 * kind
    return codes, tags


def _crf(emit: np.ndarray, tags: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood, and its gradients by emissions (T, B, K) and transitions."""
    steps, n, k = emit.shape
    top = emit.max(axis=2, keepdims=True)
    p, move, start = np.exp(emit - top), np.exp(trans[:-1]), np.exp(trans[-1])
    alpha, beta, norm = np.empty_like(p), np.ones_like(p), np.empty((steps, n, 1), p.dtype)
    now = start * p[0]
    for t in range(steps):
        if t:
            now = (alpha[t - 1] @ move) * p[t]
        norm[t] = now.sum(axis=1, keepdims=True)
        alpha[t] = now / norm[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = (p[t + 1] * beta[t + 1] / norm[t + 1]) @ move.T
    grad = alpha * beta
    rows = np.arange(n)
    g_trans = np.zeros_like(trans)
    g_trans[-1] = grad[0].sum(axis=0)
    g_trans[:-1] = move * (alpha[:-1].reshape(-1, k).T @ (p * beta / norm)[1:].reshape(-1, k))
    np.add.at(g_trans[-1], tags[0], -1)
    np.add.at(g_trans, (tags[:-1].ravel(), tags[1:].ravel()), -1)
    gold = trans[-1][tags[0]].sum() + trans[tags[:-1], tags[1:]].sum() + np.take_along_axis(emit, tags[:, :, None], axis=2).sum()
    loss = float((np.log(norm).sum() + top.sum() - gold) / n)
    grad[np.arange(steps)[:, None], rows[None, :], tags] -= 1
    return loss, grad / n, g_trans / n


def gradients(model: Tagger, codes: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients over a (T, B) batch, back through time in both directions at once."""
    steps, n = codes.shape
    both = np.stack([codes, codes[::-1]])
    h, c = np.zeros((steps + 1, 2, n, HIDDEN), np.float32), np.zeros((steps + 1, 2, n, HIDDEN), np.float32)
    gates = np.empty((steps, 2, n, 4, HIDDEN), np.float32)
    for t in range(steps):
        z = np.stack([model.table[d][both[d, t]] for d in range(2)]) + np.matmul(h[t], model.recurrent)
        s = _sign(z).reshape(2, n, 4, HIDDEN)
        gates[t] = s
        i, f, o = (0.5 + 0.5 * s[:, :, g] for g in range(3))
        c[t + 1] = f * c[t] + i * s[:, :, 3]
        h[t + 1] = o * _sign(c[t + 1])
    states = np.concatenate([h[1:, 0], h[1:, 1][::-1]], axis=2)
    emit = states @ model.output + model.bias
    loss, g_emit, g_trans = _crf(emit, tags, model.transitions)
    # each place by itself as well: keeps tags low where they are not wanted, which lets decoding skip windows
    alone = np.exp(emit - emit.max(axis=2, keepdims=True))
    alone /= alone.sum(axis=2, keepdims=True)
    alone[np.arange(steps)[:, None], np.arange(n)[None, :], tags] -= 1
    g_emit += alone * (ALONE / n)
    flat = g_emit.reshape(-1, TAGS)
    g_out, g_bias = states.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
    g_states = g_emit @ model.output.T
    into = np.stack([g_states[:, :, :HIDDEN], g_states[::-1, :, HIDDEN:]], axis=1)
    dz = np.empty((steps, 2, n, 4, HIDDEN), np.float32)
    dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        s = gates[t]
        slope = np.square(1 - np.abs(s))
        i, f, o = (0.5 + 0.5 * s[:, :, g] for g in range(3))
        out = _sign(c[t + 1])
        dh = dh + into[t]
        dc = dc + dh * o * np.square(1 - np.abs(out))
        dz[t, :, :, 0] = dc * s[:, :, 3] * 0.5
        dz[t, :, :, 1] = dc * c[t] * 0.5
        dz[t, :, :, 2] = dh * out * 0.5
        dz[t, :, :, 3] = dc * i
        dz[t] *= slope
        dh = np.matmul(dz[t].reshape(2, n, 4 * HIDDEN), model.recurrent.transpose(0, 2, 1))
        dc = dc * f
    dz = dz.reshape(steps, 2, n, 4 * HIDDEN)
    g_rec = np.stack([h[:-1, d].reshape(-1, HIDDEN).T @ dz[:, d].reshape(-1, 4 * HIDDEN) for d in range(2)])
    g_table = np.zeros_like(model.table)
    for d in range(2):
        hot = np.zeros((steps * n, SYMBOLS), np.float32)
        hot[np.arange(steps * n), both[d].ravel()] = 1
        g_table[d] = hot.T @ dz[:, d].reshape(-1, 4 * HIDDEN)
    return loss, [g_table, g_rec, g_out, g_bias, g_trans]


def train(examples: list, seed: int = 11, updates: int = 360, batch: int = 96, rate: float = 0.02) -> Tagger:
    """Fit to windows (text, [(kind, start, end)]) by Adam; the same examples give the same model."""
    rng = np.random.default_rng(seed)
    codes, tags = labelled(examples, rng)
    table = rng.normal(0, 0.5, (2, SYMBOLS, 4 * HIDDEN))
    table[:, :, HIDDEN : 2 * HIDDEN] += 1.5
    model = Tagger(table, rng.normal(0, 0.35, (2, HIDDEN, 4 * HIDDEN)), rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), np.zeros(TAGS), allowed())
    model.bias[0] = 2.0
    mask = (allowed() == 0).astype(np.float32)
    first, second = [np.zeros_like(p) for p in model.parameters()], [np.zeros_like(p) for p in model.parameters()]
    for step in range(1, updates + 1):
        some = rng.integers(0, len(codes), batch)
        _, grads = gradients(model, np.ascontiguousarray(codes[some].T).astype(np.intp), np.ascontiguousarray(tags[some].T).astype(np.intp))
        grads[4] *= mask
        size = np.sqrt(sum(float(np.square(g).sum()) for g in grads))
        now = rate * min(1.0, 1.6 * (1 - step / (updates + 1)))
        for p, g, m, v in zip(model.parameters(), grads, first, second, strict=True):
            g = g * min(1.0, 5.0 / max(size, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return model
