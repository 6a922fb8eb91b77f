"""Personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans. Texts are read in overlapping windows; each window is decoded
by Viterbi, and the spans of all windows of a text are reconciled at once: of those that overlap, the set with the
highest sum of weights stays.

Every kind of span holds a digit or an at sign. Windows without either are not run: no span can come from them.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

KINDS = ("email", "ip", "card", "phone")
#: Windows of WINDOW characters begin every STRIDE, so a span of up to WINDOW - STRIDE lies whole in one of them; parts of
#: longer ones are put together.
WINDOW, STRIDE = 128, 64
#: Least mean probability of a span's tags for it to count.
SURE = 0.9
EMBED, HIDDEN = 10, 20
#: Size and training of the labelled sample.
SAMPLES, STEPS, LENGTH = 4096, 500, 72
BATCH = 512  # windows run together

N_TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind

TRIGGER = re.compile("[0-9@]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their at signs in linear time."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def fitting(kind: str, text: str) -> bool:
    """What a match or a span of a kind must satisfy besides its pattern."""
    if kind == "email":
        return "@" in text
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    digits = digits_of(text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed patterns, leftmost and non-overlapping within a kind, sorted."""
    out = [(0, a, b) for a, b in emails(text)]
    if TRIGGER.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if fitting("ip", m[0])]
        out += [(2, *m.span()) for m in CARD.finditer(text) if fitting("card", m[0])]
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if fitting("phone", m[0])]
    return sorted(out)


# --- the network ------------------------------------------------------------------------------------------------

N_CHARS = 100


def codes(text: str) -> np.ndarray:
    """Characters as small numbers: printable ASCII, white space, other letters, the rest; 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((points > 32) & (points < 127), points - 31, 99)
    out[(points == 32) | ((points >= 9) & (points <= 13))] = 1
    out[points >= 0xC0] = 98
    return out.astype(np.int32)


def start_weights(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {"embed": rng.normal(0, 0.3, (N_CHARS, EMBED)), "moves": np.zeros((N_TAGS, N_TAGS)), "out": rng.normal(0, 0.2, (2 * HIDDEN, N_TAGS)), "out_b": np.zeros(N_TAGS)}
    for way in ("f", "b"):
        out[f"x_{way}"] = rng.normal(0, 0.3, (EMBED, 4 * HIDDEN))
        out[f"h_{way}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        out[f"c_{way}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return {k: v.astype(np.float32) for k, v in out.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def lstm(x: np.ndarray, mask: np.ndarray, recurrent: np.ndarray, tape: list | None = None) -> np.ndarray:
    """(time, batch, HIDDEN) states from gate inputs (time, batch, 4 HIDDEN); masked steps leave the state at 0."""
    steps, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    for t in range(steps):
        gates = x[t] + h @ recurrent
        ifo, g = sigmoid(gates[:, : 3 * HIDDEN]), np.tanh(gates[:, 3 * HIDDEN :])
        i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
        before, held = c, h
        c = (f * c + i * g) * mask[t, :, None]
        squashed = np.tanh(c)
        h = o * squashed
        out[t] = h
        if tape is not None:
            tape.append((i, f, o, g, before, held, squashed))
    return out


def lstm_back(slope: np.ndarray, mask: np.ndarray, recurrent: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the gate inputs and of the recurrent weights."""
    steps, n, _ = slope.shape
    out, weights = np.empty((steps, n, 4 * HIDDEN), np.float32), np.zeros_like(recurrent)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, held, squashed = tape[t]
        dh = dh + slope[t]
        dc = (dc + dh * o * (1 - squashed**2)) * mask[t, :, None]
        gates = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], 1)
        out[t] = gates
        weights += held.T @ gates
        dh, dc = gates @ recurrent.T, dc * f
    return out, weights


def emissions(w: dict[str, np.ndarray], chars: np.ndarray, tapes: dict | None = None) -> np.ndarray:
    """Tag scores (time, batch, N_TAGS) of padded character codes (batch, time)."""
    mask = (chars > 0).T.astype(np.float32)
    inputs = w["embed"][chars.T]
    states = []
    for way in ("f", "b"):
        step = 1 if way == "f" else -1
        tape: list | None = [] if tapes is not None else None
        states.append(lstm((inputs @ w[f"x_{way}"] + w[f"c_{way}"])[::step], mask[::step], w[f"h_{way}"], tape)[::step])
        if tapes is not None:
            tapes[way] = tape
    both = np.concatenate(states, 2)
    if tapes is not None:
        tapes |= {"inputs": inputs, "both": both, "mask": mask}
    return both @ w["out"] + w["out_b"]


def sums(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def chain(score: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log sums, and the log sum over all paths. Padding stands at the end only."""
    steps = len(score)
    forward, backward = score.copy(), np.zeros_like(score)
    for t in range(1, steps):
        forward[t] = np.where(mask[t, :, None] > 0, sums(forward[t - 1][:, :, None] + moves, 1) + score[t], forward[t - 1])
    for t in range(steps - 2, -1, -1):
        backward[t] = np.where(mask[t + 1, :, None] > 0, sums(moves + (score[t + 1] + backward[t + 1])[:, None, :], 2), 0)
    return forward, backward, sums(forward[-1], 1)


def gradients(w: dict[str, np.ndarray], chars: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
    """Slopes of the mean negative log-likelihood of the tags."""
    tapes: dict = {}
    score = emissions(w, chars, tapes)
    mask, n = tapes["mask"], len(chars)
    forward, backward, whole = chain(score, w["moves"], mask)
    live = mask[:, :, None]
    wanted = np.eye(N_TAGS, dtype=np.float32)[tags.T] * live
    slope = (np.exp(forward + backward - whole[None, :, None]) * live - wanted) / n
    moves = np.zeros_like(w["moves"])
    for t in range(1, len(score)):
        pair = np.exp(forward[t - 1][:, :, None] + w["moves"] + (score[t] + backward[t])[:, None, :] - whole[:, None, None])
        moves += (pair * mask[t][:, None, None]).sum(0) - wanted[t - 1].T @ wanted[t]
    out = {"moves": moves / n, "out": np.einsum("tnh,tnk->hk", tapes["both"], slope), "out_b": slope.sum((0, 1))}
    back = slope @ w["out"].T
    embed = np.zeros_like(tapes["inputs"])
    for k, way in enumerate(("f", "b")):
        step = 1 if way == "f" else -1
        gates, out[f"h_{way}"] = lstm_back(back[::step, :, k * HIDDEN : (k + 1) * HIDDEN], mask[::step], w[f"h_{way}"], tapes[way])
        gates = gates[::step]
        out[f"x_{way}"] = np.einsum("tne,tng->eg", tapes["inputs"], gates)
        out[f"c_{way}"] = gates.sum((0, 1))
        embed += gates @ w[f"x_{way}"].T
    out["embed"] = np.zeros_like(w["embed"])
    np.add.at(out["embed"], chars.T, embed)
    return out


def train(samples: list[tuple[str, list[tuple[int, int, int]]]], steps: int = STEPS, batch: int = 96, rate: float = 0.02, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights learned from (text, [(kind, start, end)]) by Adam with a falling rate and clipped slopes."""
    longest = max(len(t) for t, _ in samples)
    chars, tags = np.zeros((len(samples), longest), np.int32), np.zeros((len(samples), longest), np.int32)
    for k, (text, spans) in enumerate(samples):
        chars[k, : len(text)] = codes(text)
        for kind, a, b in spans:
            tags[k, a] = 1 + 2 * kind
            tags[k, a + 1 : b] = 2 + 2 * kind
    w, rng = start_weights(seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    order = np.concatenate([rng.permutation(len(samples)) for _ in range(1 + steps * batch // len(samples))])
    for step in range(1, steps + 1):
        own = order[(step - 1) * batch : step * batch]
        slopes = gradients(w, chars[own], tags[own])
        size = np.sqrt(sum(float((g**2).sum()) for g in slopes.values()))
        now = rate * (1 - 0.9 * step / steps)
        for k, g in slopes.items():
            g = g * min(1, 5 / (size + 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g**2 - second[k])
            w[k] -= (now * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


# --- labelled spans ---------------------------------------------------------------------------------------------


def labelled_spans(n: int = SAMPLES, seed: int = 0, length: int = LENGTH) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Short texts with labelled personal data, and with numbers and words that are none; the same at every call."""
    rng = random.Random(seed)
    digit = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda low, high: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high)))

    def word() -> str:
        made = "".join(rng.choice("aeiouéèäßñrstnlmdch") for _ in range(rng.randint(1, 10)))
        made = made.capitalize() if rng.random() < 0.15 else made
        return made + (rng.choice(",.;:!?") if rng.random() < 0.15 else "")

    def email() -> str:
        local = name(1, 8) + rng.choice(["", ".", "_", "-", "+"]) + rng.choice(["", name(1, 7), digit(2)])
        return (local.strip("._-+") or "a") + rng.choice(["@", "@", "@", "@", " @ ", "@ "]) + name(2, 8) + rng.choice(["", digit(1)]) + "." + rng.choice(["com", "org", "net", "de", "example.com", "co.uk", "io"])

    def ip() -> str:
        return rng.choice([".", ".", ".", ".", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))

    def card() -> str:
        body = rng.choice("3456") + digit(rng.choice([14, 14, 14, 13]))
        whole = next(body + c for c in "0123456789" if luhn(body + c))
        mark = rng.choice(["", "", " ", "-", ".", "/"])
        return mark.join(whole[k : k + 4] for k in range(0, len(whole), 4))

    def phone() -> str:
        a, b, c = digit(3), digit(3), digit(4)
        plain = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"0{digit(2)} {digit(3)} {digit(4)}", f"0{digit(3)}/{digit(7)}"])
        return rng.choice(["", "+1 ", "+49 ", "+33-", "001 ", "+1-", ""]) + plain

    def other() -> str:
        return rng.choice([
            lambda: f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
            lambda: f"{rng.randint(1, 99)}.{digit(2)}", lambda: f"version {rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", lambda: f"${digit(rng.randint(1, 4))}.{digit(2)}",
            lambda: f"{rng.randint(0, 23)}:{digit(2)}:{digit(2)}", lambda: digit(rng.randint(1, 8)), lambda: digit(rng.randint(20, 26)), lambda: f"{digit(1)},{digit(3)},{digit(3)}",
            lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(12, 40))), lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)),
            lambda: f"password={digit(3)}{name(2, 6)}{digit(4)}", lambda: f"page {digit(2)}-{digit(3)}", lambda: f"{digit(3)}x{digit(3)}", lambda: f"{rng.randint(300, 999)}.{rng.randint(0, 999)}.{rng.randint(256, 999)}.{rng.randint(0, 99)}",
            lambda: f"@{name(3, 9)}", lambda: f"{digit(2)}%", lambda: f"{digit(3)}-{digit(2)}", lambda: f"[{digit(1)}] {digit(2)}/{digit(2)}", lambda: f"{digit(1)}.", lambda: f"http://{name(3, 8)}.com/{digit(4)}",
            lambda: f"{digit(4)} {digit(4)} {digit(2)}", lambda: f"{digit(2)} + {digit(2)} = {digit(3)}",
        ])()

    out = []
    makers = (email, ip, card, phone)
    for _ in range(n):
        text, spans = rng.choice(["", " ", word()[-3:] + " "]), []
        while len(text) < length:
            kind = rng.random()
            if kind < 0.62:
                piece = word()
            elif kind < 0.82:
                piece = other()
            else:
                k = rng.randrange(4)
                piece = makers[k]()
                if len(text) + len(piece) > length:
                    break
                spans.append((k, len(text), len(text) + len(piece)))
            text += piece + rng.choice([" ", " ", " ", " ", "\n", ". ", ", "])
        out.append((text[:length], [s for s in spans if s[2] <= length]))
    return out


@lru_cache
def model(samples: int = SAMPLES, steps: int = STEPS) -> dict[str, np.ndarray]:
    return train(labelled_spans(samples), steps)


# --- decoding ---------------------------------------------------------------------------------------------------


def decode(w: dict[str, np.ndarray], chars: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
    """(kind, start, end, mean probability of its tags) of the best path of each window."""
    score = emissions(w, chars)
    mask = (chars > 0).T.astype(np.float32)
    forward, backward, whole = chain(score, w["moves"], mask)
    sure = np.exp(forward + backward - whole[None, :, None])
    steps, n, _ = score.shape
    best, back = score[0], np.zeros((steps, n, N_TAGS), np.int8)
    for t in range(1, steps):
        through = best[:, :, None] + w["moves"]
        back[t] = through.argmax(1)
        best = np.where(mask[t, :, None] > 0, through.max(1) + score[t], best)
        back[t][mask[t] == 0] = np.arange(N_TAGS)
    path = np.empty((steps, n), np.int64)
    path[-1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = back[t][np.arange(n), path[t]]
    path[mask == 0] = 0
    out: list = [[] for _ in range(n)]
    for k in np.flatnonzero((path > 0).any(0)):
        tags, t = path[:, k].tolist() + [0], 0
        while t < steps:
            if tags[t] % 2 == 1:
                end = t + 1
                while end < steps and tags[end] == tags[t] + 1:
                    end += 1
                out[k].append(((tags[t] - 1) // 2, t, end, float(sure[np.arange(t, end), k, tags[t:end]].mean())))
                t = end
            else:
                t += 1
    return out


def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an at sign."""
    starts: set[int] = set()
    for m in TRIGGER.finditer(text):
        k = m.start() // STRIDE
        starts.add(k)
        if k and m.start() < (k - 1) * STRIDE + WINDOW:
            starts.add(k - 1)
    return sorted(k * STRIDE for k in starts)


def reconciled(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Non-overlapping (kind, start, end) of the highest summed weight, probability times length; equal spans of
    several windows add up. Ties keep the earlier end."""
    weights: dict[tuple[int, int, int], float] = {}
    for kind, a, b, sure in spans:
        weights[b, a, kind] = weights.get((b, a, kind), 0) + sure * (b - a)
    ends, best = [-1], [(0.0, None, 0)]
    for b, a, kind in sorted(weights):
        low, high = 0, len(ends)
        while high - low > 1:  # the last choice that ends where this span begins, or before
            mid = (low + high) // 2
            low, high = (mid, high) if ends[mid] <= a else (low, mid)
        value = best[low][0] + weights[b, a, kind]
        ends.append(b)
        best.append((value, (kind, a, b), low) if value > best[-1][0] else (best[-1][0], None, len(best) - 1))
    out, at = [], len(best) - 1
    while at > 0:
        _, span, before = best[at]
        if span:
            out.append(span)
        at = before
    return out[::-1]


def stitched(spans: list[tuple[int, int, int, float, bool, bool]]) -> list[tuple[int, int, int, float]]:
    """Whole spans of a text from those of its windows, (kind, start, end, sure, cut on the left, cut on the right).

    A span that its window cuts goes on in the next window, if that has a span of the kind cut at its own beginning;
    their parts make one span of any length, as sure as the least of them. Cut spans that don't go on are left out.
    """
    out, open_ = [], []
    for kind, a, b, sure, left, right in spans:
        if left:
            before = next((s for s in open_ if s[0] == kind and s[1] < a <= s[2]), None)
            if before is None:
                continue
            a, sure = before[1], min(sure, before[3])
        if right:
            open_ = [s for s in open_ if s[2] >= b - WINDOW] + [(kind, a, b, sure)]
        else:
            out.append((kind, a, b, sure))
    return out


def find(texts: list, w: dict[str, np.ndarray]) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, found by the fixed patterns) of each text, sorted."""
    out, jobs, work = [], [], []
    for k, text in enumerate(texts):
        text = text or ""
        out.append([(*s, True) for s in base_spans(text)])
        starts = windows_of(text)
        if starts:
            numbers = codes(text)
            for a in starts:
                jobs.append((k, a))
                work.append(numbers[a : a + WINDOW])
    parts: dict[int, list] = {}
    for low in range(0, len(work), BATCH):
        chars = np.zeros((len(work[low : low + BATCH]), WINDOW), np.int32)
        for row, x in zip(chars, work[low : low + BATCH]):
            row[: len(x)] = x
        for (k, a), found in zip(jobs[low : low + BATCH], decode(w, chars)):
            for kind, start, end, sure in found:
                if sure >= SURE:
                    # what touches a window's edge is whole only where the text ends too
                    parts.setdefault(k, []).append((kind, a + start, a + end, sure, start == 0 and a > 0, end == WINDOW and a + WINDOW < len(texts[k])))
    spans = {k: stitched(own) for k, own in parts.items()}
    for k, found in spans.items():
        base = sorted((a, b) for _, a, b, _ in out[k])
        reach, top = [], 0
        for a, b in base:
            top = max(top, b)
            reach.append(top)
        from bisect import bisect_left

        for kind, a, b in reconciled(found):
            at = bisect_left(base, (b, -1))
            if (at == 0 or reach[at - 1] <= a) and fitting(KINDS[kind], texts[k][a:b]):
                out[k].append((kind, a, b, False))
        out[k].sort()
    return out


def find_pii(docs: DataFrame, text: str = "text", to: str = "pii", weights: dict | None = None) -> DataFrame:
    """Adds an array of (kind, start, end, fixed) to every row, sorted by kind as in ``KINDS``, then start.

    Offsets are code points, end exclusive; ``fixed`` tells a pattern's match from a span that the network adds,
    which overlaps none of them. Whole texts of any length; null and empty texts have none; rows repeat as they do
    in the input; a column of the new name is replaced. The network, of fixed size, is trained once on the driver
    from a bounded labelled sample and broadcast; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights or model())

    def work(texts: list) -> dict[str, list]:
        return {to: [[{"kind": KINDS[k], "start": a, "end": b, "fixed": fixed} for k, a, b, fixed in own] for own in find(texts, shared.value)]}

    return map_texts(docs, text, work, f"`{to}` array<struct<kind:string,start:int,end:int,fixed:boolean>>")
