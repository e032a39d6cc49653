"""Personal data: fixed patterns, and spans added by a character BiLSTM with CRF transitions.

The base finds emails, IP addresses, card and phone numbers by patterns, leftmost and non-overlapping per kind, and
drops matches that fail their check. A bidirectional LSTM over characters with a linear-chain CRF, written and trained in
numpy, adds spans of the same kinds that the patterns miss (a phone number without its plus, an address written with
"(at)"). It is trained on labelled spans: windows of a bounded sample of the documents labelled by the base, and
generated windows of written-out variants and of look-alikes (dates, amounts, versions, codes).

Where a text holds a digit of any script, an at sign, a bracketed "at", or "at" or "dot" between blanks, overlapping windows
cover it with its surroundings; numbers in words and other ways to write an at sign get no window. The network reads all
scripts' digits and full-width ASCII as ASCII. Windows are decoded by Viterbi and
reconciled over the whole text: each character takes the tag of the window in which it stands farthest from an edge.
An added span must pass its kind's check and not overlap a base span; base spans always stay.

Defined results: null and empty texts have no spans. Positions are code points, ends exclusive. Very long texts are
windowed like others. Repeated rows are judged one by one; without documents the model is trained on generated windows
alone. Empty tables give empty results; other columns never clash.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import appended, with_row, without_row

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 400  # documents with a digit or an at sign that give labelled windows, about
WINDOW, STRIDE, AROUND = 64, 32, 24
BATCH = 256

# The base patterns. Emails are found from their at signs, which gives the pattern's leftmost matches.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"\d|[@＠]|[(\[{] ?at ?[)\]}]|(?<=\s)(?:at|dot)(?=\s)", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small_parts(parts: list[str]) -> bool:
    return all(p and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def emails(text: str) -> Iterator[tuple[int, int]]:
    before, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > before and text[first - 1] in LOCAL:
            first -= 1
        found = DOMAIN.match(text, at) if first < at else None
        if found:
            before = found.end()
            yield first, before
        at = text.find("@", max(at + 1, before))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches that pass their check, by start and kind."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if small_parts(m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = digits_of(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return ordered(out)


def ordered(spans):
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# Characters and tags

_SIGNS = ".-+()@_%,:;/!?\"'#$&*=<>[]{}|~^`\\"
_CLASS = {c: 8 + i for i, c in enumerate(_SIGNS)}
SAID_AT, LOUD_AT, SAID_DOT = range(8 + len(_SIGNS), 11 + len(_SIGNS))  # letters of these words as emails are spoken
CLASSES = 11 + len(_SIGNS)
_SAID = re.compile(r"(?<=\s)(?:(?P<loud>(?-i:AT))(?=\s+[\w-]+(?:(?P<point>\.)|\s+dot\s+)\w)|(?P<at>at)(?=\s+[\w-]+\s+dot\s+\w)|(?P<dot>dot)(?=\s))", re.IGNORECASE)
PAD, DIGIT, SMALL, LARGE, BLANK, LINE, OTHER, BEYOND = range(8)
TAGS = 1 + 2 * len(KINDS)  # outside, then first and inner of each kind


def classes(text: str) -> np.ndarray:
    text = plain(text)
    out = np.array([_class(c) for c in text], np.int32)
    for m in _SAID.finditer(text):
        out[m.start() : m.end()] = LOUD_AT if m["loud"] else SAID_AT if m["at"] else SAID_DOT
        if m["point"]:
            out[m.start("point")] = SAID_DOT
    return out


def plain(text: str) -> str:
    """The text with every script's digits and full-width ASCII as ASCII, character by character."""
    return text if text.isascii() else "".join(map(_plain, text))


def _plain(c: str) -> str:
    if "\uff01" <= c <= "\uff5e":
        return chr(ord(c) - 0xFEE0)
    return str(unicodedata.decimal(c)) if c.isdecimal() else c


def _class(c: str) -> int:
    if "0" <= c <= "9":
        return DIGIT
    if "a" <= c <= "z":
        return SMALL
    if "A" <= c <= "Z":
        return LARGE
    if c == " ":
        return BLANK
    if c in "\n\r\t":
        return LINE
    return _CLASS.get(c, OTHER if c < "\x80" else BEYOND)


def tags_of(length: int, spans) -> np.ndarray:
    out = np.zeros(length, np.int32)
    for kind, a, b in spans:
        tag = 1 + 2 * KINDS.index(kind)
        out[a:b] = tag + 1
        out[a] = tag
    return out


def spans_of(tags: np.ndarray) -> list[tuple[str, int, int]]:
    out, start = [], None
    for i, tag in enumerate([*tags.tolist(), 0]):
        if start is not None and (tag == 0 or tag % 2 or tag != inner):
            out.append((KINDS[(inner - 1) // 2], start, i))
            start = None
        if tag and start is None:
            start, inner = i, tag + tag % 2
    return out


class Tagger:
    """The network: embeddings, an LSTM each way, emissions, and CRF transitions."""

    def __init__(self, seed: int = 7, width: int = 12, hidden: int = 16):
        draw = np.random.default_rng(seed)
        self.hidden = hidden

        def matrix(*shape):
            return (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"embed": matrix(CLASSES, width), "out": matrix(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32)}
        # Both directions side by side: the second reads the text from its end.
        self.p |= {"x": np.stack([matrix(width, 4 * hidden) for _ in "fb"]), "h": np.stack([matrix(hidden, 4 * hidden) for _ in "fb"])}
        self.p["g"] = np.zeros((2, 1, 4 * hidden), np.float32)
        self.p["g"][:, :, hidden : 2 * hidden] = 1.0
        self.p["move"] = np.zeros((TAGS, TAGS), np.float32)
        self.p["first"] = np.zeros(TAGS, np.float32)

    def _lstm(self, x, keep):
        """Hidden states of (direction, window, step); the gates are three sigmoids and a tanh, by one tanh."""
        ways, size, steps, _ = x.shape
        n = self.hidden
        half = np.concatenate([np.full(3 * n, 0.5, np.float32), np.ones(n, np.float32)])
        # Products stay small, one a step: large ones would start threads of their own in every task.
        pre = np.ascontiguousarray(x.transpose(2, 0, 1, 3)) @ (self.p["x"] * half) + self.p["g"] * half
        weights = self.p["h"] * half
        h, c = np.zeros((ways, size, n), x.dtype), np.zeros((ways, size, n), x.dtype)
        out = np.empty((steps, ways, size, n), x.dtype)
        saved = []
        for t in range(steps):
            bent = np.tanh(pre[t] + h @ weights)
            gates, new = bent[..., : 3 * n] * 0.5 + 0.5, bent[..., 3 * n :]
            before, hidden = c, h
            c = gates[..., n : 2 * n] * c + gates[..., :n] * new
            cell = np.tanh(c)
            h = gates[..., 2 * n :] * cell
            out[t] = h
            if keep:
                saved.append((hidden, before, gates, new, cell))
        return out.transpose(1, 2, 0, 3), saved

    def _lstm_back(self, x, saved, grad, out):
        n, turned = self.hidden, self.p["h"].transpose(0, 2, 1)
        ways, size, steps, _ = x.shape
        grad = np.ascontiguousarray(grad.transpose(2, 0, 1, 3))
        dh, dc = np.zeros((ways, size, n), x.dtype), np.zeros((ways, size, n), x.dtype)
        dz_all = np.empty((steps, ways, size, 4 * n), x.dtype)
        for t in range(steps - 1, -1, -1):
            hidden, before, gates, new, cell = saved[t]
            i, f, o = gates[..., :n], gates[..., n : 2 * n], gates[..., 2 * n :]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - cell * cell)
            dz = dz_all[t]
            dz[..., :n] = dc * new
            dz[..., n : 2 * n] = dc * before
            dz[..., 2 * n : 3 * n] = dh * cell
            dz[..., : 3 * n] *= gates * (1 - gates)
            dz[..., 3 * n :] = dc * i * (1 - new * new)
            out["h"] += hidden.transpose(0, 2, 1) @ dz
            dh, dc = dz @ turned, dc * f
        steps_first = np.ascontiguousarray(x.transpose(2, 0, 3, 1))
        out["x"] += (steps_first @ dz_all).sum(0)
        out["g"] += dz_all.sum((0, 2))[:, None]
        return (dz_all @ self.p["x"].transpose(0, 2, 1)).transpose(1, 2, 0, 3)

    def emissions(self, ids: np.ndarray, keep: bool = False):
        x = self.p["embed"][ids]
        x = np.stack([x, x[:, ::-1]])
        hidden, saved = self._lstm(x, keep)
        both = np.concatenate([hidden[0], hidden[1][:, ::-1]], axis=2)
        return both @ self.p["out"] + self.p["bias"], (x, both, saved)

    def step(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """The mean negative log likelihood and its gradients."""
        scores, (x, both, saved) = self.emissions(ids, True)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        size, steps, _ = scores.shape
        move = self.p["move"]
        alpha = np.empty_like(scores)
        alpha[:, 0] = scores[:, 0] + self.p["first"]
        for t in range(1, steps):
            alpha[:, t] = scores[:, t] + _logsum(alpha[:, t - 1, :, None] + move, 1)
        total = _logsum(alpha[:, -1], 1)
        beta = np.zeros((size, scores.shape[2]), np.float32)
        share = np.empty_like(scores)
        for t in range(steps - 1, -1, -1):
            share[:, t] = np.exp(alpha[:, t] + beta - total[:, None])
            if t:
                right = scores[:, t] + beta
                pair = np.exp(alpha[:, t - 1, :, None] + move + right[:, None, :] - total[:, None, None])
                grad["move"] += pair.sum(0)
                beta = _logsum(move + right[:, None, :], 2)
        rows, places = np.arange(size)[:, None], np.arange(steps)[None]
        gold = scores[rows, places, tags].sum(1) + self.p["first"][tags[:, 0]] + move[tags[:, :-1], tags[:, 1:]].sum(1)
        share[rows, places, tags] -= 1
        np.add.at(grad["move"], (tags[:, :-1], tags[:, 1:]), -1)
        grad["first"] += share[:, 0].sum(0)
        share /= size
        grad["move"] /= size
        grad["first"] /= size
        grad["out"] += (both.transpose(0, 2, 1) @ share).sum(0)
        grad["bias"] += share.sum((0, 1))
        back = share @ self.p["out"].T
        dx = self._lstm_back(x, saved, np.stack([back[..., : self.hidden], back[:, ::-1, self.hidden :]]), grad)
        dx = dx[0] + dx[1][:, ::-1]
        np.add.at(grad["embed"], ids, dx)
        return float((total - gold).mean()), grad

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tags of each window."""
        scores, _ = self.emissions(ids)
        size, steps, _ = scores.shape
        best = scores[:, 0] + self.p["first"]
        came = np.empty((steps, size, scores.shape[2]), np.int8)
        for t in range(1, steps):
            every = best[:, :, None] + self.p["move"]
            came[t] = every.argmax(1)
            best = every.max(1) + scores[:, t]
        out = np.empty((size, steps), np.int32)
        out[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = came[t][np.arange(size), out[:, t]]
        return out


def _logsum(x, axis):
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def train(windows: list[tuple[np.ndarray, np.ndarray]], steps: int = 250, batch: int = 48, rate: float = 0.02, seed: int = 7) -> Tagger:
    """A tagger from windows of classes with their tags, by Adam."""
    tagger, draw = Tagger(seed), np.random.default_rng(seed)
    ids, tags = np.stack([w for w, _ in windows]), np.stack([t for _, t in windows])
    mean = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    square = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    for n in range(1, steps + 1):
        pick = draw.integers(0, len(ids), batch)
        _, grad = tagger.step(ids[pick], tags[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        now = rate * (1 - 0.9 * n / steps)
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (norm + 1e-6))
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.98 * square[k] + 0.02 * g * g
            tagger.p[k] -= now * (mean[k] / (1 - 0.9**n)) / (np.sqrt(square[k] / (1 - 0.98**n)) + 1e-6)
    return tagger


# Windows

def places_of(text: str) -> list[int]:
    """Starts of the overlapping windows that cover the surroundings of every sign of personal data."""
    out, end = [], -1
    for m in SIGN.finditer(text):
        low = max(0, m.start() - AROUND)
        if not out or low > end:
            out.append(low)
            end = low + WINDOW - AROUND
        while m.end() + AROUND > out[-1] + WINDOW and out[-1] + WINDOW < len(text):
            out.append(out[-1] + STRIDE)
        end = out[-1] + WINDOW - AROUND
    return out


def window_at(text: str, at: int) -> np.ndarray:
    ids = classes(text[at : at + WINDOW])
    return np.pad(ids, (0, WINDOW - len(ids)))


def labelled_windows(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for text in texts:
        spans = base_spans(text)
        for at in places_of(text):
            inside = [(k, max(a, at) - at, min(b, at + WINDOW) - at) for k, a, b in spans if a < at + WINDOW and b > at]
            out.append((window_at(text, at), tags_of(WINDOW, inside)))
    return out


def generated_windows(count: int, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Written-out and unusual variants with their spans, and look-alikes without."""
    draw = random.Random(seed)

    def digits(n):
        return "".join(draw.choice("0123456789") for _ in range(n))

    def word(low=2, high=9):
        return "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(low, high)))

    def card():
        body = digits(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        gap = draw.choice(["", " ", "-", ".", "  ", "/"])
        return gap.join(body[i : i + 4] for i in range(0, 16, 4))

    def email():
        at = draw.choice(["@", " @ ", "(at)", "[at]", " (at) ", " [at] ", " at ", " at ", " at ", " AT ", " AT ", " AT "])
        if at in (" at ", " AT "):  # without brackets, and mostly without digits
            dot = draw.choice([" dot ", ".", " DOT "]) if at == " AT " else " dot "
            local = word() + draw.choice(["", "", digits(2), f" dot {word()}" if dot != "." else f".{word()}"])
            return f"{local}{at}{word()}{dot}{draw.choice(['com', 'org', 'net', 'de'])}"
        dot = "." if "@" in at else draw.choice([".", ".", ".", "(dot)", "[dot]", " [dot] "])
        return f"{word()}{draw.choice(['.', '_', ''])}{digits(2)}{at}{word()}{dot}{draw.choice(['com', 'org', 'net', 'de'])}"

    def phone():
        area, a, b = digits(3), digits(3), digits(4)
        return draw.choice([f"+1 ({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"+1-{area}-{a}-{b}", f"+49 {area} {a}{b}", f"001 {area} {a} {b}"])

    def ip():
        gap = draw.choice([".", ".", " . ", "[.]"])
        return gap.join(str(draw.randint(1, 255)) for _ in range(4))

    lookalikes = (
        lambda: f"{draw.randint(1900, 2030)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}.{digits(2)}.{digits(4)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}",
        lambda: f"${digits(3)},{digits(3)}.{digits(2)}", lambda: f'"{digits(3)}{word()}{digits(4)}{word()}{digits(3)}"', lambda: digits(draw.randint(1, 9)),
        lambda: f"{digits(4)}-{digits(4)}", lambda: f"@{word()}", lambda: f"{word()}@{word()}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{word()}{digits(2)}",
        lambda: f"{word()} at {word()}", lambda: f"{word()} at {word()}. {word()} dot {word()}", lambda: f"{word()} dot {word()}",
        lambda: f"{word()} at {word()}.com", lambda: f"{word()} at {digits(2)}:{digits(2)}", lambda: f"{word()} AT {word()}",
    )
    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(count):
        before = " ".join(word() for _ in range(draw.randint(0, 5))) + draw.choice([" ", ": ", "\n", ""])
        kind = draw.choice([*KINDS, None, None])
        value = makers[kind]() if kind else draw.choice(lookalikes)()
        before = before[:30]
        if before and before[-1] not in " \n":
            before += " "
        text = before + value + draw.choice([" ", ". ", ", ", "\n", "!! "]) + " ".join(word() for _ in range(8))
        spans = [(kind, len(before), min(len(before) + len(value), WINDOW))] if kind else []
        out.append((window_at(text, 0), tags_of(WINDOW, spans)))
    return out


def reconciled(length: int, places: list[int], tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of a text from its windows' tags: the window in which a character is farthest from an edge decides."""
    out, at = [], 0
    while at < len(places):
        end = at + 1
        while end < len(places) and places[end] < places[end - 1] + WINDOW:
            end += 1
        low, high = places[at], min(places[end - 1] + WINDOW, length)
        whole = np.zeros(high - low, np.int32)
        depth = np.full(high - low, -1, np.int32)
        edge = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
        for n in range(at, end):
            first = places[n] - low
            size = min(WINDOW, high - places[n])
            # The text's own ends aren't edges.
            mine = edge[:size] if places[n] and places[n] + WINDOW < length else np.maximum(edge[:size], WINDOW // 2 if size < WINDOW else 0)
            better = mine > depth[first : first + size]
            whole[first : first + size][better] = tags[n, :size][better]
            depth[first : first + size][better] = mine[better]
        out += [(k, a + low, b + low) for k, a, b in spans_of(whole)]
        at = end
    return out


_AT = re.compile(r"@|[(\[{] ?at ?[)\]}]", re.IGNORECASE)
_DOT = r"(?:\.|\s+dot\s+)"
_WRITTEN = re.compile(rf"[\w%+-]+(?:{_DOT}[\w%+-]+)*\s+at\s+[\w-]+(?:{_DOT}[\w-]+)+", re.IGNORECASE)


def checked(kind: str, value: str) -> bool:
    value = plain(value)
    digits = digits_of(value)
    if kind == "email":
        if not _AT.search(value):
            return _WRITTEN.fullmatch(value) is not None
        return len(_AT.findall(value)) == 1 and re.search(r"\.|dot", value, re.IGNORECASE) is not None and len(value) >= 6
    if kind == "ip":
        return small_parts(re.findall("[0-9]+", value)) and len(re.findall("[0-9]+", value)) == 4 and not re.search("[A-Za-z]", value)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and not re.search("[A-Za-z]", value)
    return 10 <= len(digits) <= 15 and not re.search("[A-Za-z]", value) and re.search(r"[()+ -]", value) is not None


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in " \n\t,;:!?\"'":
        a += 1
    while b > a and text[b - 1] in " \n\t,;:!?\"'.":
        b -= 1
    return a, b


def added_spans(tagger: Tagger, texts: list[str], bases: list[list]) -> list[list[tuple[str, int, int]]]:
    """What the network adds to each text's base spans."""
    places = [places_of(t) for t in texts]
    jobs = [(i, at) for i, own in enumerate(places) for at in own]
    tags: list[list[np.ndarray]] = [[] for _ in texts]
    for low in range(0, len(jobs), BATCH):
        part = jobs[low : low + BATCH]
        found = tagger.decode(np.stack([window_at(texts[i], at) for i, at in part]))
        for (i, _), row in zip(part, found, strict=True):
            tags[i].append(row)
    out = []
    for text, own, rows, base in zip(texts, places, tags, bases, strict=True):
        new = []
        for kind, a, b in reconciled(len(text), own, np.array(rows)) if own else []:
            a, b = trimmed(text, a, b)
            if a < b and not any(x < b and a < y for _, x, y in base) and checked(kind, text[a:b]):
                new.append((kind, a, b))
        out.append(new)
    return out


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Tagger:
    """A tagger from about ``rows`` documents (doc_id, text) that hold a digit or an at sign, and generated windows."""
    usable = docs.filter(F.col("text").rlike("[0-9@]"))
    total = usable.count()
    share = min(1.0, rows / max(total, 1))
    place = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def cut(batches):
        # Only the windows travel, at most 40 a document.
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for ids, tags in labelled_windows([text])[:40]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids.astype("u1").tobytes()]), pa.array([tags.astype("u1").tobytes()])], ["ids", "tags"]
                    )

    found = usable.filter(place < share).select("text").mapInArrow(cut, "ids binary, tags binary").distinct().sort("ids", "tags")
    real = [(np.frombuffer(bytes(r.ids), "u1").astype(np.int32), np.frombuffer(bytes(r.tags), "u1").astype(np.int32)) for r in found.collect()]
    return train(generated_windows(max(1_500, len(real))) + real)


def found(frame: DataFrame, tagger: Tagger) -> DataFrame:
    """``frame`` (with ``text``) with base and spans: arrays of kind, start, end."""
    shared = frame.sparkSession.sparkContext.broadcast(tagger)
    span = "array<struct<kind: string, start: int, end: int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        own = shared.value

        def columns(batch):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            bases = [base_spans(t) for t in texts]
            every = [ordered(b + n) for b, n in zip(bases, added_spans(own, texts, bases), strict=True)]
            named = lambda rows: pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in r] for r in rows], kind)
            return [named(bases), named(every)]

        return columns

    return appended(frame, make, f"base {span}, spans {span}")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, the number of base spans by kind, base_sha256, spans (all)."""
    frame = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = found(frame, learn(frame, rows))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


def masked(text: str, spans) -> str:
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if span["end"] <= at:
            continue
        out += [text[at : max(at, span["start"])], f"[{span['kind']}]"]
        at = span["end"]
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents with all their columns, each span replaced by its kind in brackets; null stays null."""
    plain = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = found(with_row(docs, text=text_col), learn(plain, rows))

    def make():
        def columns(batch):
            pairs = zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)
            return [pa.array([masked(t, s) if s else t for t, s in pairs], pa.string())]

        return columns

    out = appended(out, make, "masked string").drop("text").withColumnRenamed("masked", "text")
    return without_row(out, docs.columns, text=text_col)
