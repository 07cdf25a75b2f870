"""PII: exact base spans, and a character BiLSTM with CRF transitions, in numpy, that adds spans."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Characters that a window holds, and by which neighbouring windows overlap.
WIDTH, OVERLAP = 96, 32
#: Documents whose windows train the tagger, at most.
TRAIN_DOCS = 400
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    """Matches of local@domain, from left to right; linear, as only the runs before an @ are walked."""
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL_SET:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            yield s, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, kinds as listed, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# --- the tagger -----------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
_CHARS = 130  # code points below 128, others, and the pad


def encode(texts: list[str], width: int) -> np.ndarray:
    out = np.full((len(texts), width), 129, np.uint8)
    for i, t in enumerate(texts):
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
        out[i, : len(c)] = np.minimum(c, 128)
    return out


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Characters -> embedded gates -> LSTM both ways -> emissions -> CRF."""

    def __init__(self, p: dict):
        self.p = p

    @staticmethod
    def fresh(hidden: int = 16, seed: int = 3) -> Tagger:
        r = np.random.default_rng(seed)
        p = {"x": r.normal(0, 0.3, (2, _CHARS, 4 * hidden)), "h": r.normal(0, 0.25, (2, hidden, 4 * hidden)), "o": r.normal(0, 0.2, (2 * hidden, TAGS)), "c": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS)}
        p["x"][:, :, hidden : 2 * hidden] += 1  # forget gates open
        return Tagger({k: v.astype(np.float32) for k, v in p.items()})

    def run(self, ids: np.ndarray, keep: bool = False):
        p, (n, w) = self.p, ids.shape
        hid = p["h"].shape[1]
        both = np.stack([ids, ids[:, ::-1]])  # direction, text, place
        h, c = np.zeros((2, n, hid), np.float32), np.zeros((2, n, hid), np.float32)
        hs, mem = np.empty((2, w, n, hid), np.float32), []
        for t in range(w):
            g = np.matmul(h, p["h"])
            for d in (0, 1):
                g[d] += p["x"][d][both[d, :, t]]
            s = _sigmoid(g[..., : 3 * hid])
            i, f, o = s[..., :hid], s[..., hid : 2 * hid], s[..., 2 * hid :]
            z = np.tanh(g[..., 3 * hid :])
            before, hb = c, h
            c = f * c + i * z
            tc = np.tanh(c)
            h = o * tc
            hs[:, t] = h
            if keep:
                mem.append((i, f, o, z, before, tc, hb))
        feat = np.concatenate([hs[0], hs[1][::-1]], -1)  # place, text, 2 hidden
        return feat @ p["o"] + p["c"], feat, both, mem

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window."""
        return self.best(self.run(ids)[0], np.full(len(ids), ids.shape[1]))

    def best(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tag sequence under emissions e (place, text, tag), each text's first `length` places (Viterbi)."""
        w, n, _ = e.shape
        rows = np.arange(n)
        score, back = e[0] + self.p["s"], np.empty((w, n, TAGS), np.uint8)
        last = score.argmax(1)
        for t in range(1, w):
            m = score[:, :, None] + self.p["t"]
            back[t] = m.argmax(1)
            score = m.max(1) + e[t]
            ends = lengths == t + 1
            last[ends] = score[ends].argmax(1)
        out, now = np.zeros((n, w), np.uint8), last
        for t in range(w - 1, -1, -1):
            now = np.where(t < lengths - 1, back[min(t + 1, w - 1)][rows, now], last)
            out[:, t] = now
        return out

    def step(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood a window, and its gradients."""
        p = self.p
        e, feat, both, mem = self.run(ids, keep=True)
        w, n, _ = e.shape
        hid = p["h"].shape[1]
        lse = lambda x, a: (m := x.max(a, keepdims=True)).squeeze(a) + np.log(np.exp(x - m).sum(a))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + p["s"]
        for t in range(1, w):
            alpha[t] = lse(alpha[t - 1][:, :, None] + p["t"], 1) + e[t]
        for t in range(w - 2, -1, -1):
            beta[t] = lse(p["t"] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[:, None])
        dt = np.zeros_like(p["t"])
        rows = np.arange(n)
        gold = e[0][rows, tags[:, 0]] + p["s"][tags[:, 0]]
        for t in range(1, w):
            dt += np.exp(alpha[t - 1][:, :, None] + p["t"] + (e[t] + beta[t] - z[:, None])[:, None, :]).sum(0)
            gold = gold + e[t][rows, tags[:, t]] + p["t"][tags[:, t - 1], tags[:, t]]
            np.subtract.at(dt, (tags[:, t - 1], tags[:, t]), 1)
        for t in range(w):
            de[t][rows, tags[:, t]] -= 1
        g = {"t": dt / n, "s": de[0].sum(0) / n, "c": de.sum((0, 1)) / n, "o": np.einsum("wnf,wnt->ft", feat, de) / n, "x": np.zeros_like(p["x"]), "h": np.zeros_like(p["h"])}
        df = de @ p["o"].T / n
        dh_all = np.stack([df[..., :hid], df[::-1, :, hid:]])
        dh, dc = np.zeros((2, n, hid), np.float32), np.zeros((2, n, hid), np.float32)
        for t in range(w - 1, -1, -1):
            i, f, o, zz, before, tc, hb = mem[t]
            dh = dh + dh_all[:, t]
            dc = dc + dh * o * (1 - tc**2)
            dg = np.concatenate([dc * zz * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - zz**2)], -1)
            g["h"] += np.matmul(hb.transpose(0, 2, 1), dg)
            for d in (0, 1):
                np.add.at(g["x"][d], both[d, :, t], dg[d])
            dh, dc = np.matmul(dg, p["h"].transpose(0, 2, 1)), dc * f
        return float((z - gold).mean()), g


def train(windows: list[str], spans: list[list[tuple[str, int, int]]], epochs: int = 6, batch: int = 48, rate: float = 0.02, seed: int = 3) -> Tagger:
    """Fit by Adam on texts of at most WIDTH characters with labelled spans."""
    ids = encode(windows, WIDTH)
    tags = np.zeros((len(windows), WIDTH), np.int64)
    for row, own in zip(tags, spans):
        for kind, a, b in own:
            k = 1 + 2 * KINDS.index(kind)
            row[a], row[a + 1 : b] = k, k + 1
    model, rng = Tagger.fresh(seed=seed), np.random.default_rng(seed)
    first, second, n = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    total = epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            _, g = model.step(ids[part], tags[part])
            n += 1
            norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
            for k, x in g.items():
                x = x * min(1, 5 / (norm + 1e-9))
                first[k], second[k] = 0.9 * first[k] + 0.1 * x, 0.999 * second[k] + 0.001 * x * x
                model.p[k] -= (rate * (1 - 0.9 * n / total) * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
    return model


_SYLLABLES = ["an", "the", "er", "tion", "re", "ou", "st", "en", "la", "que", "ch", "und", "ge", "ó", "é", "ß", "mo", "ra", "ti", "ble"]


def made(r: np.random.Generator) -> tuple[str | None, str]:
    """A kind and an item of it in one of several spellings; or none, and a date, price, version or other number."""
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    num = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = lambda: "".join(pick(_SYLLABLES) for _ in range(int(r.integers(1, 5))))

    def card(sep):
        d = num(int(pick([15, 15, 15, 12, 14, 17])))
        d = next(d + str(c) for c in range(10) if luhn(d + str(c)))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)) if sep else d

    kind = int(r.integers(9))
    if kind < 2:
        name = pick([word() + "." + word(), word() + num(2), word()])
        name = re.sub("[^a-z0-9.]", "x", name)
        host = re.sub("[^a-z0-9]", "x", word()) + pick(["", num(1)]) + "." + pick(["example.com", "org", "net", "co.uk"])
        return "email", pick(["{}@{}"] * 4 + ["{} @ {}", "{}@ {}"]).format(name, host)
    if kind == 2:
        return "ip", ".".join(str(r.integers(0, 256)) for _ in range(4))
    if kind == 3:
        return "card", card(pick(["", " ", "-", "-", ".", " - "]))
    if kind < 6:
        a, b, c = num(3), num(3), num(4)
        return "phone", pick(["+1 ({}) {}-{}", "+{}{} {}", "({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "+49 {} {} {}", "tel:{} {} {}"]).format(a, b, c).removeprefix("tel:")
    return None, pick([lambda: f"20{num(2)}-{num(2)}-{num(2)}", lambda: f"{num(2)}/{num(2)}/20{num(2)}", lambda: f"${num(2)}.{num(2)}", lambda: "v1." + num(1) + "." + num(1), lambda: num(int(r.integers(1, 10))), lambda: "#" + num(5), lambda: "@" + word(), lambda: num(2) + ":" + num(2), lambda: num(4) + "-" + num(4), lambda: word() + num(2), lambda: "AKIA" + num(3) + "QZ" + num(5), lambda: "=" + num(6) + "ab" + num(6)])()



def labelled(rows: int, seed: int = 11) -> tuple[list[str], list[list[tuple[str, int, int]]]]:
    """Windows with labelled spans, made from a seed: personal data in several spellings among prose, dates, prices and versions."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    word = lambda: "".join(pick(_SYLLABLES) for _ in range(int(r.integers(1, 5))))
    texts, spans = [], []
    while len(texts) < rows:
        text, own = "", []
        while len(text) < WIDTH:
            if r.random() < 0.2:
                kind, s = made(r)
                if kind and len(text) + len(s) < WIDTH:
                    own.append((kind, len(text), len(text) + len(s)))
                text += s + pick([" ", " ", ". ", ", "])
            else:
                text += word() + pick([" ", " ", " ", ", ", ".\n"])
        texts.append(text[:WIDTH])
        spans.append(own)
    return texts, spans


@lru_cache(maxsize=2)
def default_tagger(rows: int = 1500) -> Tagger:
    return train(*labelled(rows))


def _cut(seed: int, each: int):
    """Windows of real texts with labelled spans: base spans, and a made item in a spelling of labelled() in every other one."""

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base, r = base_spans(text), np.random.default_rng((seed, len(text), zlib.crc32(text.encode())))
                starts = [max(0, s[1] - int(r.integers(0, WIDTH // 2))) for s in base[:each]] + [int(r.integers(0, max(1, len(text) - WIDTH))) for _ in range(each)]
                for n, s in enumerate(starts):
                    window = text[s : s + WIDTH]
                    own = [(k, a - s, e - s) for k, a, e in base if s <= a and e <= s + WIDTH]
                    if any(a < s + WIDTH and e > s and not (s <= a and e <= s + WIDTH) for _, a, e in base):
                        continue  # a span is cut
                    if n % 2 and not own:
                        kind, item = made(r)
                        at = window.rfind(" ", 0, max(1, int(r.integers(1, WIDTH)))) + 1
                        window = window[:at] + item + " " + window[at:]
                        own = [(kind, at, at + len(item))] if kind and at + len(item) <= WIDTH else []
                        window = window[: at if kind and not own else WIDTH]
                    if window:
                        rows.append((window, ",".join(f"{k}:{a}:{e}" for k, a, e in own)))
            yield pa.record_batch([pa.array([x[i] for x in rows], pa.string()) for i in (0, 1)], names=["window", "spans"])

    return run


def fit_tagger(docs: DataFrame, documents: int = TRAIN_DOCS, each: int = 2, seed: int = 11) -> Tagger:
    """A tagger trained on windows of real texts: of the `documents` first by a hash of id and text, `each` around base spans and `each` anywhere, and as many made ones as default_tagger's.

    Null and empty texts are left out; no texts: the made windows alone.
    """
    sample = docs.where("length(text) > 0").select("text", F.xxhash64("doc_id", "text").alias("h")).orderBy("h", "text").limit(documents)
    rows = sorted((r.window, r.spans) for r in sample.select("text").mapInArrow(_cut(seed, each), "window string, spans string").collect())
    texts, spans = labelled(1500)
    for window, own in rows:
        texts.append(window)
        spans.append([(k, int(a), int(b)) for k, a, b in (s.split(":") for s in own.split(",") if s)])
    return train(texts, spans)


def _regions(text: str, reach: int = 40) -> list[tuple[int, int]]:
    """Parts of a text at most `reach` characters from a digit or @; every kind has one of these in each span."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _valid(kind: str, s: str) -> bool:
    """An exact check of what the tagger adds."""
    d = [c for c in s if c.isdigit() and c.isascii()]
    if kind == "email":
        return "@" in s and "." in s.partition("@")[2] and s.partition("@")[0].strip() != ""
    if kind == "ip":
        p = s.split(".")
        return len(p) == 4 and all(x.isdigit() and x.isascii() and len(x) <= 3 and int(x) <= 255 for x in p)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn("".join(d)) and re.fullmatch(r"[0-9 ._-]+", s) is not None
    if not re.fullmatch(r"[0-9 ().+-]+", s):
        return False
    return 9 <= len(d) <= 15 and any(c in "-. ()" for c in s) and not re.fullmatch(r"[0-9.]+\.[0-9]{1,2}", s)


def tag(model: Tagger, texts: list[str], batch: int = 512, reach: int | None = 40) -> list[list[tuple[str, int, int]]]:
    """Spans of the tagger in each text.

    Windows overlap; a place's emissions are the mean over its windows, weighed by how deep it
    lies in each, and one Viterbi pass over the whole region decides all its tags together.
    `reach`: see _regions; none: whole texts are read.
    """
    places = [(i, a, b) for i, t in enumerate(texts) for a, b in (_regions(t, reach) if reach is not None else [(0, len(t))] * bool(t))]
    cuts = []  # region, window start
    for k, (_, a, b) in enumerate(places):
        s = a
        while True:
            cuts.append((k, s))
            if s + WIDTH >= b:
                break
            s += WIDTH - OVERLAP
    sums = [np.zeros((b - a, TAGS), np.float32) for _, a, b in places]
    mass = [np.zeros((b - a, 1), np.float32) for _, a, b in places]
    depth = np.minimum(np.arange(1, WIDTH + 1), np.arange(WIDTH, 0, -1)).astype(np.float32)[:, None]
    for x in range(0, len(cuts), batch):
        part = cuts[x : x + batch]
        got = model.run(encode([texts[places[k][0]][s : min(s + WIDTH, places[k][2])] for k, s in part], WIDTH))[0]
        for n, (k, s) in enumerate(part):
            lo, hi = s - places[k][1], min(s + WIDTH, places[k][2]) - places[k][1]
            sums[k][lo:hi] += got[: hi - lo, n] * depth[: hi - lo]
            mass[k][lo:hi] += depth[: hi - lo]
    found: dict[int, np.ndarray] = {}
    by_length, at = sorted(range(len(places)), key=lambda k: len(sums[k])), 0
    while at < len(by_length):
        to = at + 1
        while to < len(by_length) and (to + 1 - at) * len(sums[by_length[to]]) <= 200_000:
            to += 1
        own = by_length[at:to]
        e = np.zeros((len(sums[own[-1]]), len(own), TAGS), np.float32)
        for n, k in enumerate(own):
            e[: len(sums[k]), n] = sums[k] / mass[k]
        tags = model.best(e, np.array([len(sums[k]) for k in own]))
        found.update((k, tags[n, : len(sums[k])]) for n, k in enumerate(own))
        at = to
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for k in sorted(found):
        (i, a, _), tags = places[k], found[k]
        j = 0
        while j < len(tags):
            if not tags[j]:
                j += 1
                continue
            kind, s = (int(tags[j]) - 1) // 2, j
            j += 1
            while j < len(tags) and tags[j] == 2 + 2 * kind:
                j += 1
            raw = texts[i][a + s : a + j]
            lead = len(raw) - len(raw.lstrip())
            body = raw.strip().rstrip(".,;")
            if body and _valid(KINDS[kind], body):
                out[i].append((KINDS[kind], a + s + lead, a + s + lead + len(body)))
    return out


def find(model: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; spans of the tagger that touch a base span, or one another, are left out."""
    out = []
    for base, more in zip(map(base_spans, texts), tag(model, texts)):
        taken = sorted((a, b) for _, a, b in base)
        added = []
        for kind, a, b in more:
            if all(b <= x or y <= a for x, y in taken) and all(b <= x or y <= a for _, x, y in added):
                added.append((kind, a, b))
        both = sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))
        out.append((base, both))
    return out


def _digest(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the one that begins first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _run(sent, write: bool):
    def run(batches):
        model = Tagger(sent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = [t or "" for t in part.column("text").to_pylist()]
                got = find(model, texts)
                cols = {n: part.column(n) for n in part.schema.names if n != "text"}
                for k in KINDS:
                    cols[f"n_{k}"] = pa.array([sum(s[0] == k for s in b) for b, _ in got], pa.int64())
                cols["base_sha256"] = pa.array([hashlib.sha256(_digest(b).encode()).hexdigest() for b, _ in got])
                cols["spans"] = pa.array([_digest(s) for _, s in got], pa.string())
                if write:
                    cols["clean"] = pa.array([None if t is None else redact(t, s) for t, (_, s) in zip(part.column("text").to_pylist(), got)], pa.string())
                yield pa.record_batch(list(cols.values()), names=list(cols))

    return run


def detect(docs: DataFrame, model: Tagger | None = None, keep: tuple = (), clean: bool = False) -> DataFrame:
    """Personal data in every whole text.

    Rows: doc_id, the columns of `keep`, n_email, n_ip, n_card, n_phone (base spans),
    base_sha256, spans (base and tagger), and clean, the text with all spans replaced, if
    asked for. Null, empty and blank texts have no spans (null stays null in clean); very long
    texts are matched in linear time and tagged in windows; repeated rows get equal rows; an
    empty table gives none; columns that are not asked for are ignored. The tagger is
    fit_tagger's of the table unless one is given, and has a fixed size.
    """
    model = model or fit_tagger(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model.p)
    kinds = dict(docs.dtypes)
    cols = ["doc_id", *[c for c in keep if c != "doc_id"]]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in cols] + [f"n_{k} long" for k in KINDS] + ["base_sha256 string", "spans string"] + ["clean string"] * clean)
    return docs.select(*cols, "text").mapInArrow(_run(sent, clean), schema)


def op6_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(common.table(spark, sf_dir, "documents"))
