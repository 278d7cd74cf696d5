"""Personal data by fixed patterns and by a linear-chain conditional random field over word shapes.

The field labels words as outside, or as the first or a further word of an email, an ip, a card or a phone. It is trained,
by gradient ascent on the likelihood, from a small labelled table, and decoded by Viterbi in numpy over batches of word
runs. Only words with a digit or an @, or made of marks alone, may get a label other than outside; all others are outside,
so that a text falls apart, without loss, into runs of words between them, and most texts need no decoding.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from trellis.llm.common import Texts, documents, pick
from trellis.llm.spans import Span, digest, holding, ordered, scanned

KINDS = ["email", "ip", "card", "phone"]
#: Words that are decoded together, with those that fill up shorter chains.
DECODED = 1 << 16

# The base patterns. A lookbehind that changes no match keeps long runs of digits linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def emails(text: str) -> list[Span]:
    """Leftmost matches of local@domain: around each @, the local part reaches back as far as it can."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and at >= end and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end, 1.0))
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    out = emails(text)
    out += [("ip", m.start(), m.end(), 1.0) for m in IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end(), 1.0))
    return out + [("phone", m.start(), m.end(), 1.0) for m in PHONE.finditer(text) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


# ---- the field

LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
OUTSIDE = 0
_ALLOWED = np.array([[not (b[0] == "I" and a[1:] != b[1:]) for b in LABELS] for a in LABELS])
_SHAPE = re.compile(r"([Xxd])\1*|.", re.S)


def admissible(word: str) -> bool:
    return any(c.isdigit() or c == "@" for c in word) or not any(c.isalnum() for c in word)


def shape(word: str, longest: int = 24) -> str:
    """A word's classes of characters, with the lengths of its runs of digits; beyond longest characters only how long it is."""
    if len(word) > longest:
        return f"long{len(word) // 16 if len(word) < 64 else 4}{'@' * ('@' in word)}"
    kinds = "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    return "".join(m[0] if m[0][0] == "d" else m[0][0] for m in _SHAPE.finditer(kinds))


def features(word: str) -> list[str]:
    s = shape(word)
    digits = sum(c.isdigit() for c in word)
    return [f"s={s}", f"c={re.sub(r'd+', 'd', s)}", f"n={min(digits, 17)}", f"dots={min(word.count('.'), 4)}", f"at={'@' in word}", f"first={s[:1]}", f"last={s[-1:]}", f"core={re.sub(r'^[^dXx@+(]+|[^dXx)]+$', '', s)}"]


def near(word: str | None, side: str) -> list[str]:
    if word is None:
        return [f"{side}=none"]
    s = shape(word)
    out = [f"{side}s={s if admissible(word) else 'w'}", f"{side}n={min(sum(c.isdigit() for c in word), 9)}"]
    return out + ([f"{side}w={word.strip('.,:;()').lower()}"] if word.strip(".,:;()").lower() in CUES else [])


CUES = {"tel", "phone", "call", "fax", "mobile", "telefon", "teléfono", "téléphone", "mail", "email", "e-mail", "card", "visa", "karte", "carte", "tarjeta", "ip", "host", "server", "version", "page", "year", "order", "invoice", "price", "in", "chapter"}


def labelled_table(n: int = 420, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: sentences of invented words with data of the four kinds and with other numbers."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(3, 8)))
    card = lambda sep: sep.join(digits(4) for _ in range(4))
    makers = {
        "email": [lambda: f"{name()}.{digits(2)}@{name()}.example.com", lambda: f"{name()}_{name()}@{name()}.org", lambda: f"{name()}+{name()}@{name()}.co.uk", lambda: f"{name()}@{name()}.net"],
        "ip": [lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)) + f":{r.choice([80, 443, 8080])}"],
        "card": [lambda: card(" "), lambda: card("-"), lambda: digits(16), lambda: f"{digits(4)} {digits(6)} {digits(5)}"],
        "phone": [lambda: f"+{r.randint(1, 9)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"+{digits(2)} {digits(3)} {digits(7)}", lambda: f"+{digits(2)}-{digits(4)}-{digits(6)}"],
    }
    others = [lambda: str(r.randint(1900, 2030)), lambda: digits(r.randint(1, 3)), lambda: f"{digits(2)}.{digits(2)}.{r.randint(1990, 2030)}", lambda: f"{r.randint(1990, 2030)}-{digits(2)}-{digits(2)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"${digits(3)}.{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f"{digits(2)}%", lambda: digits(r.randint(5, 9)), lambda: f"A{digits(5)}-{digits(2)}", lambda: "-", lambda: "|", lambda: "$$$", lambda: f"{digits(1)}/{digits(1)}", lambda: f"{digits(3)} {digits(3)}", lambda: f"{digits(4)} {digits(2)} {digits(2)}", lambda: f"{digits(3)}-{digits(2)}", lambda: f"@{name()}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 16, 32, 40])))]
    table = []
    for _ in range(n):
        words: list[str] = []
        tags: list[str] = []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(1, 4)):
                words.append(r.choice(sorted(CUES)) if r.random() < 0.15 else name())
                tags.append("O")
            if r.random() < 0.5:
                new = r.choice(others)().split(" ")
                tags += ["O"] * len(new)
            else:
                kind = r.choice(KINDS)
                new = r.choice(makers[kind])().split(" ")
                tags += [f"B-{kind}", *[f"I-{kind}"] * (len(new) - 1)]
            if r.random() < 0.25:
                new[-1] += r.choice([".", ",", ";"])
            words += new
        if r.random() < 0.7:
            words.append(name())
            tags.append("O")
        table.append((words, tags))
    return table


def runs(words: list[str]) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of admissible words that have a digit or an @ somewhere."""
    out, a = [], None
    for i, w in enumerate([*words, "x"]):
        if i < len(words) and admissible(w):
            a = i if a is None else a
        elif a is not None:
            if any(c.isdigit() or c == "@" for w in words[a:i] for c in w):
                out.append((a, i))
            a = None
    return out


class Field:
    """Weights of the features and of the transitions; a run of words begins and ends beside outside words."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray) -> None:
        self.index, self.emit, self.move = index, emit, move

    def rows(self, words: list[str], a: int, b: int) -> list[list[int]]:
        side = lambda i, s: near(words[i] if 0 <= i < len(words) else None, s)
        return [[self.index[f] for f in [*features(words[i]), *side(i - 1, "<"), *side(i + 1, ">")] if f in self.index] for i in range(a, b)]

    def scores(self, chains: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(c) for c in chains])
        out = np.zeros((len(chains), lengths.max(initial=0), len(LABELS)))
        for i, c in enumerate(chains):
            for t, f in enumerate(c):
                out[i, t] = self.emit[f].sum(0)
        return out, lengths

    def decode(self, chains: list[list[list[int]]]) -> list[list[int]]:
        """The best labels of each chain, chains of similar lengths together: at most DECODED words with their padding, or one chain."""
        move = np.where(_ALLOWED, self.move, -1e9)
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        out: list[list[int]] = [[] for _ in chains]
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * len(chains[order[to]]) <= DECODED:
                to += 1
            part, at = order[at:to], to
            scores, lengths = self.scores([chains[i] for i in part])
            best, back = scores[:, 0] + move[OUTSIDE], []
            finals = np.where((lengths == 1)[:, None], best, -np.inf)
            for t in range(1, scores.shape[1]):
                paths = best[:, :, None] + move
                back.append(paths.argmax(1).astype(np.int8))
                best = paths.max(1) + scores[:, t]
                finals[lengths == t + 1] = best[lengths == t + 1]
            last = (finals + move[:, OUTSIDE]).argmax(1)
            for j, i in enumerate(part):
                labels = [int(last[j])]
                for t in range(lengths[j] - 2, -1, -1):
                    labels.append(int(back[t][j, labels[-1]]))
                out[i] = labels[::-1]
        return out


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def train(table: list[tuple[list[str], list[str]]], steps: int = 120, rate: float = 0.15, decay: float = 2e-3) -> Field:
    """Maximum likelihood of the labels of a table of sentences, by forward-backward and Adam, with squared weights held down."""
    field = Field({}, np.zeros((0, len(LABELS))), np.zeros((len(LABELS), len(LABELS))))
    chains, golds = [], []
    for words, tags in table:
        for a, b in runs(words):
            side = lambda i, s, words=words: near(words[i] if 0 <= i < len(words) else None, s)
            chains.append([[field.index.setdefault(f, len(field.index)) for f in [*features(words[i]), *side(i - 1, "<"), *side(i + 1, ">")]] for i in range(a, b)])
            golds.append([LABELS.index(t) for t in tags[a:b]])
    field.emit = np.zeros((len(field.index), len(LABELS)))
    n, k, longest = len(chains), len(LABELS), max(map(len, chains))
    lengths = np.array([len(c) for c in chains])
    places = [(i, t, f) for i, c in enumerate(chains) for t, fs in enumerate(c) for f in fs]
    pi, pt, pf = (np.array(x) for x in zip(*places, strict=True))
    gold = np.zeros((n, longest, k))
    gold_move = np.zeros((k, k))
    for i, g in enumerate(golds):
        gold[i, range(len(g)), g] = 1
        for a, b in zip([OUTSIDE, *g], [*g, OUTSIDE], strict=True):
            gold_move[a, b] += 1
    live = np.arange(longest)[None, :] < lengths[:, None]
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (field.emit, field.move)]
    for step in range(1, steps + 1):
        scores = np.zeros((n, longest, k))
        np.add.at(scores, (pi, pt), field.emit[pf])
        move = np.where(_ALLOWED, field.move, -1e9)
        alpha = np.empty_like(scores)
        alpha[:, 0] = scores[:, 0] + move[OUTSIDE]
        for t in range(1, longest):
            alpha[:, t] = np.where(live[:, t, None], _sum_exp(alpha[:, t - 1, :, None] + move, 1) + scores[:, t], alpha[:, t - 1])
        total = _sum_exp(alpha[:, -1] + move[:, OUTSIDE], 1)
        beta = np.empty_like(scores)
        beta[:, -1] = move[:, OUTSIDE]
        pair = np.zeros((k, k))
        for t in range(longest - 2, -1, -1):
            ahead = beta[:, t + 1] + scores[:, t + 1]
            on = live[:, t + 1]
            beta[:, t] = np.where(on[:, None], _sum_exp(move[None] + ahead[:, None, :], 2), beta[:, t + 1])
            pair += np.exp(alpha[:, t, :, None] + move + ahead[:, None, :] - total[:, None, None])[on].sum(0)
        seen = np.exp(alpha + beta - total[:, None, None]) * live[:, :, None]
        pair[OUTSIDE] += seen[:, 0].sum(0)
        pair[:, OUTSIDE] += seen[np.arange(n), lengths - 1].sum(0)
        slope = np.zeros_like(field.emit)
        np.add.at(slope, pf, (gold - seen)[pi, pt])
        for w, g, (m, v) in zip((field.emit, field.move), (slope / n - decay * field.emit, (gold_move - pair) / n - decay * field.move), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return field


#: What the words of a kind must be like, all together, for a labelled run to count.
CHECKS = {
    "email": lambda s: s.count("@") == 1 and "." in s.split("@")[1].strip(".") and s.split("@")[0] != "",
    "ip": lambda s: bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?", s)),
    "card": lambda s: 13 <= sum(c.isdigit() for c in s) <= 19 and not any(c.isalpha() for c in s),
    "phone": lambda s: 9 <= sum(c.isdigit() for c in s) <= 15 and bool(re.search(r"[()+ -]", s)) and not any(c.isalpha() for c in s),
}


def scan(field: Field, texts: list[str]) -> list[list[Span]]:
    """The base spans of each text, and the field's that overlap none of them."""
    chains, homes, words_of = [], [], []
    for i, text in enumerate(texts):
        at = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b] for a, b in at]
        words_of.append(at)
        for a, b in runs(words):
            chains.append(field.rows(words, a, b))
            homes.append((i, a))
    found: list[list[Span]] = [[] for _ in texts]
    for (i, a), labels in zip(homes, field.decode(chains) if chains else [], strict=True):
        t = 0
        while t < len(labels):
            if LABELS[labels[t]][0] == "B":
                kind, to = LABELS[labels[t]][2:], t + 1
                while to < len(labels) and LABELS[labels[to]] == f"I-{kind}":
                    to += 1
                start, end = words_of[i][a + t][0], words_of[i][a + to - 1][1]
                while end > start and not (texts[i][end - 1].isalnum() or texts[i][end - 1] == ")"):
                    end -= 1
                while start < end and not (texts[i][start].isalnum() or texts[i][start] in "(+"):
                    start += 1
                if CHECKS[kind](texts[i][start:end]):
                    found[i].append((kind, start, end, 0.9))
                t = to
            else:
                t += 1
    return [ordered([*base, *apart(spans, base)], KINDS) for spans, base in zip(found, map(base_spans, texts), strict=True)]


def apart(spans: list[Span], base: list[Span]) -> list[Span]:
    """The spans that overlap none of base: those that end before the next one of base begins, and begin behind all before it."""
    base = sorted(base, key=lambda s: s[1])
    starts, ends = [a for _, a, _, _ in base], list(accumulate((b for _, _, b, _ in base), max))
    # base spans that begin before a span's end are the first k; the farthest end of these tells
    return [s for s in spans if not (k := bisect_left(starts, s[2])) or ends[k - 1] <= s[1]]


_MARKS = np.isin(np.arange(256), np.frombuffer(b"0123456789@", np.uint8))


def candidates(texts: Texts) -> np.ndarray:
    return holding(texts, np.flatnonzero(_MARKS[texts.data]))


def find_pii(docs: DataFrame, table: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """(doc_id, found): for each row the spans of personal data, by start and then kind; the score of a base span is 1.

    Null and empty texts have none; a null doc_id stays null; repeated rows are scanned one by one; texts are scanned
    whole, whatever their length. An empty table gives no rows. Other columns are not read. Where spans of the field
    overlap base spans, the base spans stay alone.
    """
    field = train(labelled_table() if table is None else table)
    return scanned(docs, candidates, lambda texts: scan(field, texts))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(pick(documents(spark, sf_dir), "doc_id", "text")), KINDS)
