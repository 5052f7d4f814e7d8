"""Personal data by patterns and a skip-chain conditional random field.

The patterns give base spans.  The field adds spans, of people's names too.  Its nodes are the base spans, word by word, the words with a
digit or an at sign, and every word that is similar to a node, directly or over other words; a word that is
similar to none is outside by definition.  Neighbouring nodes share a chain potential (beside words that are no
nodes it is part of the node's own features), and occurrences of the same or a similar word (case, outer punctuation, digits
alone, the name before an at sign and its parts), however far apart, share skip potentials: each occurrence is tied to the next
one and all to one of them, a certain one if there is one, so links grow with the text and not with its square and two links
lead anywhere.  Loopy sum-product passes over both kinds of links, until the messages settle, carry the label of a certain
mention to uncertain ones.  Words inside base spans are observed.  The weights are trained here, by
pseudo-likelihood on generated labelled sentences.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .spans import detect, has_any, redact

KINDS = ("email", "ip", "card", "phone", "name")
BASE_KINDS = KINDS[:4]
LABELS = ("outside", *KINDS)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
OUTER = ".,;:!?\"'()[]{}<>"
DIGIT = re.compile(r"[0-9]")
#: Words that announce an entity.
CUES = {"mail": 1, "email": 1, "write": 1, "ip": 2, "host": 2, "server": 2, "card": 3, "visa": 3, "pay": 3, "phone": 4, "call": 4, "tel": 4, "dial": 4}
FEATURES = (
    "bias", "at", "dots3", "digits_only", "d1_4", "d5_8", "d9_11", "d12_19", "d20", "letters", "equals", "slash", "plus", "paren", "dash", "cue1", "cue2", "cue3", "cue4", "dot", "tied", "tied_certain",
    "digit", "capital", "sentence", "lower", "alone", "capital_sentence", "lower_plain", "left_out", "right_out",
)
#: Rounds of messages at most; they end as soon as no message moves by SETTLED.
PASSES, SETTLED = 400, 1e-4
OBSERVED = 12.0


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += 2 * int(d) - (9 if d > "4" else 0)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, int]]:
    """Leftmost non-overlapping addresses, found from the at signs: linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in LOCAL_CHARS:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            done = m.end()
            out.append((s, 0, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches that pass their checks."""
    out = _emails(text) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdecimal, m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return out


SPLIT = re.compile(r"[._%+-]+")


def _keys(core: str) -> list[str]:
    """What makes two words similar: the lower-cased core, its digits, the name of an address, and the parts of a name or plain word."""
    low = core.lower()
    found = [low] if len(low) >= 3 else []
    digits = "".join(c for c in low if "0" <= c <= "9")
    if len(digits) >= 4:
        found.append("#" + digits[-10:])
    name, at, _ = low.partition("@")
    if at and len(name) >= 3:
        found.append(name)
    if at or not digits:
        found += [x for part in SPLIT.split(name) if len(x := part.strip("0123456789")) >= 3]
    return list(dict.fromkeys(found))


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str, int, bool, bool]]:
    """(start, end, core, word before, observed label, whether plain words stand before and after) of the field's nodes in text order.

    A word that base spans touch gives a node for each of them."""
    base = sorted(base)
    found, plain = [], []  # (word number, start, end, core, label)
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    j = 0
    for w, (s, e) in enumerate(words):
        while j < len(base) and base[j][2] <= s:
            j += 1
        i, own = j, []
        while i < len(base) and base[i][0] < e:
            if base[i][2] > s:
                own.append((w, max(s, base[i][0]), min(e, base[i][2]), base[i][1] + 1))
            i += 1
        if own:
            found += [(w, a, b, text[a:b], k) for w, a, b, k in own]
            continue
        word = text[s:e]
        core = word.strip(OUTER)
        if core:
            a = s + word.index(core)
            (found if "@" in core or DIGIT.search(core) else plain).append((w, a, a + len(core), core, 0))
    known = {k for f in found for k in _keys(f[3]) if k[0] != "#"}
    while known and plain:  # words similar to nodes are nodes
        new, rest = [], []
        for p in plain:
            (rest if known.isdisjoint(_keys(p[3])) else new).append(p)
        if not new:
            break
        found += new
        plain, known = rest, {k for p in new for k in _keys(p[3])} - known
    found.sort()
    taken = {f[0] for f in found}
    out = []
    for w, a, b, core, label in found:
        before = text[slice(*words[w - 1])] if w else ""
        out.append((a, b, core, before, label, w > 0 and w - 1 not in taken, w + 1 < len(words) and w + 1 not in taken))
    return out


def features(node: tuple, tied: int) -> list[float]:
    """FEATURES of a node; ``tied``: 0 to nothing, 1 to another mention, 2 to a certain one."""
    _, _, core, before, _, left, right = node
    digits = sum("0" <= c <= "9" for c in core)
    cue = CUES.get(before.strip(OUTER).lower(), 0)
    capital, first, lower = core[:1].isupper(), not before or before[-1] in ".!?:", core == core.lower()
    plain = not digits and "@" not in core
    return [
        1, "@" in core, core.count(".") == 3, digits == len(core), 1 <= digits <= 4, 5 <= digits <= 8, 9 <= digits <= 11, 12 <= digits <= 19, digits >= 20,
        any(c.isalpha() for c in core), "=" in core, "/" in core, core[:1] == "+", "(" in core or ")" in core, "-" in core,
        cue == 1, cue == 2, cue == 3, cue == 4, "." in core, tied > 0, tied > 1,
        digits > 0, capital, first, lower, core.isalpha(), capital and first, lower and plain and core.isalpha(), left, right,
    ]


def links(found: list[tuple], text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain links of neighbouring nodes, and skip links of similar words: each to the next, and all to one of them, the first certain one or else the first."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if not text[found[i][1] : found[i + 1][0]].strip(OUTER + " \t\n\x0b\x0c\r+")]
    by: dict[str, list[int]] = {}
    for i, node in enumerate(found):
        for key in _keys(node[2]):
            by.setdefault(key, []).append(i)
    skip = set()
    for own in by.values():
        centre = next((i for i in own if found[i][4]), own[0])
        skip.update((min(i, centre), max(i, centre)) for i in own if i != centre)
        skip.update(zip(own, own[1:], strict=False))
    return chain, sorted(skip)


def _tied(found: list[tuple], skip: list[tuple[int, int]]) -> list[int]:
    tied = [0] * len(found)
    for i, j in skip:
        tied[i] = max(tied[i], 2 if found[j][4] else 1)
        tied[j] = max(tied[j], 2 if found[i][4] else 1)
    return tied


def marginals(unary: np.ndarray, pairs: np.ndarray, potentials: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Loopy sum-product in logarithms: unary (n, L), pairs (m, 2), potentials (m, L, L)."""
    n, size = unary.shape
    if not len(pairs):
        return unary
    a, b = pairs.T
    to_b = np.zeros((len(pairs), size))
    to_a = np.zeros((len(pairs), size))
    for _ in range(passes):
        belief = unary.copy()
        np.add.at(belief, b, to_b)
        np.add.at(belief, a, to_a)
        new_b = np.logaddexp.reduce((belief[a] - to_a)[:, :, None] + potentials, axis=1)
        new_a = np.logaddexp.reduce((belief[b] - to_b)[:, None, :] + potentials, axis=2)
        new_b -= np.logaddexp.reduce(new_b, axis=1)[:, None]
        new_a -= np.logaddexp.reduce(new_a, axis=1)[:, None]
        still = max(np.abs(new_b - to_b).max(), np.abs(new_a - to_a).max()) < SETTLED
        to_b, to_a = (to_b + new_b) / 2, (to_a + new_a) / 2
        if still:
            break
    belief = unary.copy()
    np.add.at(belief, b, to_b)
    np.add.at(belief, a, to_a)
    return belief


def decode(text: str, base: list[tuple[int, int, int]], model: tuple) -> list[tuple[int, int, int]]:
    """Added spans: words labelled by the field outside the base spans, neighbours of one label joined."""
    found = nodes(text, base)
    if not found or all(f[4] for f in found):
        return []
    weights, chain_w, skip_w = model
    chain, skip = links(found, text)
    x = np.array([features(f, t) for f, t in zip(found, _tied(found, skip), strict=True)], float)
    unary = x @ weights
    for i, f in enumerate(found):
        if f[4]:
            unary[i, f[4]] += OBSERVED
    pairs = np.array([*chain, *skip], np.int64).reshape(-1, 2)
    potentials = np.concatenate([np.repeat(chain_w[None], len(chain), 0), np.repeat(skip_w[None], len(skip), 0)])
    label = marginals(unary, pairs, potentials).argmax(1)
    out: list[tuple[int, int, int]] = []
    joined = set(chain)
    for i, f in enumerate(found):
        if not label[i] or f[4]:
            continue
        k = int(label[i]) - 1
        if out and (i - 1, i) in joined and label[i - 1] == label[i] and not found[i - 1][4]:
            out[-1] = (out[-1][0], k, f[1])
        else:
            out.append((f[0], k, f[1]))
    return out


def training_texts(n: int = 1000, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Generated sentences and the label of each word: strict mentions, loose repeats of them, names, and numbers and words that are none."""
    rng = random.Random(seed)
    filler = "we met the other team and they said it was fine to go on with our plan for now so please keep this".split()
    roles = "support sales info office news help contact desk team service press".split()
    out = []
    for _ in range(n):
        words: list[tuple[str, int]] = []
        name, last = ("".join(rng.choice("bcdfghklmnoprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(2))
        number = "".join(rng.choice("0123456789") for _ in range(10))
        ip = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        card = "".join(rng.choice("0123456789") for _ in range(15))
        card += next(d for d in "0123456789" if luhn(card + d))
        role = rng.choice(roles) if rng.random() < 0.3 else ""
        user = role or rng.choice([f"{name}.{rng.randint(10, 99)}", f"{name}.{last}", f"{name}_{last}", f"{name}{rng.randint(1, 99)}", last])
        given, family = name.capitalize(), last.capitalize()
        strict = {
            1: [f"{user}@mail{rng.randint(0, 9)}.example.com"],
            2: [ip],
            3: [card],
            4: ["+1", f"({number[:3]})", f"{number[3:6]}-{number[6:]}"],
        }
        called = [given, family] if name in user and last in user else [given if name in user else family]
        loose = {
            1: [[f"{user}@mail"]] if role else [[(user, 1 if re.search("[0-9._]", user) else 0)], [(user + ",", 1 if re.search("[0-9._]", user) else 0)], [f"{user}@mail"], *[[(x, 5) for x in called]] * 2, [("fine.", 0), *[(x, 5) for x in called]], [(called[-1] + rng.choice([".", ",", ""]), 5)]],
            2: [[f"{ip}:80"], [f"({ip})"]],
            3: [[f"{card[:8]}x{card[8:]}"], [f"no.{card}"]],
            4: [[f"({number[:3]})", f"{number[3:6]}-{number[6:]}"], [f"{number[:3]}-{number[3:6]}-{number[6:]}"], [number]],
        }
        other = [
            lambda: str(rng.randint(1, 2100)), lambda: f"{rng.randint(1, 99)}.{rng.randint(0, 9)}", lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
            lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}", lambda: f"{rng.randint(1, 99)}%", lambda: "%032x" % rng.getrandbits(128), lambda: f"password={rng.getrandbits(64):x}",
            lambda: f"{rng.randint(10000, 99999)}", lambda: f"A{rng.randint(100, 99999)}", lambda: f"{rng.randint(1, 9)}th", lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJ234567") for _ in range(16)),
            lambda: f"{rng.randint(1, 12)}:{rng.randint(10, 59)}", lambda: "@home", lambda: "%040X" % rng.getrandbits(160), lambda: f"{rng.randint(10**15, 10**16 - 1)}", lambda: f"{rng.randint(10**11, 10**15)}", lambda: str(rng.randint(10**8, 10**10)),
        ]
        present = rng.sample([1, 2, 3, 4], rng.randint(0, 3))
        parts = [(strict[k], k) for k in present]
        for k in present:
            if rng.random() < 0.7:
                parts += [(rng.choice(loose[k]), k) for _ in range(rng.randint(1, 2))]
        if 1 in present:  # words of the address that are no mention of a person
            for _ in range(rng.randint(0, 3)):
                word = role or rng.choice(["mail", "example", name, last])
                parts.append(([rng.choice(["so.", "now.", "fine!"]), word.capitalize()] if role and rng.random() < 0.4 else [word], 0))
        noise = [other[rng.randrange(len(other))]() for _ in range(rng.randint(1, 6))]
        parts += [([w], 0) for w in noise]
        if rng.random() < 0.4:
            parts += [([rng.choice(noise)], 0)] * rng.randint(1, 4)
        rng.shuffle(parts)
        for got, k in parts:
            words += [(rng.choice(filler), 0) for _ in range(rng.randint(1, 6))]
            if k and rng.random() < 0.3:
                words.append((rng.choice([c for c, v in CUES.items() if v == k]), 0))
            words += [w if isinstance(w, tuple) else (w, k) for w in got]
        out.append((" ".join(w for w, _ in words), [k for _, k in words]))
    return out


@lru_cache(maxsize=1)
def train(steps: int = 500, rate: float = 0.05, decay: float = 0.0002) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unary (features, labels), chain and skip (labels, labels) weights by pseudo-likelihood."""
    size = len(LABELS)
    xs, ys, left, right, near = [], [], [], [], []
    for text, labels in training_texts():
        base = base_spans(text)
        found = nodes(text, base)
        start = {m.start(): k for m, k in zip(WORD.finditer(text), labels, strict=True)}
        places = sorted(start)
        true = [start[max(p for p in places if p <= f[0])] for f in found]
        chain, skip = links(found, text)
        tied = _tied(found, skip)
        lo, hi, sk = (np.zeros((len(found), size)) for _ in range(3))
        for i, j in chain:
            lo[j, true[i]] += 1
            hi[i, true[j]] += 1
        for i, j in skip:
            sk[i, true[j]] += 1
            sk[j, true[i]] += 1
        for i, f in enumerate(found):
            if not f[4]:  # observed nodes tell nothing about the weights
                xs.append(features(f, tied[i]))
                ys.append(true[i])
                left.append(lo[i])
                right.append(hi[i])
                near.append(sk[i])
    x, y, lo, hi, sk = (np.array(v, float) for v in (xs, ys, left, right, near))
    target = np.eye(size)[y.astype(int)]
    params = [np.zeros((x.shape[1], size)), np.zeros((size, size)), np.zeros((size, size))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for t in range(1, steps + 1):
        w, chain_w, skip_w = params
        score = x @ w + lo @ chain_w + hi @ chain_w.T + sk @ skip_w
        p = np.exp(score - np.logaddexp.reduce(score, axis=1)[:, None])
        d = (p - target) / len(x)
        g_skip = sk.T @ d
        grads = [x.T @ d, lo.T @ d + d.T @ hi, (g_skip + g_skip.T) / 2]
        for k, (g, p_) in enumerate(zip(grads, params, strict=True)):
            g = g + decay * p_
            m, v = moments[k]
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            p_ -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return tuple(params)


def finder(model: tuple):
    """find(text) -> base spans, all spans, under a trained model.  Without a digit and an at sign there is no node."""

    def find(text: str) -> tuple[list, list]:
        if not has_any(text.encode(), b"0123456789@"):
            return [], []
        base = base_spans(text)
        return base, sorted({*base, *decode(text, base, model)})

    return find


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base_spans, spans for each row of ``docs``: (kind, start, end) in code points of the whole text.

    A null text is an empty text without spans.  Ids may be null or repeat; each row returns.  Other
    columns are not read.  An empty table returns no rows.
    """
    return detect(docs, KINDS, finder(train()), id_col, text_col)


def mask(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; see ``spans.redact``."""
    return redact(docs, KINDS, finder(train()), text_col, chars_col)
