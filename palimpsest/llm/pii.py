"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from four fixed patterns and their checks.  The field then labels every
token that holds a digit or an at-sign: neighbouring tokens share a chain potential, and
distant tokens that are equal or alike share a skip potential: the same letters and digits
under any separators, the same last seven digits, the same local part of an address.
Tokens inside base spans are evidence: their label is given, so what a mention that the
patterns know shows carries over to the others of its document.  Loopy sum-product messages
give marginals; runs of tokens whose label is sure are added as spans of that kind where
no base span is touched.  A run that is no one mention (two numbers side by
side) gives its parts that are.  Base spans are never changed.

Each key of a token links it to the next token with that key only, so the graph grows with
the text.  The field is fitted when first needed, by pseudo-likelihood, on `TRAIN_TEXTS`
made-up texts labelled by construction (`lesson`): a documented, bounded sample; how sure a
label must be is chosen on `HELD_OUT` others.

Defined results: a null or empty text has no spans; offsets are code points, end
exclusive; repeated rows and null ids are kept as they are; other columns are ignored by
the report and kept by the masking.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_text

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
TRAIN_TEXTS, HELD_OUT, RIDGE, ROUNDS = 250, 100, 1.0, 10_000
#: Of these the least that keeps PRECISION of the spans added to the held-out texts right.
SURE, PRECISION = (0.7, 0.8, 0.9, 0.95, 0.98, 0.99), 0.98
GIVEN = 60.0  # log-odds of a label that a base span gives
SETTLED = 1e-6  # largest move of a text's messages when they count as settled

# Possessive forms of the patterns: a run of digits or of address characters is only ever
# entered at its start, where the pattern itself would match first.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, 0, last := found.end()))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_TOKEN_EDGE = ".,;:!?\"'[]{}<>«»"
_CUES = {"mail": 0, "email": 0, "e-mail": 0, "ip": 1, "host": 1, "server": 1, "address": 1, "card": 2, "visa": 2, "credit": 2, "phone": 3, "tel": 3, "call": 3, "mobile": 3, "fax": 3}


def tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, end, word before) of the tokens with a digit or at-sign, edges trimmed."""
    out, done, size = [], 0, len(text)
    for m in _HINT.finditer(text):
        a = b = m.start()
        if a < done:
            continue
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < size and not text[b].isspace():
            b += 1
        done = b
        while a < b and text[a] in _TOKEN_EDGE:
            a += 1
        while b > a and text[b - 1] in _TOKEN_EDGE:
            b -= 1
        if a < b:
            before = text[max(0, a - 24) : a].split()
            out.append((a, b, before[-1].strip(_TOKEN_EDGE).lower() if before else ""))
    return out


def features(token: str, before: str) -> list[str]:
    digits = _digits(token)
    n = len(digits)
    letters = sum(c.isalpha() for c in token)
    shape = re.sub(r"[0-9]+", lambda m: "d" * min(3, (len(m[0]) + 2) // 3), re.sub(r"[^\W\d_]+", "a", token))[:8]
    out = ["bias", f"digits:{n if n < 5 else 5 + n // 4 if n < 20 else 10}", f"shape:{shape}", f"letters:{min(3, letters)}"]
    if not letters and len(token) <= 24:
        out.append("groups:" + re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 9)), token))
    if "@" in token:
        local, _, domain = token.partition("@")
        out.append("at:full" if local and "." in domain.strip(".") else "at:part")
    if token[0] == "+":
        out.append("plus")
    if "(" in token or ")" in token:
        out.append("round")
    if "-" in token:
        out.append("dash")
    if "=" in token or ":" in token or "/" in token:
        out.append("sign")
    parts = token.split(".")
    if len(parts) == 4 and all(p.isdigit() for p in parts):
        out.append("quad:fits" if all(len(p) <= 3 and int(p) <= 255 for p in parts) else "quad:no")
    if 14 <= n <= 19 and not letters:
        out.append("luhn" if luhn(digits) else "not luhn")
    if before in _CUES:
        out.append(f"cue:{_CUES[before]}")
    return out


def keys(token: str) -> list[str]:
    """What a token has in common with other mentions of the same thing."""
    out = [re.sub(r"[\W_]+", "", token).lower()]
    digits = _digits(token)
    if len(digits) >= 7 and not any(c.isalpha() for c in token):
        out.append(f"7 {digits[-7:]}")
    if "@" in token[1:]:
        out.append(f"@ {token.partition('@')[0].lower()}")
    return [k for k in out if k]


def graph(text: str, found: list[tuple[int, int, str]], base: list[Span] = ()) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain edges, skip edges) between token numbers: tokens parted by one white space
    run, and tokens with a common key to the next that has it, where no chain edge joins
    the two; one edge a pair.  The last token of a base span also has the span's last
    seven digits as a key, whatever tokens they are spread over."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] <= 4 and text[found[i][1] : found[i + 1][0]].strip(_TOKEN_EDGE + " ") == ""]
    skip, last, chained = {}, {}, {i for i, _ in chain}
    whole = _inside_at(found, base)
    for i, (a, b, _) in enumerate(found):
        more = [f"7 {d[-7:]}" for s, e in whole.get(i, ()) if len(d := _digits(text[s:e])) >= 7]
        for key in dict.fromkeys(keys(text[a:b]) + more):
            if key in last and not (i - last[key] == 1 and last[key] in chained):
                skip[last[key], i] = True
            last[key] = i
    return chain, list(skip)


class Field:
    def __init__(self, weights: dict[str, np.ndarray], chain: np.ndarray, skip: np.ndarray, sure: float = SURE[-1]) -> None:
        self.weights, self.chain, self.skip, self.sure = weights, chain, skip, sure
        self.none = np.zeros(len(LABELS))

    def marginals(self, own: np.ndarray, edges: list[tuple[int, int]], kinds: np.ndarray, part: np.ndarray | None = None) -> np.ndarray:
        """Loopy sum-product, all messages at once, damped; kinds: 0 chain, 1 skip.

        part: the text of each token, ascending.  A text's messages are sent until they
        settle, whatever other texts are still moving.
        """
        belief = own.copy()
        if edges:
            e = np.array(edges)
            source, target = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
            back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
            both = np.stack([self.chain, self.skip])
            potential = np.concatenate([both[kinds], both[kinds].transpose(0, 2, 1)])  # [source label, target label]
            message = np.zeros((len(source), len(LABELS)))
            of = np.zeros(len(source), int) if part is None else part[source]
            open_ = np.arange(len(source))  # messages of texts that still move
            for _ in range(ROUNDS):
                s, t = source[open_], target[open_]
                x = (belief[s] - message[back[open_]])[:, :, None] + potential[open_]
                top = x.max(axis=1)
                new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
                new -= new.max(axis=1, keepdims=True)
                old = message[open_]
                moved = np.zeros(of.max() + 1)
                np.maximum.at(moved, of[open_], np.abs(new - old).max(axis=1))
                message[open_] = 0.5 * old + 0.5 * new
                belief[t] = own[t]
                np.add.at(belief, t, message[open_])
                open_ = open_[moved[of[open_]] >= SETTLED]
                if not len(open_):
                    break
        belief -= belief.max(axis=1, keepdims=True)
        p = np.exp(belief)
        return p / p.sum(axis=1, keepdims=True)

    def own(self, token: str, before: str) -> np.ndarray:
        get = self.weights.get
        return sum([get(f, self.none) for f in features(token, before)])


def _made(kind: int, rng: random.Random) -> list[list[str]]:
    """Mentions of one thing, each as tokens; the patterns know some of its written forms
    and miss others (no plus, odd separators, letters beyond ASCII)."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("th", "er", "on", "ma", "re", "lo", "es")) for _ in range(rng.randint(1, 3)))
    if kind == 0:
        local, host = f"{word()}{rng.choice(('.', '', '_'))}{d(rng.randint(0, 2))}", f"{word()}{d(rng.randint(0, 1))}"
        return [[f"{local}@{host}.{rng.choice(('example.com', 'example.org', 'net', 'de'))}"], [f"{local}@{rng.choice('üéñ')}{host}.de"], [f"{local}ü@{host}.example.org"]]
    if kind == 1:
        quad = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        return [[quad], [f"{quad}:80"]]
    if kind == 2:
        n = d(15)
        n = next(n + c for c in "0123456789" if luhn(n + c))
        four = [n[:4], n[4:8], n[8:12], n[12:]]
        return [[n], four, ["-".join(four)], [".".join(four)], ["/".join(four)], [n[:8], n[8:]]]
    a, b, c = d(3), d(3), d(4)
    return rng.choice((
        [["+1", f"({a})", f"{b}-{c}"], [f"+1-{a}-{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"{a}/{b}-{c}"], [f"1-{a}-{b}-{c}"]],
        [["+49", a, b + c], [f"0{a}", b + c], [f"0{a}/{b}{c}"], [f"+49({a}){b}-{c}"]],
    ))


def lesson(seed: int) -> tuple[str, list[Span]]:
    """A made-up text and its personal data."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "ti", "es", "ue", "ó")) for _ in range(rng.randint(1, 4))) + rng.choice(("", "", "", ",", "."))
    other = (
        lambda: d(rng.randint(1, 6)), lambda: f"{d(2)}.{d(2)}", lambda: f"19{d(2)}-{rng.randint(10, 12)}-{d(2)}", lambda: f"v{d(1)}.{d(1)}.{d(1)}", lambda: f"{d(1)}.{d(1)}.{d(2)}",
        lambda: "token=" + "".join(rng.choice("0123456789abcdef") for _ in range(24)), lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((8, 18, 40)))),
        lambda: f"@{word()}", lambda: d(rng.randint(8, 22)), lambda: f"http://a{d(1)}.example.com/{d(3)}", lambda: f"{d(3)}-{d(2)}", lambda: f"{d(1)},{d(3)}", lambda: f"({d(4)})", lambda: f"#{d(3)}", lambda: f"{d(3)}.{d(3)}.{d(3)}.{d(4)}",
        lambda: f"{d(3)}-{d(4)}", lambda: f"{d(2)}/{d(2)}/20{d(2)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{d(3)},{d(3)},{d(3)}",
    )
    told = [(k, _made(k, rng)) for k in rng.sample(range(4), rng.randint(0, 3))]
    out, spans, at = [], [], 0

    def say(x: str) -> int:
        nonlocal at
        out.append(x)
        at += len(x) + 1
        return at - 1 - len(x)

    def mention(kind: int, forms: list[list[str]]) -> None:
        words = rng.choice(forms)
        start = say(words[0])
        for more in words[1:]:
            say(more)
        spans.append((start, kind, at - 1))

    fixed = [f() for f in rng.sample(other, 4)]
    for _ in range(rng.randint(5, 60)):
        x = rng.random()
        if x < 0.15 and told:
            kind, forms = rng.choice(told)
            if rng.random() < 0.3:
                say(rng.choice([c for c, k in _CUES.items() if k == kind]))
            mention(kind, forms)
            if rng.random() < 0.15:  # another one of the kind, or a number, at once
                mention(kind, _made(kind, rng)) if rng.random() < 0.6 else say(d(rng.randint(1, 4)))
        elif x < 0.3:
            say(rng.choice(fixed))
        else:
            say(word())
    return " ".join(out), spans


@lru_cache(1)
def trained(texts: int = TRAIN_TEXTS) -> Field:
    """Node, chain and skip potentials by pseudo-likelihood, gradient steps, and how sure a
    label must be; deterministic."""
    rows, labels, ties = [], [], []
    for seed in range(texts):
        text, spans = lesson(seed)
        found = tokens(text)
        own = [next((k + 1 for s, k, e in spans if s <= a < e), 0) for a, _, _ in found]
        first = len(rows)
        for (a, b, before), y in zip(found, own, strict=True):
            rows.append(features(text[a:b], before))
            labels.append(y)
        for kind, edges in enumerate(graph(text, found, base_spans(text))):
            ties += [(kind, first + i, first + j) for i, j in edges]
    names = sorted({f for r in rows for f in r})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [at[f] for f in r]] = 1
    y, n = np.array(labels), len(LABELS)
    near = np.zeros((len(rows), 4 * n))  # labels of neighbours: chain before, after, skip before, after
    for kind, i, j in ties:
        near[j, kind * 2 * n + labels[i]] += 1
        near[i, kind * 2 * n + n + labels[j]] += 1
    w, tie = np.zeros((len(names), n)), np.zeros((2, n, n))
    target = np.eye(n)[y]
    for _ in range(250):
        pull = np.concatenate([tie[0], tie[0].T, tie[1], tie[1].T])
        score = x @ w + near @ pull
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=1, keepdims=True)
        miss = target - p
        w += 2.0 * (x.T @ miss / len(y) - RIDGE * 1e-4 * w)
        g = near.T @ miss / len(y)
        tie[0] += 2.0 * (g[:n] + g[n : 2 * n].T - RIDGE * 1e-3 * tie[0])
        tie[1] += 2.0 * (g[2 * n : 3 * n] + g[3 * n :].T - RIDGE * 1e-3 * tie[1])
    field = Field(dict(zip(names, w, strict=True)), tie[0], (tie[1] + tie[1].T) / 2)
    held = [lesson(seed) for seed in range(texts, texts + HELD_OUT)]
    for sure in SURE:
        field.sure = sure
        added = [(x, truth) for (_, truth), (base, every) in zip(held, spans_of(field, [t for t, _ in held]), strict=True) for x in set(every) - set(base)]
        if sum(x in truth for x, truth in added) >= PRECISION * len(added):
            break
    return field


def added_spans(field: Field, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
    """What the field adds to the base spans of each text; all texts are one graph of
    separate parts, so messages of a whole batch are sent together."""
    own, edges, kinds, of, given = [], [], [], [], []
    for t, text in enumerate(texts):
        found = tokens(text)
        first = len(own)
        own += [field.own(text[a:b], before) for a, b, before in found]
        of += [(t, a, b) for a, b, _ in found]
        given += _inside(found, bases[t])
        for kind, part in enumerate(graph(text, found, bases[t])):
            edges += [(first + i, first + j) for i, j in part]
            kinds += [kind] * len(part)
    out: list[list[Span]] = [[] for _ in texts]
    if not own:
        return out
    own = np.array(own)
    for i, k in enumerate(given):
        if k is not None:
            own[i, k + 1] += GIVEN
    p = field.marginals(own, edges, np.array(kinds, int), np.array([t for t, _, _ in of]))
    label, sure = p.argmax(axis=1), p.max(axis=1) >= field.sure
    for i, k in enumerate(given):
        sure[i] &= k is None  # base spans stay as they are
    chained = {i for (i, _), k in zip(edges, kinds, strict=True) if k == 0}
    i = 0
    while i < len(of):
        j = i
        if sure[i] and label[i]:
            while j in chained and sure[j + 1] and label[j + 1] == label[i]:
                j += 1
            t, kind = of[i][0], int(label[i]) - 1
            out[t] += _parts(texts[t], kind, [x[1:] for x in of[i : j + 1]])
        i = j + 1
    return out


def _inside_at(found: list[tuple[int, int, str]], base: list[Span]) -> dict[int, list[tuple[int, int]]]:
    """Base spans by the number of their last token."""
    out: dict[int, list[tuple[int, int]]] = {}
    starts = [a for a, _, _ in found]
    for s, _, e in base:
        out.setdefault(bisect_right(starts, e - 1) - 1, []).append((s, e))
    return out


def _inside(found: list[tuple[int, int, str]], base: list[Span]) -> list[int | None]:
    """Of each token the kind of the base span that touches it, the first if there are more."""
    out: list[int | None] = [None] * len(found)
    ends = [b for _, b, _ in found]
    for s, kind, e in base:
        i = bisect_right(ends, s)
        while i < len(found) and found[i][0] < e:
            if out[i] is None:
                out[i] = kind
            i += 1
    return out


def _parts(text: str, kind: int, run: list[tuple[int, int]]) -> list[Span]:
    """The run of tokens as one span, or if it is not plausible as such (mentions side by
    side) the parts that are, from the left: the shortest that starts at each token."""
    out, i = [], 0
    if _plausible(kind, text[run[0][0] : run[-1][1]]):
        return [(run[0][0], kind, run[-1][1])]
    while i < len(run):
        end = next((j for j in range(i, min(len(run), i + 20)) if _plausible(kind, text[run[i][0] : run[j][1]])), None)  # 19 digits at most, one a token at least
        if end is not None:
            out.append((run[i][0], kind, run[end][1]))
        i = i + 1 if end is None else end + 1
    return out


def _plausible(kind: int, text: str) -> bool:
    """Least form of a kind: what no reading of it lacks."""
    if kind < 2:
        return not any(c.isspace() for c in text) and (text.count("@") == 1 and "." in text if kind == 0 else text.count(".") == 3)
    digits = _digits(text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def spans_of(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) spans of each text, by start, then kind."""
    bases = [base_spans(t) if _HINT.search(t) else [] for t in texts]
    open_ = [i for i, t in enumerate(texts) if _HINT.search(t)]
    added = dict(zip(open_, added_spans(field, [texts[i] for i in open_], [bases[i] for i in open_]), strict=True))
    return [(b, sorted(b + added[i]) if added.get(i) else b) for i, b in enumerate(bases)]


def written(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def _slices(column: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column in runs of about `size` characters."""
    first, part, n = 0, [], 0
    for i, x in enumerate(column):
        part.append(x.as_py() or "")
        n += len(part[-1])
        if n >= size or len(part) == 2048:
            yield first, part
            first, part, n = i + 1, [], 0
    if part:
        yield first, part


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of base spans by kind, base_sha256, spans (base and added)."""
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _slices(batch.column("text")):
                rows = []
                for base, every in spans_of(field, texts):
                    n = [0, 0, 0, 0]
                    for _, k, _ in base:
                        n[k] += 1
                    rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
                cols = [pa.array([x[j] for x in rows], pa.int64() if j < 4 else pa.string()) for j in range(6)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first : first + len(texts)], *cols], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text")).mapInArrow(run, SCHEMA)


def masked_text(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s, k, e in spans:
        if e <= at:
            continue
        out += [text[at : max(s, at)], f"<{KINDS[k].upper()}>"] if s >= at else []
        at = e
    return "".join(out) + text[at:]


def without_personal_data(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets (overlapping
    spans by the first); a null text stays null; other columns are unchanged, but n_chars,
    where there is one, is that of the new text."""
    field = trained()
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out = batch.column("text"), []
            for _, texts in _slices(column):
                out += [masked_text(t, every) for t, (_, every) in zip(texts, spans_of(field, texts), strict=True)]
            out = [t if there else None for t, there in zip(out, column.is_valid().to_pylist(), strict=True)]
            cols = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array(out, column.type)}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in out], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, schema)
