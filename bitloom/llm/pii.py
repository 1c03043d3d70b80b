"""Personal data: fixed patterns, and a skip-chain conditional random field for what they miss.

The patterns give the base spans.  The field labels tokens as ordinary, personal or secret.  Its
nodes are the entity-like tokens (with a digit, ``@`` or ``=``), the words around them, and every
word, wherever it stands, that is the name part of an address.  Neighbouring nodes share a
potential, and so do distant ones that are the same or similar (equal letters and digits, equal
digits of a number, the name before an ``@``): the skip edges.  Loopy message passing carries a
label that is plain in one place to the others, so a document's mentions end up consistent.  Words
that are none of these have no feature in favour of anything but ``ordinary`` and no edge that could
change it; they are left out of the graph.

Weights are fitted here, by pseudo-likelihood, on documents made by rule (``training_documents``):
generic forms of secrets and contacts in nonsense words, nothing of any corpus.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, ship, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the field adds: a secret, and a mention that is personal by consistency with another.
ADDED = ("secret", "mention")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@=]")
_DIGITS = re.compile(r"[0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain.label, driven by the @ signs, so that long runs cost one look."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four dotted numbers; a longer chain is taken four at a time, what fails the bound is dropped."""
    out = []
    for m in _DOTTED.finditer(text):
        runs = [x.span() for x in _DIGITS.finditer(text, m.start(), m.end())]
        for i in range(0, len(runs) - 3, 4):
            four = runs[i : i + 4]
            values = [text[a:z].lstrip("0") for a, z in four]  # as text first: runs can be very long
            if all(len(v) < 4 and int(v or 0) <= 255 for v in values):
                out.append((four[0][0], four[3][1]))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) of each kind."""
    if not _ANY.search(text):
        return {k: [] for k in KINDS}
    return {"email": emails(text) if "@" in text else [], "ip": ips(text), "card": cards(text), "phone": phones(text) if "+" in text else []}


# --- the field ---------------------------------------------------------------------------------

LABELS = ("ordinary", "personal", "secret")
_K = len(LABELS)
_HINTS = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key")
_EDGE = "\"'`.,;:!?()[]{}<>#*|"
_TOKEN = re.compile(r"\S+")
#: Words on each side of an entity-like token that are nodes, and least letters of a name.
AROUND, NAME = 2, 4
#: Features of a token, in this order.
FEATURES = ("bias", "in_base", "key_value", "hint_before", "quoted", "hex_run", "mixed_caps", "long", "all_digits", "seven_digits", "at_sign", "dotted", "few_digits", "letters_digits", "word", "capital", "names_secret", "names_contact")
_CONTACTS = ("mail", "phone", "call", "tel", "contact", "fax", "name", "from")


class Token:
    __slots__ = ("end", "keys", "place", "start", "x")


def tokens(text: str, spans: list[tuple[int, int]]) -> list[Token]:
    """The nodes of a text in order, with features; ``spans``: base spans, in order of start."""
    raw = [m.span() for m in _TOKEN.finditer(text)]
    core = [i for i, (a, z) in enumerate(raw) if _ANY.search(text, a, z)]
    near = {j for i in core for j in range(i - AROUND, i + AROUND + 1) if 0 <= j < len(raw)}
    names = set()
    for i in core:
        user, at, _ = text[raw[i][0] : raw[i][1]].partition("@")
        if at:
            names |= {w for w in re.findall(r"[^\W\d_]+", user.lower()) if len(w) >= NAME}
    if names:  # mentions of a name anywhere in the text
        near |= {i for i, (a, z) in enumerate(raw) if z - a >= NAME and text[a:z].strip(_EDGE).lower() in names}
    out: list[Token] = []
    k = 0
    for i in sorted(near):
        start, end = raw[i]
        body = text[start:end].strip(_EDGE)
        if not body:
            continue
        left = start + text[start:end].index(body)
        name, eq, value = body.partition("=")
        keyed = bool(eq) and any(h in name.lower() for h in _HINTS)
        if keyed and value:
            value = value.strip(_EDGE)
            left, body = left + len(name) + 1 + (body[len(name) + 1 :].index(value) if value else 0), value or body
        before = [text[a:z] for a, z in raw[max(0, i - 2) : i]]
        hint = bool(before) and before[-1][-1:] in "=:" and any(h in w.lower() for w in before for h in _HINTS)
        digits = "".join(c for c in body if "0" <= c <= "9")
        plain = "".join(c for c in body.lower() if c.isalnum())
        letters = len(plain) - len(digits)
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        inside, j = False, k
        while j < len(spans) and spans[j][0] < end and not inside:
            inside, j = spans[j][1] > start, j + 1
        word = not digits and "@" not in body and "=" not in body
        t = Token()
        t.start, t.end, t.place = left, left + len(body), i
        t.keys = set()
        if not word and len(plain) >= 6 or plain in names:
            t.keys.add(plain)
        if len(digits) >= 7:
            t.keys.add(digits)
            t.keys.add(digits[-7:])
        if "@" in body:
            user = body.partition("@")[0].lower()
            t.keys |= {w for w in re.findall(r"[^\W\d_]+", user) if w in names}
            if len(user) >= 5 and any(c.isdigit() for c in user):
                t.keys.add("".join(c for c in user if c.isalnum()))
        low = body.lower()
        t.x = np.array([
            1, inside, keyed, hint, text[start] in "\"'`" and len(body) > 8,
            len(plain) >= 16 and letters > 0 and len(digits) > 3 and all(c in "0123456789abcdef" for c in plain),
            len(plain) >= 16 and body.upper() == body and letters > 3 and len(digits) > 1,
            len(plain) >= 16, letters == 0, len(digits) >= 7, "@" in body, body.count(".") >= 2,
            len(digits) < 5, letters > 0 and len(digits) > 0,
            word, body[:1].isupper(), word and any(h in low for h in _HINTS), word and low.strip(":") in _CONTACTS,
        ], float)
        out.append(t)
    return out


def edges(ts: list[Token]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(neighbours, skips): nodes of adjacent tokens, and consecutive holders of a key."""
    chain = [(i, i + 1) for i in range(len(ts) - 1) if ts[i + 1].place == ts[i].place + 1]
    last: dict[str, int] = {}
    skip = set()
    for i, t in enumerate(ts):
        for key in t.keys:
            if key in last:
                skip.add((last[key], i))
            last[key] = i
    return chain, sorted(skip.difference(chain))


def training_documents(n: int = 400, seed: int = 7) -> list[tuple[str, dict[str, int]]]:
    """Documents made by rule, and the label of each node's core that isn't ordinary."""
    r = random.Random(seed)
    out = []
    word = lambda: "".join(r.choice(["ta", "re", "in", "on", "mo", "li", "ster", "ed"]) for _ in range(r.randint(1, 4)))
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    small, large, ten = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    for _ in range(n):
        parts, labels = [], {}
        name = some("bcdfgklmnprst", r.randint(4, 8))
        user = name + r.choice([f".{r.randint(10, 99)}", f"_{r.randint(100, 999)}", "", f".{some(small, 5)}"])
        hexes, mixed, caps = some("0123456789abcdef", r.choice([18, 24, 32, 40, 64])), some(small + large + ten, r.choice([20, 32, 43])), some(large + ten, r.choice([16, 20, 24]))
        number = some(ten, 10)
        label = r.choice(["password", "passwd", "pwd", "api_key", "apikey", "secret", "client_secret", "access_token", "token", "key"])
        value = r.choice([hexes, hexes, mixed, caps])
        secrets = [f"{label}={value}", f'{label} = "{value}"', f"{label}: {value}", f"{label}='{value}'", f"K{caps}", f"x{hexes}"]
        personal = [f"{user}@mail.{word()}.test", f"+1 ({number[:3]}) {number[3:6]}-{number[6:]}", f"+44 {number}", f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}"]
        plain = [str(r.randint(1, 9999)), f"{r.randint(1, 12)}:{r.randint(10, 59)}", f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{r.randint(1900, 2030)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", f"x={r.randint(1, 99)}", f"no. {r.randint(10**6, 10**8)}", f"{r.randint(1, 99)}%", f"B{r.randint(1, 99)}", f"{r.randint(1, 900)},{r.randint(100, 999)}", f"{word()}={word()}", f"{word()}{r.randint(1, 99)}", f"the key {word()} 12", "".join(word() for _ in range(5)), f"ISBN {some(ten, 13)}"]
        for kind in r.sample(["s", "p", "o", "o", "o", "m", "n"], r.randint(2, 6)):
            parts += [word().capitalize() if r.random() < 0.2 else word() for _ in range(r.randint(2, 12))]
            if kind == "s":
                which = r.choice(secrets)
                parts.append(which)
                core = which.split("=")[-1].split(":")[-1].strip(" \"'")
                labels[core] = 2
                if r.random() < 0.5:  # the same secret again, without what tells it
                    parts += [word(), core]
            elif kind == "p":
                parts.append(r.choice(personal))
            elif kind == "m":  # a mention of a number that a pattern finds elsewhere
                parts += [personal[1], *[word() for _ in range(4)], number]
                labels[number] = 1
            elif kind == "n":  # mentions of a person whose address stands elsewhere
                parts += [personal[0], *[word() for _ in range(4)], user, word(), name.capitalize()]
                labels[user] = labels[name] = labels[name.capitalize()] = 1
            else:
                parts.append(r.choice(plain))
        out.append((" ".join(parts), labels))
    return out


_fitted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def weights() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fitted weights; fitted once, on the driver, and sent along with the functions that use them."""
    if not _fitted:
        _fitted.append(fit())
    return _fitted[0]


def fit() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token features x labels, neighbour potentials, skip potentials), by pseudo-likelihood.

    A token's label given its features and the true labels around it is a softmax; gradient ascent
    with a quadratic penalty, deterministic.
    """
    xs, ys = [], []
    for text, labels in training_documents():
        spans = sorted(s for v in base_spans(text).values() for s in v)
        ts = tokens(text, spans)
        y = [labels.get(text[t.start : t.end], 1 if t.x[1] else 0) for t in ts]
        chain, skip = edges(ts)
        around = np.zeros((len(ts), 2 * _K))
        for kind, pairs in enumerate((chain, skip)):
            for i, j in pairs:
                around[i, kind * _K + y[j]] += 1
                around[j, kind * _K + y[i]] += 1
        for t, label, a in zip(ts, y, around, strict=True):
            xs.append(np.concatenate([t.x, a]))
            ys.append(label)
    x, y = np.array(xs), np.eye(_K)[ys]
    w = np.zeros((x.shape[1], _K))
    for _ in range(1500):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w += 0.5 * (x.T @ (y - p) / len(x) - 3e-4 * w)
    f = len(FEATURES)
    chain, skip = w[f : f + _K], w[f + _K :]
    return w[:f], (chain + chain.T) / 2, (skip + skip.T) / 2


def marginals(ts: list[Token], rounds: int = 12, damp: float = 0.3) -> np.ndarray:
    """Label probabilities of the tokens by loopy sum-product (exact where the graph is a tree)."""
    w, chain_pot, skip_pot = weights()
    return passed(np.array([t.x for t in ts]) @ w, *edges(ts), chain_pot, skip_pot, rounds, damp)


def passed(unary: np.ndarray, chain: list, skip: list, chain_pot: np.ndarray, skip_pot: np.ndarray, rounds: int = 12, damp: float = 0.3) -> np.ndarray:
    """Sum-product messages along the edges, and what they make of the nodes' log potentials."""
    unary = unary.copy()
    pairs = chain + skip
    if pairs:
        i, j = np.array(pairs).T
        src, dst = np.concatenate([i, j]), np.concatenate([j, i])
        pot = np.concatenate([np.repeat(chain_pot[None], len(chain), 0), np.repeat(skip_pot[None], len(skip), 0)])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])  # [edge, label of src, label of dst]
        m, half = np.zeros((len(src), _K)), len(pairs)
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, dst, m)
            z = (total[src] - m[back])[:, :, None] + pot
            new = np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) + z.max(axis=1)
            new -= new.max(axis=1, keepdims=True)
            step = np.abs(new - m).max()
            m = damp * m + (1 - damp) * new
            if step < 1e-4:
                break
        np.add.at(unary, dst, m)
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: dict[str, list[tuple[int, int]]], least: float = 0.6) -> dict[str, list[tuple[int, int]]]:
    """Spans of the field's kinds; never one that overlaps a base span."""
    found = {k: [] for k in ADDED}
    if not _ANY.search(text):
        return found
    spans = sorted(s for v in base.values() for s in v)
    ts = tokens(text, spans)
    if not ts:
        return found
    for t, p in zip(ts, marginals(ts), strict=True):
        best = int(p.argmax())
        if best and not t.x[1] and p[best] >= least:
            found[ADDED[0] if best == 2 else ADDED[1]].append((t.start, t.end))
    return found


def written(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k in spans for a, z in spans[k])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n of each base kind, n_added, n_spans, base and spans (``kind:start:end``, comma-joined) for every row.

    A null text counts as empty.  Spans are code points, end exclusive; base spans come first, by
    kind and start, then the field's.  Work per text is linear, whatever its length.  Repeated ids
    and rows are rows of their own; other columns are ignored; no rows in, no rows out.  A tie between
    labels goes to the first of ``LABELS``.
    """
    bounded_batches(docs.sparkSession)
    weights()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"].tolist():
                text = text if isinstance(text, str) else ""
                base = base_spans(text)
                more = added_spans(text, base)
                out.append((*[len(base[k]) for k in KINDS], sum(map(len, more.values())), sum(map(len, (base | more).values())), written(base), written({k: v for k, v in (base | more).items()})))
            yield pd.concat([pdf[["doc_id"]], pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "n_added", "n_spans", "base", "spans"])], axis=1)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, n_spans long, base string, spans string")


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in brackets."""
    parts = sorted((int(a), int(z), k) for k, a, z in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for a, z, k in parts:
        if a >= at:
            out += [text[at:a], f"[{k}]"]
            at = z
    return "".join([*out, text[at:]])


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added", "n_spans")


ship(__name__)
