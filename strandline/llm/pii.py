"""Personal data: fixed patterns, and a skip-chain conditional random field in which repeated and similar tokens share their labels."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import in_sample, sample_share, with_text_columns

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
LABELS = OUTSIDE + 1
SAMPLE_ROWS = 5_000
TABLE_ROWS = 20_000  # distinct training rows that come to the driver, the most frequent first
LEAST_CONTEXT = 20
DISTORTED = 0.05  # share of the mentions of known things that are taken to be written as no pattern finds them
STEPS = 400
PENALTY = 1e-3
ROUNDS = 30
DAMPING = 0.3
ADD_AT = 0.5
SHORTEST, LONGEST = 7, 19  # digits of a number that may be one
TAIL = 9  # last digits that forms of one number share

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A shorter run of digits never lets these match, so possessive repeats find what plain ones would, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBER = re.compile(r"\+?(?<![0-9])\(?(?<![0-9])[0-9](?:[ ().-]{0,2}[0-9])++")
PIECE = re.compile(r"[^ ]+")
WORD_BEFORE = re.compile(r"([^\W\d_]+)[^\w]*\Z")
ADDRESS_STOP = re.compile(r"[\s@<>()\[\]\",;:]")
NOT_DIGITS = re.compile(r"[^0-9]+")
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All matches of the fixed patterns, by kind and then by start."""
    found: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
            found.append((3, m.start(), m.end()))
    return found


@dataclass
class Token:
    start: int
    end: int
    key: str
    shape: str
    label: int | None  # known from the patterns
    context: str = ""


@dataclass
class FieldModel:
    """Learned potentials of the labels: by shape, by the word before, of tokens that fail the patterns, and of pairs by kind of edge."""

    bias: np.ndarray
    failed: np.ndarray
    shapes: dict[str, np.ndarray]
    contexts: dict[str, np.ndarray]
    pairs: np.ndarray  # (edge kinds, LABELS, LABELS), symmetric


CHAIN, SAME, SIMILAR = range(3)
Edge = tuple[int, int, int]  # kind, two places


def _shape(token: str) -> str:
    if "@" in token:
        return "address" if "." in token.partition("@")[2] else "short address"
    digits = NOT_DIGITS.sub("", token)
    form = "plus" if token[0] == "+" else "dots" if token.count(".") == 3 else "plain" if len(digits) == len(token) else "signs"
    return f"{form} {min(len(digits), 20)}" + (f" {digits[0]}" if len(digits) > 12 else "")


def _key(token: str) -> str:
    """What tokens that repeat one another share."""
    return token.lower().strip("._-+%'") if "@" in token else NOT_DIGITS.sub("", token)


def _context(text: str, start: int) -> str:
    found = WORD_BEFORE.search(text[max(0, start - 24) : start])
    return found[1].lower() if found else ""


def _numbers(text: str, known: set[str]) -> Iterator[tuple[int, int]]:
    """Runs of digits with signs and single blanks; those too long for one number, or with a known one among their pieces between blanks, fall into these."""
    for m in NUMBER.finditer(text):
        whole = len(NOT_DIGITS.sub("", m[0])) <= LONGEST
        if whole and (" " not in m[0] or known.isdisjoint(NOT_DIGITS.sub("", p) for p in m[0].split(" "))):
            yield m.span()
        else:
            yield from ((m.start() + p.start(), m.start() + p.end()) for p in PIECE.finditer(m[0]))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """What stands around an @ without blanks, brackets or commas, leftmost first and apart: each sign is looked at once."""
    seen, at = 0, text.find("@")
    while at >= 0:
        start = max((m.end() for m in ADDRESS_STOP.finditer(text, seen, at)), default=seen)
        stop = ADDRESS_STOP.search(text, at + 1)
        end = stop.start() if stop else len(text)
        if start < at and end > at + 1:
            yield start, end
            seen = end
        else:
            seen = at + 1
        at = text.find("@", seen)


def tokens(text: str, base: list[Span]) -> list[Token]:
    """The known spans, and of what lies outside them whatever looks like an address or a long number."""
    out = [Token(s, e, _key(text[s:e]), _shape(text[s:e]), kind, _context(text, s)) for kind, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    reach = []  # the furthest end so far: spans of different kinds may overlap
    for _, e in taken:
        reach.append(max(e, reach[-1] if reach else 0))

    def offer(s: int, e: int) -> None:
        i = bisect_left(starts, e)
        if not (i and reach[i - 1] > s):
            out.append(Token(s, e, _key(text[s:e]), _shape(text[s:e]), None, _context(text, s)))

    for s, e in _numbers(text, {t.key for t in out}):
        if SHORTEST <= len(NOT_DIGITS.sub("", text[s:e])) <= LONGEST:
            offer(s, e)
    if "@" in text:
        for s, e in _addresses(text):
            offer(s, e)
    out.sort(key=lambda t: (t.start, t.end))
    return out


def _blocks(key: str) -> list[str]:
    """What similar keys share: numbers their last digits or one of their halves, addresses the part before the sign."""
    if "@" in key:
        local = key.partition("@")[0]
        return [f"@{local}"] if len(local) > 3 else []
    half = len(key) // 2
    return [*([f"t{key[-TAIL:]}"] if len(key) >= TAIL else []), *([f"a{len(key)} {key[:half]}", f"b{len(key)} {key[half:]}"] if len(key) > 9 else [])]


def similar(a: str, b: str) -> bool:
    """Keys that differ, but not by much: in the digits before the last nine, in one digit, or in the domain of an address."""
    if a == b:
        return False
    if "@" in a or "@" in b:
        return "@" in a and "@" in b and a.partition("@")[0] == b.partition("@")[0]
    return min(len(a), len(b)) >= TAIL and a[-TAIL:] == b[-TAIL:] or len(a) == len(b) > 9 and sum(x != y for x, y in zip(a, b, strict=True)) == 1


def edges(found: list[Token]) -> list[Edge]:
    """Each token with the one before; and, in each block of keys, with the last token and the last known one that it repeats or resembles: never all pairs."""
    out: list[Edge] = [(CHAIN, i, i + 1) for i in range(len(found) - 1)]
    last: dict[tuple[str, bool], int] = {}
    seen: set[tuple[int, int]] = set()
    for i, t in enumerate(found):
        for block in (f"={t.key}", *_blocks(t.key)):
            for known in (False, True):
                j = last.get((block, known))
                if j is not None and (j, i) not in seen and (found[j].key == t.key or similar(found[j].key, t.key)):
                    seen.add((j, i))
                    out.append((SAME if found[j].key == t.key else SIMILAR, j, i))
            last[block, False] = i
            if t.label is not None:
                last[block, True] = i
    return out


def distorted(kind: int, token: str) -> list[str]:
    """A known thing as no pattern finds it: with other signs, without its country, with a mistyped digit or domain."""
    digits = NOT_DIGITS.sub("", token)
    if KINDS[kind] == "email":
        local, _, domain = token.partition("@")
        return [f"{local}@{domain.replace('.', '')}"]
    if KINDS[kind] == "phone":
        national = digits[-10:]
        return [digits, f"{digits[:-10]}({national[:3]}) {national[3:6]}-{national[6:]}", national, f"({national[:3]}) {national[3:6]}-{national[6:]}"]
    at = int(digits[-1]) % len(digits)
    return [".".join(digits[k : k + 4] for k in range(0, len(digits), 4)), digits[:at] + str((int(digits[at]) + 1) % 10) + digits[at + 1 :]]


def training_rows(text: str) -> Iterator[tuple[str, str, int, int, str, float]]:
    """(shape, context, failed, label, labels around, weight): what the labels of the patterns teach about one text.

    `labels around` counts, for each kind of edge, the neighbours of each label. Every known thing also gives
    a distorted repeat of itself. Tokens that repeat or resemble a known thing are not learned from: their
    label is what is looked for.
    """
    found = tokens(text, base_spans(text))
    if not found:
        return
    around = np.zeros((len(found), 3, LABELS), np.int64)
    labels = [OUTSIDE if t.label is None else t.label for t in found]
    unsure = set()
    for kind, i, j in edges(found):
        if kind != CHAIN and (found[i].label is None) != (found[j].label is None):
            unsure.add(i if found[i].label is None else j)
            continue
        around[i, kind, labels[j]] += 1
        around[j, kind, labels[i]] += 1
    for i, t in enumerate(found):
        if i not in unsure:
            yield t.shape, t.context, int(t.label is None), labels[i], ",".join(map(str, around[i].ravel())), 1.0
        if t.label is not None:
            others = distorted(t.label, text[t.start : t.end])
            for other in others:
                linked = around[i].copy()
                linked[1:] = 0
                linked[SAME if _key(other) == t.key else SIMILAR, t.label] = 1
                yield _shape(other), t.context, 1, t.label, ",".join(map(str, linked.ravel())), DISTORTED / len(others)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[tuple, float] = {}
    for batch in batches:
        for text in batch["text"]:
            for *key, weight in training_rows(text or ""):
                counts[tuple(key)] = counts.get(tuple(key), 0.0) + weight
    if counts:
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["shape", "context", "failed", "label", "around", "n"])


def learned(table: pd.DataFrame) -> FieldModel:
    """Potentials of the largest pseudo-likelihood: each label is likely given its own token and the labels around it."""
    n = table["n"].to_numpy(float)
    often = table.groupby("context")["n"].sum()
    names = {"shape": sorted(table["shape"].unique()), "context": sorted(c for c in often.index[often >= LEAST_CONTEXT] if c)}
    shape = np.array([names["shape"].index(x) for x in table["shape"]], np.int64)
    place = {c: i for i, c in enumerate(names["context"])}
    context = np.array([place.get(x, len(place)) for x in table["context"]], np.int64)
    failed, y = table["failed"].to_numpy(float), table["label"].to_numpy(np.int64)
    around = np.array([[int(v) for v in x.split(",")] for x in table["around"]], float).reshape(len(table), 3, LABELS)
    w = {"bias": np.zeros(LABELS), "failed": np.zeros(LABELS), "shapes": np.zeros((len(names["shape"]), LABELS)), "contexts": np.zeros((len(place) + 1, LABELS)), "pairs": np.zeros((3, LABELS, LABELS))}
    moment, spread = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    total = max(n.sum(), 1.0)
    for step in range(1, STEPS + 1):
        score = w["bias"] + failed[:, None] * w["failed"] + w["shapes"][shape] + w["contexts"][context] + np.einsum("nel,elk->nk", around, w["pairs"])
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gap = -p
        gap[np.arange(len(y)), y] += 1
        gap *= (n / total)[:, None]
        up = {k: np.zeros_like(v) for k, v in w.items()}
        up["bias"], up["failed"] = gap.sum(axis=0), (gap * failed[:, None]).sum(axis=0)
        np.add.at(up["shapes"], shape, gap)
        np.add.at(up["contexts"], context, gap)
        both = np.einsum("nel,nk->elk", around, gap)
        up["pairs"] = both + both.transpose(0, 2, 1)
        up["contexts"][-1] = 0
        for k in w:
            g = up[k] - PENALTY * w[k] / LABELS
            moment[k] = 0.9 * moment[k] + 0.1 * g
            spread[k] = 0.99 * spread[k] + 0.01 * g * g
            w[k] = w[k] + 0.1 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.99**step)) + 1e-8) * (1 - step / (STEPS + 1))
    return FieldModel(w["bias"], w["failed"], dict(zip(names["shape"], w["shapes"], strict=True)), {c: w["contexts"][i] for c, i in place.items()}, w["pairs"])


def fit(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FieldModel:
    """Learns the potentials from about `sample_rows` documents, labelled by the fixed patterns, the same rows each time."""
    rows = documents.where(in_sample(F.col("doc_id"), sample_share(documents.count(), sample_rows), "pii")).select("text")
    counted = rows.mapInPandas(_counted, "shape string, context string, failed int, label int, around string, n double")
    keys = ["shape", "context", "failed", "label", "around"]
    return learned(counted.groupBy(*keys).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), *keys).limit(TABLE_ROWS).toPandas())


def node_potentials(found: list[Token], model: FieldModel) -> np.ndarray:
    """Log potentials (tokens, labels) of each token for itself; those of known tokens leave one label."""
    node = np.zeros((len(found), LABELS))
    nothing = np.zeros(LABELS)
    for i, t in enumerate(found):
        if t.label is not None:
            node[i] = -30.0
            node[i, t.label] = 0.0
        else:
            node[i] = model.bias + model.failed + model.shapes.get(t.shape, nothing) + model.contexts.get(t.context, nothing)
    return node


def marginals(node: np.ndarray, links: list[Edge], pairs: np.ndarray) -> np.ndarray:
    """Marginals (tokens, labels) by loopy message passing: exact where the edges make no loop."""
    node = node.copy()
    if links:
        kind, a, b = np.array(links, np.int64).T
        potential = pairs[kind]
        forward, backward = np.zeros((len(links), LABELS)), np.zeros((len(links), LABELS))
        for _ in range(max(ROUNDS, min(len(node), 4 * ROUNDS))):
            belief = node.copy()
            np.add.at(belief, b, forward)
            np.add.at(belief, a, backward)
            to_b = np.logaddexp.reduce((belief[a] - backward)[:, :, None] + potential, axis=1)
            to_a = np.logaddexp.reduce((belief[b] - forward)[:, None, :] + potential, axis=2)
            to_b, to_a = to_b - to_b.max(axis=1, keepdims=True), to_a - to_a.max(axis=1, keepdims=True)
            moved = max(np.abs(to_b - forward).max(), np.abs(to_a - backward).max())
            forward, backward = (DAMPING * old + (1 - DAMPING) * new for old, new in ((forward, to_b), (backward, to_a)))
            if moved < 1e-6:
                break
        np.add.at(node, b, forward)
        np.add.at(node, a, backward)
    node -= node.max(axis=1, keepdims=True)
    p = np.exp(node)
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[Span], model: FieldModel) -> list[Span]:
    """Spans that the field adds to the known ones: what its marginals hold for personal data. Without an unknown token there is nothing to add."""
    found = tokens(text, base)
    if all(t.label is not None for t in found):
        return []
    p = marginals(node_potentials(found, model), edges(found), model.pairs)
    best = p.argmax(axis=1)
    return [(int(k), t.start, t.end) for t, k, q in zip(found, best, p, strict=True) if t.label is None and k != OUTSIDE and q[k] >= ADD_AT]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _found(model: FieldModel):
    def compute(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {**{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": []}
        for text in texts:
            base = base_spans(text)
            for i, k in enumerate(KINDS):
                out[f"n_{k}"].append(sum(s[0] == i for s in base))
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["spans"].append(listed(base + added_spans(text, base, model)))
        return out

    return lambda: compute


def find_personal_data(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and base_sha256 are those of the fixed patterns; `spans` also has what the field adds: tokens
    that no pattern finds and that it holds for personal data by their form, the word before them and the
    labels of the tokens that they stand beside, repeat or resemble. Its time grows with the tokens of a text. Offsets are code points, ends
    exclusive. Null and empty texts have no spans (base_sha256 of the empty string, spans ""). Repeated
    rows give repeated rows, an empty table none; other columns are not read.
    """
    model = fit(documents)
    schema = ", ".join([*(f"n_{k} long" for k in KINDS), "base_sha256 string, spans string"])
    return with_text_columns(documents.select("doc_id", "text"), _found(model), schema)
