"""Toxicity scores of texts whose obfuscations a noisy channel has undone."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut_narrow, small_batches, with_maybe, with_text_columns, written
from strandline.llm.langid import held_out

FEATURES = 256
LEAST_ROWS = 4
ALPHABET = 64
THRESHOLD = 0.7
CACHED_TOKENS = 100_000
DECIMALS = 9  # of weights: sums over tasks come in any order
LONGEST_RUN = 8  # more symbols than that in a row stand for no letters
SPACED = 3  # letters by themselves that may make a word

# What a symbol may stand for, and what writing it so costs (negative log probability).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
SWAP, DROP_REPEAT, DROP_DOUBLE, DROP_SYMBOL, DROP_GAP, BREAK_SYMBOL, BREAK_GAP = 1.0, 0.7, 4.0, 10.0, 0.3, 5.0, 0.0

WORD = re.compile(r"[^\W\d_]+")
TWICE = re.compile(r"([^\W\d_])\1")
UNSURE = re.compile(r"(?<=([^\W\d_]))\1|[\W\d_]")
RUN = re.compile(r"[^\W\d_]+|[\W\d_]+")
CLOSING = re.compile(r"(?:[.,;:?)\"'!]|([^\w\s])\1\1+)+\Z")
CLOSERS = ".,;:?)\"'!"
ADDRESS = re.compile(r"@[^@]*\.")
EDGE = "  "

@dataclass
class CharModel:
    """Trigram model of letters, with a blank at either end of a word."""

    cost: dict[str, float]
    unseen: float

    def of(self, gram: str) -> float:
        return self.cost.get(gram, self.unseen)

    @cached_property
    def dearest(self) -> float:
        return max(self.unseen, max(self.cost.values(), default=0.0))


@dataclass
class ToxicityModel:
    letters: CharModel
    weights: dict[str, float]
    bias: float


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """For each character what it may stand for, each with its cost: a letter, nothing (""), or the border of two words (" ")."""
    for run in RUN.finditer(token):
        start, end = run.span()
        symbols = not token[start].isalpha()
        for i in range(start, end):
            c = token[i]
            again = DROP_REPEAT if c * 3 in token[max(0, i - 2) : i + 3] else DROP_DOUBLE
            if not symbols:
                yield [(c, 0.0), ("", again)] if i and token[i - 1] == c else [(c, 0.0)]
            elif c not in LEET or end - start > LONGEST_RUN:
                yield [(" ", BREAK_GAP)] if end - start > LONGEST_RUN else [("", DROP_GAP if not c.isalnum() else DROP_SYMBOL), (" ", BREAK_GAP)]
            else:
                yield [*((x, SWAP) for x in LEET[c]), ("", again if i and token[i - 1] == c else DROP_SYMBOL), (" ", BREAK_SYMBOL)]


def decode(token: str, model: CharModel, known: dict[tuple[str, str, bool], str] | None = None) -> str:
    """The likeliest words that the token may stand for, by Viterbi over its lattice.

    A state is the last two letters. After two letters that stand for nothing but themselves all paths are in
    one state; so what lies between such letters is decoded for itself, and `known` keeps it. Time follows the
    length of the token.
    """
    spots = [m.start() for m in UNSURE.finditer(token)]
    out: list[str] = []
    at = done = 0
    while at < len(spots):
        first = last = spots[at]
        while at < len(spots) and spots[at] - last <= 2:
            last = spots[at]
            at += 1
        end = min(len(token), last + 3)
        key = (token[max(0, first - 2) : first], token[first:end], end - last < 3)
        part = known.get(key) if known is not None else None
        if part is None:
            part = _between(*key, model)
            if known is not None and len(key[1]) < 20 and len(known) < CACHED_TOKENS:
                known[key] = part
        out += [token[done:first], part]
        done = end
    return "".join([*out, token[done:]]).strip()


def _between(before: str, part: str, closing: bool, model: CharModel) -> str:
    """Decodes `part`, which follows the letters `before` (none at the beginning of a token) and, if `closing`, ends the token.

    Back pointers hold the open part of a path; where all paths meet in one state, what lies behind is
    settled. A path is given up only if no continuation can make up for its cost: two letters on it would be
    in the same state as the best one.
    """
    settled: list[str] = []
    # state: cost, and (letter, what came before) since paths last met
    paths: dict[str, tuple[float, tuple | None]] = {(EDGE + before)[-2:]: (0.0, None)}
    hopeless = 2 * model.dearest

    def settle(link: tuple | None) -> None:
        letters = []
        while link:
            letters.append(link[0])
            link = link[1]
        settled.extend(reversed(letters))

    for options in islice(lattice(before + part), len(before), None):
        if len(paths) == 1:
            [(state, (_, link))] = paths.items()
            settle(link)
            paths = {state: (0.0, None)}
        step: dict[str, tuple[float, tuple | None]] = {}
        for state, (cost, link) in paths.items():
            for letter, price in options:
                if not letter or letter == " " and state == EDGE:
                    to, cost_, link_ = state, cost + price, link
                else:
                    to = EDGE if letter == " " else state[1] + letter
                    cost_, link_ = cost + price + model.of(state + letter), (letter, link)
                if to not in step or cost_ < step[to][0]:
                    step[to] = (cost_, link_)
        best = min(cost for cost, _ in step.values())
        paths = {state: path for state, path in step.items() if path[0] <= best + hopeless}
    settle(min((cost + (model.of(state + " ") if closing and state != EDGE else 0.0), state, link) for state, (cost, link) in paths.items())[2])
    return "".join(settled)


def restored(token: str, model: CharModel, known: dict[tuple[str, str, bool], str] | None = None) -> str:
    """A token in lower case as words of letters, where a decoding of it is likelier than its plain reading; else the token."""
    if token.isalpha():
        if not TWICE.search(token):
            return token
        return decode(token, model, known)
    body = CLOSING.sub("", token)
    if not WORD.search(body) or ADDRESS.search(body):
        return token  # nothing but digits and signs, or an address
    found = decode(body, model, known)
    return token if found.split() == WORD.findall(body) else found


class Reader:
    """The words of texts in lower case, obfuscated ones restored. Frequent tokens are restored once."""

    def __init__(self, model: CharModel):
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}
        self.parts: dict[tuple[str, str, bool], str] = {}
        self.alone: dict[str, str] = {}  # tokens of one letter, with or without signs, and tokens of signs

    def of_token(self, token: str) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            found = tuple(WORD.findall(restored(token, self.model, self.parts)))
            if len(token) <= 64 and len(self.known) < CACHED_TOKENS:
                self.known[token] = found
        return found

    def _alone(self, token: str) -> str | None:
        if len(token) > 2:
            return None
        found = self.alone.get(token)
        if found is None:
            kept = [c for c in token if c.isalnum() or c in "@$"]
            found = self.alone[token] = "?" if len(kept) > 1 else "".join(kept)
        return None if found == "?" else found

    def spaced(self, tokens: list[str]) -> Iterator[tuple[int, int, str]]:
        """(first, end, word) of runs of at least `SPACED` letters by themselves, read as one token."""
        first, letters = 0, ""
        for at, token in enumerate([*tokens, "    "]):
            c = self._alone(token)
            if c is not None:
                if not letters:
                    first = at
                letters += c
            elif letters:
                if len(letters) >= SPACED and WORD.search(letters):
                    yield first, at, decode("-".join(letters), self.model)
                letters = ""

    def runs(self, tokens: list[str]) -> Iterator[str]:
        """The words of the runs of letters by themselves; three short tokens in a row are the least there must be."""
        short = [i for i, t in enumerate(tokens) if len(t) < 3]
        if any(b - a == SPACED - 1 for a, b in zip(short, short[SPACED - 1 :], strict=False)):
            for _, _, run in self.spaced(tokens):
                yield from run.split()

    def words(self, text: str) -> set[str]:
        tokens = text.lower().split()
        return {w for token in set(tokens) for w in self.of_token(token)}.union(self.runs(tokens))


def restore(text: str, model: CharModel) -> str:
    """The text in lower case with its obfuscated tokens restored; white space between tokens becomes one blank."""
    reader, tokens = Reader(model), text.lower().split()
    out, done = [], 0
    for first, end, run in reader.spaced(tokens):
        out += [*(restored(t, model) for t in tokens[done:first]), run]
        done = end
    return " ".join([*out, *(restored(t, model) for t in tokens[done:])])


def features(word: str) -> list[str]:
    """The word, and its beginnings of 3 to 7 letters."""
    return [f"{word}$", *(word[:n] for n in range(3, min(7, len(word)) + 1))]


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[str] = Counter()
    words: Counter[str] = Counter()

    def fold() -> None:
        for word, n in words.items():
            padded = f"  {word} "
            for i in range(len(padded) - 2):
                counts[padded[i : i + 3]] += n
        words.clear()

    for batch in batches:
        for text in batch["text"]:
            words.update(WORD.findall((text or "").lower()))
            if len(words) > CACHED_TOKENS:
                fold()
    fold()
    yield pd.DataFrame({"gram": pd.Series(list(counts), dtype=object), "n": pd.Series(list(counts.values()), dtype="int64")})


def fit_letters(rows: DataFrame) -> CharModel:
    """Costs of letter trigrams in the rows (text); letters beyond the `ALPHABET` most frequent have the cost of unseen ones."""
    table = rows.mapInPandas(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(ALPHABET**2 * 8).toPandas()
    before: dict[str, int] = {}
    for gram, n in zip(table["gram"], table["n"], strict=True):
        before[gram[:2]] = before.get(gram[:2], 0) + n
    cost = {gram: -math.log((n + 0.5) / (before[gram[:2]] + 0.5 * ALPHABET)) for gram, n in zip(table["gram"], table["n"], strict=True)}
    return CharModel(cost, 9.0)


def _read(letters: CharModel):
    def make():
        reader = Reader(letters)
        return lambda texts: {"words": [" ".join(sorted(reader.words(t))) for t in texts]}

    return make


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many clean and toxic rows each feature is; the rows hold each of their words once."""
    known: dict[str, list[str]] = {}
    counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

    def told() -> pd.DataFrame:
        names = list(counts[0].keys() | counts[1].keys())
        out = pd.DataFrame({"feature": pd.Series(names, dtype=object), "clean": [counts[0][f] for f in names], "toxic": [counts[1][f] for f in names]})
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in batches:
        for words, toxic in zip(batch["words"], batch["toxic"], strict=True):
            own: set[str] = set()
            for word in words.split():
                if (found := known.get(word)) is None:
                    found = features(word)
                    if len(known) < CACHED_TOKENS:
                        known[word] = found
                own.update(found)
            counts[int(toxic)].update(own)
        if len(counts[0]) + len(counts[1]) > 10 * CACHED_TOKENS:
            yield told()
    if counts[0] or counts[1]:
        yield told()


def _wanted(wanted: dict[str, int]):
    """The numbers of the wanted features of each row, in order."""
    beginnings = {f[:3].rstrip("$") for f in wanted}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted({wanted[f] for w in words.split() if w[:3] in beginnings for f in features(w) if f in wanted}) for words in batch["words"]]
            yield pd.DataFrame({"toxic": batch["toxic"].astype("int32"), "found": pd.Series(found, dtype=object)})

    return run


def _slopes(w: np.ndarray):
    """Sums over a task of the likelihood's first (in column `len(w)`) and second derivatives at these weights."""
    size = len(w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((size, size + 1))
        for batch in batches:
            x = np.zeros((len(batch), size))
            x[:, -1] = 1
            for i, found in enumerate(batch["found"]):
                x[i, found] = 1
            y, n = batch["toxic"].to_numpy(float), batch["n"].to_numpy(float)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            sums[:, :size] += (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x
            sums[:, size] += x.T @ (n * (y - p))
        i, j = np.nonzero(sums)
        yield pd.DataFrame({"i": i, "j": j, "value": sums[i, j]})

    return run


def fit_weights(rows: DataFrame, size: int) -> np.ndarray:
    """Weights of `size` features and the bias, by penalised logistic regression over all rows (toxic, found, n): Newton steps, of which tasks make the sums."""
    w = np.zeros(size + 1)
    penalty = np.r_[np.full(size, 0.01), 1e-6]
    for _ in range(25):
        told = rows.mapInPandas(_slopes(w), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()  # the square of the features at most
        sums = np.zeros((size + 1, size + 2))
        sums[told["i"], told["j"]] = told["value"]
        step = np.linalg.solve(sums[:, :-1] + np.diag(penalty), sums[:, -1] - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return w.round(DECIMALS)


def fit(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns from all labelled rows (doc_id, toxic).

    The letters' trigrams come from the same rows. Words and beginnings of words with the highest
    likelihood ratio become features of a logistic regression. Texts are decoded once; rows with the same
    features count together.
    """
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    # texts that have no label do not shuffle
    texts = with_maybe(documents.select("doc_id", "text"), labels.select("doc_id"), "doc_id").where("maybe").select("doc_id", "text")
    small_batches(documents.sparkSession)
    rows = written(texts.join(labels, "doc_id").select("toxic", "text"), "labelled")
    letters = fit_letters(rows)
    total = {int(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()}
    clean, toxic = total.get(0, 0), total.get(1, 0)
    if not clean or not toxic:
        return ToxicityModel(letters, {}, 8.0 if toxic else -8.0)
    rows = written(with_text_columns(rows, _read(letters), "words string"), "words")
    counted = rows.mapInPandas(_counted, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    a, b = F.col("toxic") + F.lit(0.0), F.col("clean") + F.lit(0.0)
    share = (a + b) / (clean + toxic)
    ratio = a * F.log((a + 1e-9) / (toxic * share)) + b * F.log((b + 1e-9) / (clean * share))
    chosen = [r["feature"] for r in counted.where((a + b >= LEAST_ROWS) & (a / toxic > b / clean)).orderBy(F.desc(ratio), "feature").limit(FEATURES).collect()]
    wanted = {f: i for i, f in enumerate(chosen)}
    found = rows.mapInPandas(_wanted(wanted), "toxic int, found array<int>")
    w = fit_weights(cut_narrow(found.groupBy("toxic", "found").agg(F.count("*").alias("n"))), len(chosen))
    return ToxicityModel(letters, dict(zip(chosen, w[:-1].tolist(), strict=True)), float(w[-1]))


def _scored(model: ToxicityModel):
    def make():
        reader, weights = Reader(model.letters), model.weights
        beginnings = {f[:3].rstrip("$") for f in weights}  # every feature of a word begins like it
        known: dict[str, tuple[str, ...]] = {}

        def of_words(words: Iterable[str]) -> tuple[str, ...]:
            return tuple(f for word in words if word[:3] in beginnings for f in features(word) if f in weights)

        def of_token(token: str) -> tuple[str, ...]:
            body = token if token.isalpha() else token.rstrip(CLOSERS)
            if body.isalpha() and body[:3] not in beginnings and not TWICE.search(body[:3]):
                return ()  # whatever letters further on drop out, it begins as no feature does
            found = of_words(reader.of_token(token))
            if len(token) <= 64 and len(known) < CACHED_TOKENS:
                known[token] = found
            return found

        def score(text: str) -> float:
            tokens = text.lower().split()
            present = set(of_words(reader.runs(tokens)))
            for token in set(tokens):
                if (found := known.get(token)) is None:
                    found = of_token(token)
                if found:
                    present.update(found)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + sum(weights[f] for f in sorted(present))))))

        return lambda texts: {"score": [score(t) for t in texts]}

    return make


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score of 0.7 or more).

    Null and empty texts get the score of a text without any feature. Labels of rows whose CRC-32 of the
    id, mod 3, is 1 are never learned; neither are null labels. With labels of one kind only, all scores
    are near that kind. Repeated rows are scored each; extra columns are not read.
    """
    model = fit(documents, labels.where(~held_out(3, 1)))
    rows = documents.select("doc_id", held_out(3, 1).alias("held_out"), "text")
    rows = with_text_columns(rows, _scored(model), "score double")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
