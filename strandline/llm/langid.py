"""Language identification as inference of a mixture of languages in each document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import in_sample, sample_share, with_text_columns

BUCKETS = 1 << 16
ROWS_A_LANGUAGE = 2000
BLOCK_CHARS = 1_500_000
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # (BUCKETS, languages): log probability of a hashed trigram


def letters_below(limit: int = 1 << 16) -> np.ndarray:
    """Which code points are letters; those of the higher planes count as letters."""
    return np.array([chr(c).isalpha() for c in range(limit)])


def trigrams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every letter of the text its place and the hashed trigram around it; what is no letter counts as a blank."""
    codes = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    is_letter = np.where(codes < len(letters), letters[np.minimum(codes, len(letters) - 1)], True)
    codes[~is_letter] = 32
    place = np.flatnonzero(is_letter)
    with np.errstate(over="ignore"):
        mixed = codes[place - 1] * np.uint32(0x9E3779B1) + codes[place] * np.uint32(0x85EBCA77) + codes[place + 1] * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
    return place, (mixed >> np.uint32(16)).astype(np.int64)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    letters = letters_below()
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            own += np.bincount(trigrams(text.lower(), letters)[1], minlength=BUCKETS)
    for lang, own in counts.items():
        used = np.flatnonzero(own)
        yield pd.DataFrame({"lang": lang, "bucket": used, "n": own[used]})


def fit(labelled: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE) -> LanguageModel:
    """Learns trigram counts from about `rows_a_language` rows (doc_id, text, lang) of each language, the same rows each time.

    A model has `BUCKETS` numbers a language, 256 KiB; every language that there are rows of is learned.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    share = F.lit(0.0)
    for r in seen:
        share = F.when(F.col("lang") == r["lang"], sample_share(r["count"], rows_a_language)).otherwise(share)
    rows = labelled.where(in_sample(F.col("doc_id"), share, "language")).select("lang", "text")
    table = rows.mapInPandas(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    counts = np.full((BUCKETS, len(languages)), 0.05)
    for k, lang in enumerate(languages):
        own = table[table["lang"] == lang]
        counts[own["bucket"], k] += own["n"]
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32) if languages else np.zeros((BUCKETS, 0), np.float32))


def _mixture(p: np.ndarray, n: np.ndarray, starts: np.ndarray, size: np.ndarray, pi: np.ndarray, rounds: int) -> np.ndarray:
    """Expectation-maximisation of the proportions of every document at once. p: each word's likelihoods; n: how often it stands there."""
    lengths = np.diff(np.r_[starts, len(p)])
    for _ in range(rounds):
        q = p * np.repeat(pi, lengths, axis=0)
        q *= (n / np.maximum(q.sum(axis=1), 1e-30))[:, None]
        pi = np.add.reduceat(q, starts, axis=0) / size[:, None]
    return pi


def _words(text: str, model: LanguageModel, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, log probabilities by language) of every run of letters."""
    place, gram = trigrams(text, letters)
    if not len(place):
        return place, place, np.zeros((0, len(model.languages)), np.float32)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1] + 1
    first = np.flatnonzero(new)
    with np.errstate(over="ignore"):
        nth = (np.arange(len(place)) - np.repeat(first, np.diff(np.r_[first, len(place)]))).astype(np.uint64)
        hashes = np.add.reduceat((gram.astype(np.uint64) + nth * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1342543DE82EF95) ^ (nth << np.uint64(32)), first)
    return place[first], hashes, np.add.reduceat(model.log_p[gram], first, axis=0)


def _of_sets(log_p: np.ndarray, n: np.ndarray, starts: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions (documents, languages) for words in the order of their documents: of the set of languages with the best penalised likelihood.

    Sets grow by the language with the next largest share, document by document, as long as the likelihood
    rises by more than the penalty.
    """
    top = log_p.max(axis=1, keepdims=True)
    relative = log_p - top
    p = np.exp(relative)
    k = log_p.shape[1]
    size = np.add.reduceat(n, starts)
    pi = _mixture(p, n, starts, size, np.full((len(starts), k), 1 / k, np.float32), rounds)
    order = np.argsort(-pi, axis=1, kind="stable")
    alone = np.add.reduceat(relative * n[:, None], starts, axis=0)
    best, chosen = alone.max(axis=1), np.eye(k)[alone.argmax(axis=1)]
    lengths = np.diff(np.r_[starts, len(p)])
    growing = np.arange(len(starts))
    for m in range(2, k + 1):
        mine = np.isin(np.repeat(np.arange(len(starts)), lengths), growing) if len(growing) < len(starts) else slice(None)
        own, weight = p[mine], n[mine]
        begin = np.r_[0, np.cumsum(lengths[growing])[:-1]]
        mask = np.zeros((len(growing), k))
        np.put_along_axis(mask, order[growing, :m], 1, axis=1)
        start = np.maximum(pi[growing], 1e-3) * mask
        some = _mixture(own, weight, begin, size[growing], start / start.sum(axis=1, keepdims=True), 4)
        mixed = np.log(np.maximum((own * np.repeat(some, lengths[growing], axis=0)).sum(axis=1), 1e-30))
        fit_ = np.add.reduceat(mixed * weight, begin) - (m - 1) * np.log(size[growing] + 1.0)
        better = fit_ > best[growing]
        growing = growing[better]
        if not len(growing):
            break
        best[growing], chosen[growing] = fit_[better], some[better]
    return chosen


def proportions(texts: list[str], model: LanguageModel, letters: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Proportions (documents, languages): those of the set of languages whose penalised likelihood is best; zeros without a letter."""
    out = np.zeros((len(texts), len(model.languages)))
    if not len(model.languages):
        return out
    place, _, log_p = _words("\n".join(texts), model, letters)
    if len(place):
        bounds = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(bounds, place - 1, side="right")
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[doc[starts]] = _of_sets(log_p, np.ones(len(place), np.float32), starts, rounds)
    return out


def proportions_of_long(text: str, model: LanguageModel, letters: np.ndarray, rounds: int = 10, block_chars: int = BLOCK_CHARS) -> np.ndarray:
    """As `proportions`, of one long text: block by block its words meet in a table of distinct words, so memory follows these."""
    known, n, log_p = np.zeros(0, np.uint64), np.zeros(0, np.float64), np.zeros((0, len(model.languages)), np.float32)
    at = 0
    while at < len(text) and len(model.languages):
        end = min(len(text), at + block_chars)
        while at < end < len(text) and text[end].isalpha() and text[end - 1].isalpha() and end > at + block_chars // 2:
            end -= 1
        _, hashes, own = _words(text[at:end], model, letters)
        known, first, of = np.unique(np.concatenate([known, hashes]), return_index=True, return_inverse=True)
        n, log_p = np.bincount(of, np.concatenate([n, np.ones(len(hashes))]), minlength=len(known)), np.concatenate([log_p, own])[first]
        at = end
    return _of_sets(log_p, n, np.zeros(1, np.int64), rounds)[0] if len(known) else np.zeros(len(model.languages))


def _predicted(model: LanguageModel):
    def make():
        letters = letters_below()

        def compute(texts: list[str]) -> dict[str, list]:
            texts = [t.lower() for t in texts]
            found: list[str] = []
            score: list[float] = []
            def told(shares: np.ndarray) -> None:
                best = int(shares.argmax()) if len(shares) else 0
                known = len(shares) > 0 and shares[best] > 0
                found.append(model.languages[best] if known else UNDETERMINED)
                score.append(min(1.0, float(shares[best])) if known else 0.0)

            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and chars + len(texts[end]) <= BLOCK_CHARS:
                    chars += len(texts[end])
                    end += 1
                for shares in proportions(texts[at:end], model, letters):
                    told(shares)
                if end == at:
                    told(proportions_of_long(texts[at], model, letters))
                    end += 1
                at = end
            return {"lang_pred": found, "score": score}

        return compute

    return make


def predict(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """The columns of `rows` but the last, the text, and lang_pred and score for every row; only the text decides.

    score is the share of the predicted language among the document's words. Null, empty and letterless
    texts are `und` with score 0; so is everything where nothing could be learned.
    """
    return with_text_columns(rows, _predicted(model), "lang_pred string, score double")


def held_out(modulus: int, remainder: int) -> Column:
    """Documents never learned from: by the CRC-32 of the id as text; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def identify_languages(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; see `predict`. Null ids are never learned from."""
    model = fit(documents.where(F.col("doc_id").isNotNull() & ~held_out(4, 2)).select("doc_id", "text", "lang"))
    return predict(documents.select("doc_id", held_out(4, 2).alias("held_out"), "text"), model)


def keep_identified(documents: DataFrame, least: float = 0.25) -> DataFrame:
    """Documents of which one language makes up at least the share `least`, with all their columns.

    Goes: texts without letters, and texts in which no language has that share.
    """
    model = fit(documents.where(F.col("doc_id").isNotNull() & ~held_out(4, 2)).select("doc_id", "text", "lang"))
    # the text passes once, not a second time inside the row
    others = [f"`{c.replace('`', '``')}`" for c in documents.columns if c != "text"]
    rows = documents.select(F.struct(*others).alias("row"), "text")
    told = with_text_columns(rows, _predicted(model), "lang_pred string, score double", keep_text=True)
    kept = told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return kept.select(*["text" if c == "text" else F.col("row").getField(c).alias(c) for c in documents.columns])
