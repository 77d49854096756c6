"""Multilingual mixture inference: each document's language proportions by expectation-maximisation.

Learning counts hashed letter trigrams of every labelled training document per language (one row per task,
language and trigram is shuffled). For a document, runs of trigrams are the observations; their likelihoods
under each language drive EM for the document's proportions. The set of languages is chosen by penalised
likelihood: nested sets of the strongest languages are refitted, up to all of them, and a further language must pay
two plus half the logarithm of the number of runs. A document is done when its best run by run likelihood could not pay for a
larger set. The strongest language of the chosen set is the prediction. Its score is the expected share of the text in that language: its
proportion times the posterior, among all learnt languages alike, of that language on the runs credited to it.

The model holds BUCKETS floats per language (256 KiB each), whatever the corpus size.

Defined cases: a null text, or one without a letter, or an empty training set gives ``und`` with score 0; a null lang
is not learnt from; a null doc_id counts as the empty text for the split; very long texts are one document at a
time; ties go to the language that sorts first; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import crc_mod, documents, rows_of, ship

BUCKETS = 1 << 16
#: Trigrams in a run, weight of a trigram (three neighbours overlap), EM rounds.
RUN, TEMPER, ROUNDS = 24, 1 / 3, 12
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-cased code point of every letter, 0 for all else."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(ch.lower()[0])
    return table


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram with a letter in its middle, and the index of its text."""
    joined = "\n" + "\n".join(t or "" for t in texts) + "\n"
    letters = _letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4")]
    ends = np.cumsum(np.fromiter((len(t or "") + 1 for t in texts), dtype=np.int64, count=len(texts)))
    at = np.flatnonzero(letters[1:-1]) + 1
    with np.errstate(over="ignore"):
        mixed = letters[at - 1] * np.uint32(0x9E3779B1) ^ letters[at] * np.uint32(0x85EBCA77) ^ letters[at + 1] * np.uint32(0xC2B2AE3D)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(16)).astype(np.int64), np.searchsorted(ends, at, side="left")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for langs, texts in rows_of(batches, "lang", "text"):
        for lang in dict.fromkeys(langs):
            buckets, _ = trigrams([t for t, x in zip(texts, langs, strict=True) if x == lang])
            counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            counts[lang] += np.bincount(buckets, minlength=BUCKETS)
    for lang, n in counts.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], names=["lang", "bucket", "n"])


class LanguageModel:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        total = counts.sum(axis=1, keepdims=True) if langs else counts
        self.logp = np.ascontiguousarray((np.log((counts + 0.5) / (total + 0.5 * BUCKETS)) * TEMPER).T.astype(np.float32))

    def mixtures(self, texts: list[str | None]) -> list[list[tuple[str, float]]]:
        """(language, proportion) of the chosen set of each text, strongest first; empty when there is nothing to judge."""
        return [mixture for mixture, _ in self.judged(texts)]

    def judged(self, texts: list[str | None]) -> list[tuple[list[tuple[str, float]], float]]:
        """Mixture and score of each text."""
        out: list[tuple[list[tuple[str, float]], float]] = [([], 0.0) for _ in texts]
        buckets, owner = trigrams(texts)
        if not len(buckets) or not self.langs:
            return out
        new = np.flatnonzero(np.diff(owner, prepend=-1))  # first trigram of each text that has any
        docs, n = owner[new], np.diff(np.append(new, len(owner)))
        within = np.arange(len(owner)) - np.repeat(new, n)
        starts = np.flatnonzero(within % RUN == 0)
        likelihood = np.add.reduceat(self.logp[buckets], starts, axis=0).astype(np.float64)
        runs = (n + RUN - 1) // RUN
        first, of = np.append(0, np.cumsum(runs)[:-1]), np.repeat(np.arange(len(docs)), runs)
        top = likelihood.max(axis=1, keepdims=True)
        weight = np.exp(likelihood - top)

        def fit(share: np.ndarray, rounds: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Refitted shares of the documents ``some`` (ascending) and their log-likelihoods."""
            n, own = runs[some], np.isin(of, some)
            begin, to, w = np.append(0, np.cumsum(n)[:-1]), np.repeat(np.arange(len(some)), n), weight[own]
            for _ in range(rounds):
                joint = w * share[to] + 1e-300
                joint /= joint.sum(axis=1, keepdims=True)
                share = np.where(share > 0, np.add.reduceat(joint, begin, axis=0) / n[:, None], 0)
            seen = np.log((w * share[to]).sum(axis=1) + 1e-300) + top[own, 0]
            return share, np.add.reduceat(seen, begin)

        k = len(self.langs)
        left = np.arange(len(docs))
        share, _ = fit(np.full((len(docs), k), 1 / k), ROUNDS, left)
        order = np.argsort(-share, axis=1, kind="stable")
        best_value = np.full(len(docs), -np.inf)
        best = np.zeros_like(share)
        most, cost = np.add.reduceat(top[:, 0], first), 2 + 0.5 * np.log(runs)  # no mixture is likelier than the best language of each run
        for size in range(1, k + 1):
            left = left[most[left] - (size - 1) * cost[left] > best_value[left]]
            if not len(left):
                break
            allowed = np.zeros((len(left), k))
            np.put_along_axis(allowed, order[left, :size], 1 / size, axis=1)
            fitted, value = fit(allowed, ROUNDS if size > 1 else 0, left)
            value = value - (size - 1) * cost[left]
            better = value > best_value[left]
            at = left[better]
            best_value[at], best[at] = value[better], fitted[better]
        strongest = best.argmax(axis=1)
        joint = weight * best[of]
        credit = joint[np.arange(len(of)), strongest[of]] / joint.sum(axis=1)
        total = np.add.reduceat(likelihood * credit[:, None], first, axis=0)
        sure = np.exp(total - total.max(axis=1, keepdims=True))
        sure /= sure.sum(axis=1, keepdims=True)
        for i, d in enumerate(docs):
            x = strongest[i]
            out[d] = [(self.langs[x], float(best[i, x])) for x in np.argsort(-best[i], kind="stable") if best[i, x] > 0], min(1.0, float(best[i, x] * sure[i, x]))
        return out


def learn(docs: DataFrame) -> LanguageModel:
    """Trigram counts per language of all rows of ``docs`` whose lang is known."""
    ship(docs.sparkSession)
    counts = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").mapInArrow(_count, "lang string, bucket bigint, n bigint")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows per language
    langs = sorted(rows["lang"].unique())
    table = np.zeros((len(langs), BUCKETS))
    table[rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int), rows["bucket"].to_numpy(dtype=int)] = rows["n"]
    return LanguageModel(langs, table)


def predict(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """``key``, ``lang_pred``, ``score``, ``mixture`` for the columns ``key`` and ``text`` of ``texts``.

    Without a column ``text``, the key is a struct that holds it.
    """
    ship(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS floats per language
    kind = texts.schema["key"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            key = batch.schema.field("key").type
            schema = pa.schema([("key", key), ("lang_pred", pa.string()), ("score", pa.float64()), ("mixture", pa.map_(pa.string(), pa.float64()))])
            keys = batch.column(batch.schema.get_field_index("key"))
            if "text" not in batch.schema.names:
                batch = batch.append_column("text", keys.field(keys.type.get_field_index("text")))
            at = 0
            for (some,) in rows_of(iter([batch]), "text", limit=1 << 20):
                found = shared.value.judged(some)
                judged = [[m[0][0] if m else UNKNOWN for m, _ in found], [score for _, score in found], [m for m, _ in found]]
                columns = [pa.array(c, type=f.type) for c, f in zip(judged, list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(some)), *columns], schema=schema)
                at += len(some)

    return texts.mapInArrow(judge, f"key {kind}, lang_pred string, score double, mixture map<string,double>")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod("doc_id", 4) != 2)


def held_out() -> Column:
    return crc_mod("doc_id", 4) == 2


def identified(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as struct ``doc`` with lang_pred, score and mixture; learnt from its training rows."""
    model = learn(training_rows(docs))
    return predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("key")), model).withColumnRenamed("key", "doc")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(training_rows(docs))
    return predict(docs.select(F.col("doc_id").alias("key"), "text"), model).withColumnRenamed("key", "doc_id").select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "mixture"
    )
