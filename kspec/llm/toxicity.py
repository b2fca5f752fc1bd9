"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts have labels that are used; all other text is unlabelled, toxic or not. With class prior pi, positives P and unlabelled U the
risk of a score g is  pi * E_P[loss(g)] + max(0, E_U[loss(-g)] - pi * E_P[loss(-g)]).  The second part estimates the risk on clean texts; where it would turn
negative - a model that has begun to learn single texts by heart - the step goes against it. The model is linear over words and the beginnings of words, trained in
numpy on bounded samples; scoring reads every text whole."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, carried_id, modest_batches, restored_id, text_of, written

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Lengths of beginnings in characters, and how often a beginning must occur for each of its features.
STEMS, LEVELS = range(3, 8), ((1, b"*"), (2, b"*2"), (4, b"*4"))
MEMO_WORDS = 200_000


def words_of(text: str) -> list[bytes]:
    """The words of a whole text, repeats included: runs of letters, lower case; any character beyond ASCII counts as a letter."""
    return text.lower().encode("utf-8", "replace").translate(_LETTERS).split()


def stems_of(word: bytes) -> list[bytes]:
    """The beginnings of a word, of three to seven characters."""
    s = word[: 4 * max(STEMS)].decode("utf-8", "ignore")
    return [s[:k].encode() for k in STEMS if k <= len(s)]


def counted(words: Counter[bytes]) -> set[bytes]:
    """Features of a text: its words, and each beginning as often as words have it: once (`*`), twice or more (`*2`), four times or more (`*4`). An inflected insult
    shows in its beginning; a word that has the same beginning by chance rarely comes again."""
    stems: Counter[bytes] = Counter()
    for word, n in words.items():
        for stem in stems_of(word):
            stems[stem] += n
    return words.keys() | _leveled(stems)


def _leveled(stems: Counter[bytes]) -> set[bytes]:
    return {stem + mark for stem, n in stems.items() for least, mark in LEVELS if n >= least}


def feature_key(feature: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(feature, 1) >> 1


@dataclass
class Model:
    """weights: feature -> weight. The memo of words holds at most MEMO_WORDS and doesn't change a score."""

    weights: dict[bytes, float]
    bias: float
    prior: float
    memo: dict[bytes, list[bytes]] = field(default_factory=dict, compare=False, repr=False)

    @cached_property
    def watched(self) -> frozenset[bytes]:
        return frozenset(f.split(b"*")[0] for f in self.weights if b"*" in f)

    def score(self, text: str) -> float:
        weights, memo, watched = self.weights, self.memo, self.watched
        words, stems = Counter(words_of(text)), Counter()
        for word, n in words.items():
            known = memo.get(word)
            if known is None:
                known = [s for s in stems_of(word) if s in watched]
                if len(word) <= 64:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[word] = known
            for stem in known:
                stems[stem] += n
        g = self.bias + sum(sorted(weights[f] for f in (words.keys() | _leveled(stems)) & weights.keys()))
        return float(1 / (1 + np.exp(-np.clip(g, -30, 30))))


def nnpu_train(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, *, steps: int = 400, rate: float = 0.05, decay: float = 3e-3, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk. rows: the features (presence) of each text; positive: which are confirmed, the others are unlabelled."""
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    columns = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    w, first, second = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    for step in range(1, steps + 1):
        g = np.bincount(owner, weights=w[columns], minlength=len(rows)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        loss_clean = np.logaddexp(0, g)  # of calling a text clean that scores g
        clean_risk = loss_clean[~positive].mean() - prior * loss_clean[positive].mean() if n_u else 0.0
        toward_clean = np.where(positive, -prior * p / n_p, p / n_u)
        if clean_risk >= -beta:
            slope = np.where(positive, prior * (p - 1) / n_p, 0.0) + toward_clean
        else:
            slope = -toward_clean
        grad = np.append(np.bincount(columns, weights=slope[owner], minlength=n_features), slope.sum())
        grad[:-1] += decay * w[:-1] * 0.1
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def fit(
    docs: DataFrame, labels: DataFrame, *, max_positives: int = 3000, max_unlabelled: int = 9000, n_features: int = 3000, least_evidence: float = 8.0, held_out_fold: int | None = 1, class_prior: float | None = None,
    doc_id: str = "doc_id", text: str = "text",
) -> Model:
    """Trains on at most max_positives confirmed toxic texts and max_unlabelled others, those with the least hashes of their ids. Labels of the held-out fold are never read.

    Features are those whose share in toxic texts differs from that in the others by a likelihood ratio (G statistic) of least_evidence, the n_features with the greatest.
    Features of fewer than three chosen texts are not considered. A chosen text gives all its words; of rows that share an id one is taken. class_prior: the share of toxic texts; left out, their share among labelled rows outside the held-out fold. A null label or id counts as none; of an id with several labels the greatest counts. Without a confirmed text the model is constant."""
    modest_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("lid"), F.col("toxic").cast("int").alias("toxic")).where("lid is not null and toxic is not null")
    if held_out_fold is not None:
        known = known.where(fold(F.col("lid")) != held_out_fold)
    known = known.groupBy("lid").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = class_prior if class_prior is not None else (n_toxic / n if n else 0.0)
    if not n_toxic:
        return Model({}, -4.0, prior)
    chance = F.xxhash64(F.lit("train"), F.col("id"))
    learn = docs.select(F.col(doc_id).cast("long").alias("id")).where("id is not null").distinct()
    if held_out_fold is not None:
        learn = learn.where(fold(F.col("id")) != held_out_fold)
    toxic = known.where("toxic = 1").select(F.col("lid").alias("id"))
    positives = toxic.orderBy(chance, "id").limit(max_positives).withColumn("positive", F.lit(True))
    # unlabelled: of all texts of these folds, whatever their label
    others = learn.orderBy(chance, "id").limit(max_unlabelled).withColumn("positive", F.lit(False))
    chosen = written(positives.unionByName(others), "toxic-sample")
    # At most max_positives + max_unlabelled ids, each once or, chosen as both, twice. Of rows that share an id the one with the least hash of its text is taken.
    ids = chosen.select("id").distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), text_of(text).alias("text")).join(F.broadcast(ids), "id")
    texts = texts.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    texts = written(texts.join(F.broadcast(chosen), "id"), "toxic-texts")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in by_size(batches):
            keys = [sorted(map(feature_key, counted(Counter(words_of(t))))) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "positive": batch["positive"], "keys": keys})

    sample = written(texts.mapInPandas(keyed, "id long, positive boolean, keys array<long>"), "toxic-keys")
    counts = sample.select("positive", F.explode("keys").alias("key")).groupBy("key").agg(F.sum(F.col("positive").cast("int")).alias("p"), F.sum((~F.col("positive")).cast("int")).alias("u"))
    n_p, n_u = sample.agg(F.sum(F.col("positive").cast("int")), F.sum((~F.col("positive")).cast("int"))).first()
    if not n_p:
        return Model({}, -4.0, prior)
    p, u, share = F.col("p"), F.col("u"), (F.col("p") + F.col("u")) / F.lit(float(n_p + (n_u or 0)))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    evidence = part(p, n_p * share) + part(n_p - p, n_p * (1 - share)) + part(u, (n_u or 0) * share) + part((n_u or 0) - u, (n_u or 0) * (1 - share))
    top = counts.where("p + u >= 3").withColumn("evidence", evidence).where(F.col("evidence") >= least_evidence).orderBy(F.desc("evidence"), "key").limit(n_features).select("key")
    top = written(top, "toxic-features")
    keys = np.sort(np.array([r[0] for r in top.collect()], dtype=np.int64))
    taken = {int(k) for k in keys}

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["keys"] = [np.flatnonzero(np.isin(keys, k)) for k in batch["keys"]]
            yield batch

    reduced = sample.mapInPandas(reduce, "id long, positive boolean, keys array<long>").collect()
    reduced.sort(key=lambda r: (r[0], not r[1]))
    rows = [np.array(r[2], dtype=np.int64) for r in reduced]
    weights, bias = nnpu_train(rows, np.array([r[1] for r in reduced], dtype=bool), len(keys), prior)

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for batch in batches:
            for t in batch["text"]:
                seen |= {f for f in counted(Counter(words_of(t))) if feature_key(f) in taken}
        yield pd.DataFrame({"feature": list(seen)})

    names = texts.select("text").mapInPandas(spelled, "feature binary").distinct().collect()
    by_key = dict(zip(keys.tolist(), weights.tolist(), strict=True))
    return Model({bytes(r[0]): by_key[feature_key(bytes(r[0]))] for r in names if abs(by_key[feature_key(bytes(r[0]))]) > 1e-4}, bias, prior)


def scored(docs: DataFrame, model: Model, *, threshold: float = 0.7, held_out_fold: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from the threshold on) of each row of docs, from its whole text alone. A null or empty text scores as one without a known
    feature; equal texts score alike; a null id is in no fold. Other columns are not read. The model has at most n_features words and goes to the executors with the function."""

    modest_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "no_id": batch["no_id"], "score": [model.score(t) for t in batch["text"]]})

    slim = docs.select(*carried_id(F.col(doc_id)), text_of(text).alias("text"))
    out = restored_id(slim.mapInPandas(run, "doc_id long, no_id boolean, score double"))
    held = F.coalesce(fold(F.col("doc_id")) == held_out_fold, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, *, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """docs less the rows that score at or above the threshold, each judged by its own text. Rows pass as they are, whatever their columns; a null text scores as an empty one."""
    modest_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
