"""Chooses op10's settings by cross-validation inside the learning folds; rows of the held-out fold, texts and labels, are not read.

    python tests/llm/select_toxicity.py /root/testdata/sf0.1

Rule, fixed before the first run: the setting with the greatest F1 at threshold 0.7 over the labelled rows of five parts (crc32 of "cv" and doc_id, modulo 5), each
predicted by a model trained on the other four; of equal ones the first in the grid's order, which goes from plainer to richer features."""

from __future__ import annotations

import itertools
import multiprocessing
import sys
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq

from kspec.llm.toxicity import counted, feature_key, nnpu_train, words_of

KINDS = ("words", "words and beginnings", "words and counted beginnings")
EVIDENCE, DECAY = (8.0, 16.0, 32.0), (3e-4, 1e-3, 3e-3)
PARTS, THRESHOLD, N_FEATURES = 5, 0.7, 3000
ids: list[int] = []
toxic: dict[int, int] = {}
kinds: dict[str, list[np.ndarray]] = {}


def featured(text: str) -> list[np.ndarray]:
    words = Counter(words_of(text or ""))
    every = counted(words)
    plain = [f for f in every if b"*" not in f]
    chosen = (plain, [f for f in every if not f.endswith((b"*2", b"*4"))], every)
    return [np.array(sorted(map(feature_key, c)), dtype=np.int64) for c in chosen]


def g_statistic(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    share = (p + u) / (n_p + n_u)
    cells = ((p, n_p * share), (n_p - p, n_p * (1 - share)), (u, n_u * share), (n_u - u, n_u * (1 - share)))
    return sum(np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1) / np.maximum(e, 1e-300)), 0.0) for seen, e in cells)


def outcome(job: tuple[str, float, float, int]) -> tuple[int, int, int]:
    """Toxic texts found, missed and clean ones called toxic in one part."""
    kind, evidence, decay, part = job
    inside = np.array([crc32(f"cv{i}".encode()) % PARTS == part for i in ids])
    rows = kinds[kind]
    positives = [k for k, i in enumerate(ids) if not inside[k] and toxic.get(i) == 1]
    others = np.flatnonzero(~inside).tolist()
    n_p, n_u = len(positives), len(others)
    keys = np.unique(np.concatenate([rows[k] for k in others]))
    counts = [np.bincount(np.searchsorted(keys, np.concatenate([rows[k] for k in which])), minlength=len(keys)) for which in (positives, others)]
    g = np.where(counts[0] + counts[1] >= 3, g_statistic(*counts, n_p, n_u), 0.0)
    best = np.lexsort((keys, -g))[:N_FEATURES]
    top = np.sort(keys[best[g[best] >= evidence]])
    position = lambda k: np.flatnonzero(np.isin(top, rows[k]))
    labelled = [i for k, i in enumerate(ids) if not inside[k] and i in toxic]
    prior = sum(toxic[i] for i in labelled) / max(1, len(labelled))
    w, bias = nnpu_train([position(k) for k in positives + others], np.arange(n_p + n_u) < n_p, len(top), prior, decay=decay)
    tp = fn = fp = 0
    for k in np.flatnonzero(inside):
        if (label := toxic.get(ids[k])) is not None:
            said = 1 / (1 + np.exp(-(w[position(k)].sum() + bias))) >= THRESHOLD
            tp, fn, fp = tp + (label == 1 and said), fn + (label == 1 and not said), fp + (label != 1 and said)
    return tp, fn, fp


def main(folder: str) -> None:
    kept = lambda i: i is not None and crc32(str(i).encode()) % 3 != 1
    texts = {}
    for batch in pq.ParquetFile(f"{folder}/documents.parquet").iter_batches(columns=["doc_id", "text"]):
        texts |= {r["doc_id"]: r["text"] for r in batch.to_pylist() if kept(r["doc_id"])}
    ids.extend(sorted(texts))
    for r in pq.read_table(f"{folder}/labels.parquet", columns=["doc_id", "toxic"]).to_pylist():
        if kept(r["doc_id"]) and r["toxic"] is not None:
            toxic[r["doc_id"]] = max(r["toxic"], toxic.get(r["doc_id"], 0))
    with multiprocessing.get_context("fork").Pool(8) as pool:
        kinds.update(zip(KINDS, zip(*pool.map(featured, [texts[i] for i in ids], chunksize=64), strict=True), strict=True))
    print(len(ids), "texts,", sum(i in toxic for i in ids), "labelled,", sum(toxic.get(i) == 1 for i in ids), "toxic")
    grid = list(itertools.product(KINDS, EVIDENCE, DECAY))
    jobs = [(*setting, part) for setting in grid for part in range(PARTS)]
    with multiprocessing.get_context("fork").Pool(8) as pool:
        done = pool.map(outcome, jobs, chunksize=1)
    scores = []
    for n, setting in enumerate(grid):
        tp, fn, fp = np.sum(done[n * PARTS : (n + 1) * PARTS], axis=0)
        scores.append(2 * tp / max(1, 2 * tp + fn + fp))
        print(*setting, "| found", tp, "missed", fn, "false alarms", fp, "F1", round(scores[-1], 4))
    print("chosen:", *grid[int(np.argmax(scores))])


if __name__ == "__main__":
    main(sys.argv[1])
