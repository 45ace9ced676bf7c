"""python tests/llm/recall.py FOLDER [CAPACITY]: how many of the ten best items by BM25 over all items the packing index finds.

Queries are the texts whose id is divisible by 100, against all items (``all``), and as seeds against the items that aren't seeds and fit
the room they leave (``packing``). The truth is brute force over every item with exact document frequencies.
"""

from __future__ import annotations

import math
import sys
from collections import Counter

sys.path[:0] = ["/root/repo"]

import numpy as np
from pyspark.sql import functions as F

from lakeloom.llm.packing import B, K1, SAMPLE, Bm25, Space, Start, _lists, bounds_of, items_of, nearest
from lakeloom.session import materialize


def exact(table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings of a table of items, by item: offsets, numbered terms, weights; and the document frequencies."""
    (offsets, terms), (_, tfs) = _lists(table, "terms"), _lists(table, "tfs")
    _, term, df = np.unique(terms, return_inverse=True, return_counts=True)
    n, item = len(offsets) - 1, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    length = np.bincount(item, tfs, n)
    weight = np.log1p((n - df + 0.5) / (df + 0.5))[term] * tfs * (K1 + 1) / (tfs + K1 * (1 - B + B * length[item] / length.mean()))
    return offsets, term, weight, df


def measured(spark, documents, capacity: int, k: int = 10, every: int = 100, **settings) -> dict[str, float]:
    n = documents.count()
    some = documents if n <= SAMPLE else documents.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < SAMPLE)
    space = Space.fit(items_of(some, {1: capacity}).filter("terms is not null").select("terms", "tfs").toArrow(), max(1, math.isqrt(n) // 2))
    loose = materialize(items_of(documents, {1: capacity}, space).filter("terms is not null"), "items")
    counts, length = {r.n_tokens: r.n for r in loose.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}, loose.agg(F.sum("length")).first()[0]
    sent = [spark.sparkContext.broadcast(vars(x)) for x in (space, Bm25.of(loose, sum(counts.values()), length))]
    start = Start.of(counts, capacity)
    table = loose.withColumn("seed", start.is_seed()).orderBy("doc_id").toArrow()
    ids, sizes, seed = (table[c].to_numpy() for c in ("doc_id", "n_tokens", "seed"))
    offsets, term, weight, df = exact(table)
    item = np.repeat(np.arange(len(ids)), np.diff(offsets))
    order = np.argsort(term, kind="stable")
    posted, worth, first = item[order], weight[order], np.concatenate([[0], np.cumsum(df)])
    queries = loose.filter((F.col("doc_id") % every == 0) & (F.col("length") > 0)).withColumn("room", F.lit(capacity).cast("long"))
    out = {}
    for what, q, items, edges in (
        ("all", queries, loose, bounds_of(Counter(counts))),
        ("packing", queries.filter(start.is_seed()).withColumn("room", F.lit(capacity) - F.col("n_tokens")), loose.filter(~start.is_seed()), start.edges),
    ):
        got = {}
        for r in nearest(items, q, {1: edges}, *sent, k, **settings).collect():
            got.setdefault(r.seed, set()).add(r.doc_id)
        found = wanted = 0
        for r in q.select("doc_id", "room").collect():
            i = int(np.searchsorted(ids, r.doc_id))
            score = np.zeros(len(ids))
            for t in term[offsets[i] : offsets[i + 1]]:
                at = slice(first[t], first[t + 1])
                score[posted[at]] += worth[at]
            score[(sizes > r.room) | (seed if what == "packing" else False)] = 0
            score[i] = 0
            least = max(np.sort(score)[-k:][0], 1e-9)
            mine = [score[np.searchsorted(ids, j)] for j in got.get(r.doc_id, ())]
            wanted += min(k, int((score > 0).sum()))
            found += sum(s >= least - 1e-4 for s in mine)  # of equal ones any
        out[what] = round(float(found) / max(1, wanted), 4)
    return out


if __name__ == "__main__":
    from lakeloom.session import local_session

    spark = local_session("recall")
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{sys.argv[1]}/documents.parquet")
    for capacity in [int(c) for c in sys.argv[2:]] or [2048, 8192]:
        print(sys.argv[1], capacity, measured(spark, docs, capacity), flush=True)
