"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, rerank with the original vectors."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import deal, gather, whole_runs
from .common import Scratch, _forest, connected_components, frugal

#: Vectors that the rotations are fitted on; members of a block; chance to miss a pair at the very threshold.
SAMPLE, BLOCK, MISS = 8192, 512, 0.02


@dataclass
class Model:
    """Codes of tables x bits bits: sign(((x / |x|) - mean) @ rotation)."""

    mean: np.ndarray
    rotation: np.ndarray
    bits: int
    tables: int
    radius: int

    def signs(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return (x - self.mean) @ self.rotation > 0

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """A column for each table: the number that its stretch of the code makes."""
        return signs.reshape(len(signs), self.tables, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))


def _rotation(x: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """Gong and Lazebnik 2011: principal directions, then a rotation that brings the data near its own signs."""
    _, vectors = np.linalg.eigh(x.T @ x)
    v = x @ vectors
    r = np.linalg.qr(rng.standard_normal((x.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, wt = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ wt).T
    return vectors @ r


def fit(sample: np.ndarray, rows: int, threshold: float, seed: int = 0) -> Model:
    """Rotations from a bounded sample; key length from the number of rows; tables from the measured bit error.

    Keys get longer with the table so that buckets of unrelated vectors stay small. The share of bits that
    differ at the threshold is measured on sample vectors turned by exactly that angle, and so many tables
    are kept that such a pair meets in one of them with probability 1 - MISS.
    """
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = x.mean(axis=0)
    bits = int(min(24, max(8, math.ceil(math.log2(max(rows, 2))) - 4)))
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    turned = threshold * x + math.sqrt(1 - threshold**2) * side
    rotations, tables, error = [], 1, 0.0
    while d * len(rotations) < tables * bits:
        rotations.append(_rotation(x - mean, rng))
        w = np.concatenate(rotations, axis=1)
        error = float((((x - mean) @ w > 0) != ((turned - mean) @ w > 0)).mean())
        tables = max(4, math.ceil(math.log(MISS) / math.log(max(1e-9, 1 - (1 - error) ** bits))))
    w, total = np.concatenate(rotations, axis=1)[:, : tables * bits], tables * bits
    return Model(mean, w, bits, tables, math.ceil(total * error + 5 * math.sqrt(total * error * (1 - error)) + 1))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros to d components."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), d))
    out[np.repeat(np.arange(len(column)), lengths), np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else []] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _encode(model: Model, d: int):
    """An entry for each vector and table: (space, t, key, id, codes), codes being all tables' bits in words of 64."""

    def run(batches):
        for batch in batches:
            signs = model.signs(_matrix(batch.column("embedding"), d))
            keys = model.keys(signs)
            n, t = keys.shape
            every = pa.array(np.repeat(np.arange(n), t))
            packed = np.packbits(np.pad(signs, ((0, 0), (0, -signs.shape[1] % 64))), axis=1)
            codes = pa.array([row.tobytes() for row in packed], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("space").take(every), pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array(keys.ravel()), batch.column("id").take(every), codes.take(every)],
                ["space", "t", "key", "id", "codes"],
            )

    return run


def _words(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["codes"]), np.uint64).reshape(len(frame), -1)


def _pairs(frame: pd.DataFrame, bounds: np.ndarray, radius: int):
    """Pairs of rows (i, j) of all units of a frame at once that lie within the Hamming radius, a distance in the frame at a time."""
    words, own, across = _words(frame), frame["_own"].to_numpy(), (frame["_lo"] != frame["_hi"]).to_numpy()
    end, i, d = np.repeat(bounds[1:], np.diff(bounds)), np.arange(len(frame)), 0
    while True:
        d += 1
        i = i[i + d < end[i]]
        if not len(i):
            return
        j = i + d
        some = ~across[i] | (own[i] != own[j])
        a, b = i[some], j[some]
        near = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64) <= radius
        if near.any():
            yield a[near], b[near]


_UNIT = ["space", "t", "key", "_lo", "_hi"]


def _retrieve(radius: int):
    """Members of a bucket that have another one within the Hamming radius, over all tables' bits."""

    def run(batches):
        for frame, bounds in whole_runs(batches, _UNIT):
            hit = np.zeros(len(frame), bool)
            for i, j in _pairs(frame, bounds, radius):
                hit[i] = hit[j] = True
            if hit.any():
                yield frame.loc[hit, ["space", "t", "key", "id", "codes"]]

    return run


def _rerank(model: Model, threshold: float):
    """Links of each member met first in this table, by cosine in double precision, and a forest of them."""

    def run(batches):
        for frame, bounds in whole_runs(batches, _UNIT):
            x = np.array(frame["embedding"].tolist(), np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            bits = np.unpackbits(_words(frame).view(np.uint8), axis=1)[:, : model.tables * model.bits]
            keys, t = model.keys(bits), frame["t"].to_numpy()
            ids, copies, links = frame["id"].to_numpy(), frame["copies"].to_numpy(), np.zeros(len(frame), np.int64)
            edges = []
            for a, b in _pairs(frame, bounds, model.radius):
                for at in range(0, len(a), 4096):
                    i, j = a[at : at + 4096], b[at : at + 4096]
                    near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                    near &= ~((keys[i] == keys[j]) & (np.arange(model.tables) < t[i][:, None])).any(axis=1)  # met in an earlier table
                    i, j = i[near], j[near]
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    edges.append(pd.DataFrame({"a": ids[i], "b": ids[j]}))
            if links.any():
                yield next(iter(_forest(iter([pd.concat(edges)])))).assign(n=0)
                yield pd.DataFrame({"a": ids[links > 0], "b": ids[links > 0], "n": links[links > 0]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 0) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per vector.

    Vectors of one label and one length link at a cosine of `threshold` or more. Equal vectors are one
    class, found by exact grouping. Classes are coded by iterative quantisation and filed in a Hamming
    table for each stretch of the code; those with a neighbour within the radius meet again with their
    vectors. Buckets are worked through in pairs of blocks, and a pair counts in the first table it meets
    in, so links are summed up without a list of pairs.

    Null or zero vectors, vectors with null or non-finite components and null labels link with nothing.
    Rows that share an id are separate vectors with one id. A null id is returned with component null and
    kept true. Only the three named columns are read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "itq")
    ok = F.col("vector").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    ok &= ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    rows = rows.withColumn("vector", F.transform("vector", lambda v: v.cast("double"))).withColumn("ok", F.coalesce(ok, F.lit(False)))
    space = F.concat_ws(":", F.size("vector").cast("string"), F.col("label").cast("string"))
    good = rows.where("ok").select("vec_id", space.alias("space"), F.col("vector").alias("embedding"), F.xxhash64("label", "vector").alias("h1"), F.xxhash64(F.lit(1), "vector", "label").alias("h2"))
    classes = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    rep = good.join(classes, ["h1", "h2", "vec_id"]).dropDuplicates(["h1", "h2"])
    # h1 names a class from here on, vec_id is its least id
    rep = scratch.save(rep.select(F.col("h1").alias("id"), "h2", "vec_id", "copies", "space", "embedding"))
    n, d = rep.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if n:
        sample = [r.embedding for r in rep.select("embedding").orderBy(F.xxhash64("id", F.lit(seed))).limit(SAMPLE).collect()]
        model = fit(np.array([v + [0.0] * (d - len(v)) for v in sample]), n, threshold, seed)
        entries = rep.select("space", "id", "embedding").mapInArrow(frugal(_encode(model, d)), "space string, t int, key long, id long, codes binary")
        bucket = ["space", "t", "key"]
        entries = scratch.save(gather(deal(entries, bucket, "id", BLOCK), bucket).mapInPandas(frugal(_retrieve(model.radius)), "space string, t int, key long, id long, codes binary").distinct())
        facts = deal(entries, bucket, "id", BLOCK).join(rep.select("id", "copies", "embedding"), "id")
        found = scratch.save(gather(facts, bucket).mapInPandas(frugal(_rerank(model, threshold)), "a long, b long, n long"))
        label = connected_components(found.where("n = 0").select("a", "b"), scratch).join(rep.select("id", "vec_id"), "id")
        least = label.groupBy("component").agg(F.min("vec_id").alias("component_id"))
        label = label.join(least, "component").select("id", "component_id")
        links = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
        result = rep.select("id", "h2", "vec_id", "copies").join(links, "id", "left").join(label, "id", "left")
        result = result.select(F.col("id").alias("h1"), "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    else:
        result = rep.select(F.col("id").alias("h1"), "h2", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.select("vec_id", "h1", "h2").join(result, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def near_duplicates_oracle(threshold: float = 0.93) -> str:
    """All pairs of equal label by cosine in DuckDB, and recursive reachability: what an exact search gives."""
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    ok AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {threshold}::DOUBLE),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
    r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""
