"""Near-duplicates of embeddings: random-hyperplane signs in several tables, exact cosines, components.

Equal vectors of one label form a class and enter once.  A class has a code of ``bits`` hyperplane signs in each
of ``tables`` tables; classes that share (label, table, code) are compared by exact cosine in double
precision.  With 14 bits and 28 tables a pair at cosine 0.93 meets in some table with probability
0.994, nearer pairs almost surely.  Buckets of one class are dropped before any vector is moved; a
bucket of more than ``block`` classes is compared in pairs of blocks, each a group of its own.  A pair
counts only in the first table in which it meets.  Groups return a row per linked class (the number
of vectors linked, the root of its component within the group), never pairs.

Results: null labels, null ids and unusable vectors (null, zero, null or non-finite components) get no links and are
their own component; vectors of different length never link; repeated rows are vectors of their own; ids are
taken to be unique (vectors that share an id share its component); an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.llm.common import Scratch, table
from foldframe.llm.components import connected_components
from foldframe.llm.vectors import norms, valid_rows


def hyperplane_codes(x: np.ndarray, bits: int, tables: int, seed: int = 11) -> np.ndarray:
    """Sign codes, one column per table."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    signs = (x.astype(np.float64) / norms(x)[:, None]) @ planes > 0
    return (signs.reshape(len(x), tables, bits) @ (1 << np.arange(bits))).astype(np.int32)


def _coded(df: DataFrame, bits: int, tables: int) -> DataFrame:
    """id, label, and for usable rows: key of the class, dim, vec (float64 bytes), codes (int32 bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            key, dims, vec, codes = ([None] * n for _ in range(4))
            for rows, x in valid_rows(batch.column(2)):
                own = hyperplane_codes(x, bits, tables)
                for i, v, c in zip(rows.tolist(), x, own):
                    vec[i], codes[i], dims[i] = v.tobytes(), c.tobytes(), x.shape[1]
                    key[i] = hashlib.sha256(vec[i]).digest()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(key, pa.binary()), pa.array(dims, pa.int32()),
                 pa.array(vec, pa.binary()), pa.array(codes, pa.binary())], names=["id", "label", "key", "dim", "vec", "codes"])

    label = df.schema["label"].dataType.simpleString()
    return df.mapInArrow(run, f"id long, label {label}, key binary, dim int, vec binary, codes binary")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component among 0..n-1."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(ids, counts, own_block, x, codes, table_no, blocks, threshold):
    """(ids, numbers of vectors linked, roots) of the linked classes of one group."""
    order = np.argsort(ids, kind="stable")
    ids, counts, own_block, x, codes = ids[order], counts[order], own_block[order], x[order], codes[order]
    size = norms(x)
    y = x.astype(np.float64)
    unit = y / size[:, None]
    a, b = np.nonzero(np.triu(unit @ unit.T >= threshold - 1e-6, 1))
    if len(a) and blocks[0] != blocks[1]:
        across = own_block[a] != own_block[b]
        a, b = a[across], b[across]
    met = (codes[a] == codes[b]).argmax(axis=1) == table_no
    a, b = a[met], b[met]
    near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
    a, b = a[near], b[near]
    if not len(a):
        return None
    linked = np.bincount(a, counts[b], len(ids)) + np.bincount(b, counts[a], len(ids))
    own = np.flatnonzero(linked)
    return ids[own], linked[own].astype(np.int64), ids[_roots(len(ids), a, b)[own]]


def _links(groups: DataFrame, tables: int, threshold: float, dtype: str) -> DataFrame:
    def finish(part, batches_rows):
        rep, n, block, vec, codes = (np.concatenate([r[k] for r in batches_rows]) for k in ("rep", "n", "block", "vec", "codes"))
        x = np.frombuffer(b"".join(vec.tolist()), dtype).reshape(len(vec), -1)
        c = np.frombuffer(b"".join(codes.tolist()), np.int32).reshape(len(vec), tables)
        return _compare(rep.astype(np.int64), n.astype(np.float64), block, x, c, part[0], part[1:], threshold)

    def run(batches):
        last, rows = None, []

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["rep", "links", "root"])

        for batch in batches:
            pdf = batch.to_pandas()
            name = pdf["group"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, name[1:] != name[:-1], True]) if len(name) else np.array([0])
            found = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if name[lo] != last:
                    if rows and sum(len(r["rep"]) for r in rows) > 1:
                        found.append(finish(rows[0]["part"], rows))
                    last, rows = name[lo], []
                own = {k: pdf[k].to_numpy()[lo:hi] for k in ("rep", "n", "block", "vec", "codes")}
                own["part"] = tuple(int(pdf[k].iat[lo]) for k in ("tab", "i", "j"))
                rows.append(own)
            for f in found:
                if f is not None:
                    yield out(f)
        if rows and sum(len(r["rep"]) for r in rows) > 1:
            f = finish(rows[0]["part"], rows)
            if f is not None:
                yield out(f)

    return groups.mapInArrow(run, "rep long, links long, root long")


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                           threshold: float = 0.93, bits: int = 14, tables: int = 28, block: int = 1024) -> DataFrame:
    """One row per input row: ``id_col``, n_links, component_id, kept."""
    spark = df.sparkSession
    scratch = Scratch(spark, "embeddings")
    dtype = "<f4" if "float" in df.schema[vec_col].dataType.simpleString() else "<f8"
    vec = F.col(vec_col) if dtype == "<f4" else F.col(vec_col).cast("array<double>")
    rows = scratch.write(_coded(df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vec.alias("v")),
                                bits, tables), "rows")
    usable = rows.where("key is not null and label is not null and id is not null")
    # equal vectors have equal bytes, dimension and codes: one class, with partial sums before the shuffle
    reps = scratch.write(usable.groupBy("label", "key").agg(
        F.min("id").alias("rep"), F.count("*").alias("n"), F.any_value("dim").alias("dim"), F.any_value("vec").alias("vec"),
        F.any_value("codes").alias("codes")), "reps")
    code = lambda t: F.expr(f"substring(codes, {4 * t + 1}, 4)")
    entries = reps.select("label", "key", "dim", F.posexplode(F.array(*[code(t) for t in range(tables)])).alias("tab", "code"))
    busy = entries.groupBy("label", "dim", "tab", "code").agg(F.count("*").alias("m")).where("m > 1")
    nb = F.ceil(F.col("m") / block).cast("int")
    mine = F.pmod(F.xxhash64("key"), F.col("nb")).cast("int")
    entries = entries.join(busy, ["label", "dim", "tab", "code"]).withColumn("nb", nb).withColumn("block", mine)
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    entries = entries.select("label", "key", "tab", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                             F.sha2(F.concat_ws("|", "label", "dim", "tab", F.hex("code"), F.least("block", "other"),
                                                F.greatest("block", "other")), 224).alias("group"))
    groups = (entries.join(reps.select("label", "key", "rep", "n", "vec", "codes"), ["label", "key"])
              .select("group", "tab", "i", "j", "block", "rep", "n", "vec", "codes")
              .repartition("group").sortWithinPartitions("group"))
    links = scratch.write(_links(groups, tables, threshold, dtype), "links")
    comp = connected_components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")), scratch)
    linked = links.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = (reps.select("label", "key", "rep", "n").join(linked, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
               .select(F.col("label").alias("l"), F.col("key").alias("k"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                       F.coalesce("component", "rep").alias("component_id")))
    out = rows.select("id", "label", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(
        classes, (F.col("label") == F.col("l")) & (F.col("key") == F.col("k")), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
