"""Near-duplicate vectors by an inverted file with product-quantised residuals.

Two coarse codebooks assign each unit vector to a list: the first splits the space, the second splits what
the first leaves over, so the number of lists is the product of two small ones and grows with the table.
What both leave over is coded by one of 256 codewords per subspace. A vector is looked up in its own list
and in every list whose border lies within SLACK of it. Two vectors meet if either looks into the other's
list, so a pair is missed only if it is apart by more than 2 * SLACK across the border; a pair at cosine
0.9 is 0.447 apart in all, of which a random displacement in 64 dimensions puts 0.056 on any one direction.
Tests measure the recall. Within a list, a table of squared distances from the query's residual to all
codewords gives asymmetric distances by lookups; entries whose distance, less their own coding error, can
still reach the threshold are compared by exact cosine in double precision.

Equal vectors form one class first. Entries and visitors of a list are dealt into blocks of bounded size
that meet pair by pair, so a list that holds a third of all rows is spread over many tasks. A task gives
per-vector link counts and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, ship, small, written
from .components import components

#: Vectors that the codebooks are fitted on at most: those with the smallest hashes of their id. All are indexed.
MOST_TRAINING = 20_000
#: Vectors a list holds on average.
LIST_SIZE = 512
SUBSPACES = 8
CODEWORDS = 256
#: How far beyond a list's border a vector looks.
SLACK = 0.1
#: Cells of the first coarse codebook at most; beyond, the second one has more than one.
FIRST = 1_024
#: Entries and visitors of a list that one task compares at once.
BLOCK, VISITORS = 2_048, 8_192


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm from random distinct starting points; an empty cell takes the farthest point."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near, far = nearest(x, c)
        order = np.argsort(near, kind="stable")
        n = np.bincount(near, minlength=k)
        some = np.flatnonzero(n)
        c[some] = np.add.reduceat(x[order], np.r_[0, np.cumsum(n[some])[:-1]]) / n[some][:, None]
        for i, j in zip(np.flatnonzero(n == 0), np.argsort(-far), strict=False):
            c[i] = x[j]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, far = np.empty(len(x), np.int64), np.empty(len(x))
    cc = (c * c).sum(1)
    for s in range(0, len(x), 4096):
        d = cc - 2 * x[s : s + 4096] @ c.T
        near[s : s + 4096] = d.argmin(1)
        far[s : s + 4096] = d.min(1) + (x[s : s + 4096] ** 2).sum(1)
    return near, far


def borders(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and how far each row is from the border between that cell and every other one."""
    cc = (c * c).sum(1)
    d = cc - 2 * x @ c.T
    own = d.argmin(1)
    apart = np.sqrt(np.maximum(cc[:, None] + cc - 2 * c @ c.T, 0))
    out = (d - d[np.arange(len(x)), own][:, None]) / (2 * np.maximum(apart[own], 1e-12))
    out[np.arange(len(x)), own] = 0
    return own, out


class Index:
    """Two levels of coarse centroids and residual codewords for unit vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.dim = sample.shape[1]
        first = min(lists, FIRST, max(1, len(sample) // 8))
        self.first = kmeans(sample, first)
        rest = sample - self.first[nearest(sample, self.first)[0]]
        self.second = kmeans(rest, max(1, -(-lists // first)), seed=99)
        rest = rest - self.second[nearest(rest, self.second)[0]]
        self.cuts = np.linspace(0, self.dim, min(SUBSPACES, self.dim) + 1).astype(int)
        self.words = [kmeans(rest[:, a:b], CODEWORDS, seed=i + 1) for i, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True))]

    def centre(self, where: np.ndarray | int) -> np.ndarray:
        """What the coarse codebooks make of vectors of a list."""
        return self.first[where // len(self.second)] + self.second[where % len(self.second)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Own list, codes, the distance between each vector and what its code stands for, and (row, list) of all probes.

        A list is probed if the way to its two borders, taken as the legs of a right angle, is at most SLACK.
        """
        own, rows, lists = np.empty(len(x), np.int64), [], []
        for s in range(0, len(x), 512):
            part = x[s : s + 512]
            _, m1 = borders(part, self.first)
            row, cell = np.nonzero(m1 <= SLACK)
            near, m2 = borders(part[row] - self.first[cell], self.second)
            at, sub = np.nonzero(m1[row, cell][:, None] ** 2 + m2**2 <= SLACK**2)
            rows.append(row[at] + s)
            lists.append(cell[at] * len(self.second) + sub)
            home = m1[row, cell] == 0
            own[row[home] + s] = cell[home] * len(self.second) + near[home]
        r = x - self.centre(own)
        codes, error = np.empty((len(x), len(self.words)), np.uint8), np.zeros(len(x))
        for i, w in enumerate(self.words):
            part = r[:, self.cuts[i] : self.cuts[i + 1]]
            codes[:, i], _ = nearest(part, w)
            error += ((part - w[codes[:, i]]) ** 2).sum(1)
        return own, codes, np.sqrt(error), (np.concatenate(rows), np.concatenate(lists)) if rows else (own, own)

    def distances(self, q: np.ndarray, where: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of queries to the coded vectors of one list, by table lookup."""
        r = q - self.centre(where)
        out = np.zeros((len(codes), len(q)), np.float32)
        for i, w in enumerate(self.words):
            part = r[:, self.cuts[i] : self.cuts[i + 1]]
            tab = ((w**2).sum(1)[:, None] + (part**2).sum(1) - 2 * w @ part.T).astype(np.float32)
            out += tab[codes[:, i]]  # whole rows, a codeword's distances to all queries
        return out.T


def unit(raw: list[bytes], kind: str, dim: int) -> np.ndarray:
    """Unit vectors in double precision, scaled first so that neither very large nor very small parts overflow or vanish."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), dim).astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links (a, b) among 0 to n - 1 that join what was apart."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u, v = root(x), root(y)
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((x, y))
    return out


def read_vectors(vectors: DataFrame, kind: str) -> DataFrame:
    """(vec_id, sig, dim, vec): each vector's bytes, and the digest of those that can link; sig is null for the others."""

    def apply(batches):
        for batch in batches:
            column, sigs, raws = batch.column(1), [], []
            sizes = np.diff(column.offsets.to_numpy())
            inner = column.flatten()  # of null rows nothing
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.where(valid, sizes, 0)
            numbers = inner.fill_null(float("nan")).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for size, end, some in zip(sizes.tolist(), ends.tolist(), valid.tolist(), strict=True):
                part = numbers[end - size : end]
                fit = some and size and np.isfinite(part).all() and part.any()
                raws.append(part.tobytes() if fit else None)
                sigs.append(hashlib.blake2b(raws[-1], digest_size=16).digest() if fit else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(raws, pa.binary())], names=["vec_id", "sig", "dim", "vec"])

    wide = "float" if kind == "<f4" else "double"
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{wide}>")).mapInArrow(apply, "vec_id long, sig binary, dim int, vec binary")


def fit_indexes(classes: DataFrame, kind: str) -> dict[int, Index]:
    """An index for each length of the vectors, fitted on a bounded sample (by hash of the id)."""
    counts = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    n = sum(counts.values())
    if not n:
        return {}
    share = classes.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < max(1, int(1_500_000 * MOST_TRAINING / n)))
    rows = share.select("id", "dim", "vec", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(MOST_TRAINING).select("dim", "vec").toArrow()
    dims, out = rows["dim"].to_numpy(), {}
    for dim, count in sorted(counts.items()):
        # a length that is not in the sample has one list without a centre, which its blocks compare in full
        x = unit(rows.filter(pa.array(dims == dim))["vec"].to_pylist(), kind, dim) if (dims == dim).any() else np.zeros((1, dim))
        out[dim] = Index(x, max(1, min(count // LIST_SIZE, len(x) // 8 * FIRST)))
    return out


ENTERED = "id long, weight long, dim int, vec binary, own long, code binary, error float, probes array<long>"


def link_counts(classes: DataFrame, indexes: dict[int, Index], threshold: float, kind: str) -> DataFrame:
    """(id, n, other) from (id, weight, dim, vec): partial link counts, or (other not null) links of a spanning forest."""
    shared = classes.sparkSession.sparkContext.broadcast(indexes)

    def enter(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                own, codes, error, (row, where) = shared.value[dim].encode(unit(part.column(3).to_pylist(), kind, dim))
                order = np.lexsort((where, row))
                ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(own)))].astype(np.int32)
                probes = pa.ListArray.from_arrays(pa.array(ends), pa.array(where[order]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.astype(np.float32)), probes], names=[c.split()[0] for c in ENTERED.split(", ")])

    entered = written(classes.select("id", "weight", "dim", "vec").mapInArrow(enter, ENTERED), "pq")
    # blocks of the lists that need more than one of either kind; all other lists are one block
    full = entered.select("dim", F.explode("probes").alias("list"), (F.col("list") == F.col("own")).cast("int").alias("home"))
    full = full.groupBy("dim", "list").agg(F.ceil(F.sum("home") / BLOCK).cast("int").alias("nb"), F.ceil(F.count("*") / VISITORS).cast("int").alias("nq")).filter("nb > 1 or nq > 1")
    full = small(written(full, "pq-blocks"))
    one = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    base = ["list", "id", "weight", "vec", "own"]
    home = entered.withColumn("list", F.col("own")).join(full, ["dim", "list"], "left")
    home = home.withColumn("eb", F.pmod(F.xxhash64("id"), one("nb")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), one("nq") - 1)))
    home = home.select("dim", "eb", "qb", F.lit(True).alias("home"), *base, "code", "error", "probes")
    visits = entered.withColumn("list", F.explode("probes")).join(full, ["dim", "list"], "left")
    visits = visits.withColumn("qb", F.pmod(F.xxhash64("id", F.lit(1)), one("nq")).cast("int")).withColumn("eb", F.explode(F.sequence(F.lit(0), one("nb") - 1)))
    visits = visits.select("dim", "eb", "qb", F.lit(False).alias("home"), *base, F.lit(None).cast("binary").alias("code"), F.lit(None).cast("float").alias("error"), F.lit(None).cast("array<long>").alias("probes"))
    far = 2 - 2 * threshold + 1e-5
    nothing = pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})

    def compare(key, table):
        dim, where = key[0].as_py(), key[1].as_py()
        ix = shared.value[dim]
        at_home = table["home"].to_numpy()
        e, q = table.filter(pa.array(at_home)), table.filter(pa.array(~at_home))
        if not len(e) or not len(q):
            return nothing
        xe = unit(e["vec"].to_pylist(), kind, dim)
        codes = np.frombuffer(b"".join(e["code"].to_pylist()), np.uint8).reshape(len(e), len(ix.words))
        ids_e, w_e, reach = e["id"].to_numpy(), e["weight"].to_numpy(), (np.sqrt(far) + e["error"].to_numpy().astype(float) + 1e-4) ** 2
        probes = e["probes"].combine_chunks()
        into = np.repeat(np.arange(len(e)), np.diff(probes.offsets.to_numpy())), probes.flatten().to_numpy()
        count_e = np.zeros(len(e), np.int64)
        total: list[tuple[np.ndarray, np.ndarray]] = []
        la, lb = [], []
        for s in range(0, len(q), 1024):
            part = q.slice(s, 1024)
            xq = unit(part["vec"].to_pylist(), kind, dim)
            i, j = np.nonzero(ix.distances(xq, where, codes) <= reach)
            ids_q, own_q, w_q = part["id"].to_numpy(), part["own"].to_numpy(), part["weight"].to_numpy()
            differ = ids_q[i] != ids_e[j]
            i, j = i[differ], j[differ]
            linked = np.zeros(len(i), bool)
            for t in range(0, len(i), 200_000):
                linked[t : t + 200_000] = np.einsum("ij,ij->i", xq[i[t : t + 200_000]], xe[j[t : t + 200_000]]) >= threshold
            i, j = i[linked], j[linked]
            same = own_q[i] == where
            # a pair of different lists may meet in both; it counts in the smaller, if it meets there
            both = np.zeros(len(i), bool)
            cross = np.flatnonzero(~same & (own_q[i] < where))
            if len(cross):
                lists, place = np.unique(np.concatenate((into[1], own_q[i[cross]])), return_inverse=True)
                both[cross] = np.isin(j[cross] * len(lists) + place[len(into[1]) :], into[0] * len(lists) + place[: len(into[1])])
            i, j, same = i[~both], j[~both], same[~both]
            total.append((ids_q, np.bincount(i, weights=w_e[j], minlength=len(part)).astype(np.int64)))
            count_e += np.bincount(j[~same], weights=w_q[i[~same]], minlength=len(e)).astype(np.int64)
            la.append(ids_q[i])
            lb.append(ids_e[j])
        ids = np.concatenate([x for x, _ in total] + [ids_e])
        n = np.concatenate([x for _, x in total] + [count_e])
        a, b = np.concatenate(la), np.concatenate(lb)
        nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
        tree = np.array(forest(len(nodes), flat[: len(a)], flat[len(a) :]), np.int64).reshape(-1, 2)
        some = n > 0
        return pa.table({
            "id": pa.array(np.concatenate((ids[some], nodes[tree[:, 0]])), pa.int64()),
            "n": pa.array(np.concatenate((n[some], np.zeros(len(tree), np.int64))), pa.int64()),
            "other": pa.array([None] * int(some.sum()) + nodes[tree[:, 1]].tolist(), pa.int64()),
        })

    found = written(home.unionByName(visits).groupBy("dim", "list", "eb", "qb").applyInArrow(compare, "id long, n long, other long"), "links")
    forget(entered, full)
    return found


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors of one length link at a cosine of at least ``threshold`` in double precision. Vectors that are
    null, empty or zero, or that hold null or non-finite parts, link with nothing and are their own
    component. Rows with a null vec_id are kept, with no component. Rows of equal vectors link with one
    another, also when their vec_id repeats. Vectors of any length are taken, each length by an index of its
    own. Other columns are ignored; an empty table gives an empty one.
    """
    ship(vectors.sparkSession)
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    v = written(read_vectors(vectors, kind), "read")
    usable = F.col("sig").isNotNull() & F.col("vec_id").isNotNull()
    classes = written(v.filter(usable).groupBy("sig").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("dim").alias("dim"), F.first("vec").alias("vec")), "vectors")
    # a vec_id may stand for several classes, so classes have numbers of their own: the smallest vec_id names a component
    classes = classes.withColumn("vec_id", F.col("id")).withColumn("id", F.xxhash64("sig"))
    alone = v.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    indexes = fit_indexes(classes, kind)
    if not indexes:
        return alone
    found = link_counts(classes, indexes, threshold, kind)
    counts = found.filter("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    labels = components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = classes.select("sig", "id", "vec_id", "weight").join(counts, "id", "left").join(labels, "id", "left").withColumn("c", F.coalesce("component", "id"))
    least = named.filter("component is not null").groupBy("c").agg(F.min("vec_id").alias("least"))
    named = named.join(least, "c", "left").select("sig", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("least", "vec_id").alias("component_id"))
    out = v.filter(usable).select("vec_id", "sig").join(named, "sig")
    out = out.select("vec_id", F.col("n").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(alone)


def query(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors)


#: Exact cosines of all pairs and what can be reached by links, for tables that a quadratic join can take.
SQL = """
WITH RECURSIVE f AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM f
  WHERE v IS NOT NULL AND len(v) > 0 AND list_dot_product(v, v) > 0 AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x)))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) >= 0.9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""
