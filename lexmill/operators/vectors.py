"""Vectors, similarity and clustering.

Rows of any number are compared with a stated set of queries, or with a bounded set of centres, block by
block in numpy: a block goes to the tasks, each task keeps only its top k per query, and these are ranked
after one shuffle. Tag tables (one vector per label) are bounded: ``bounded`` refuses more than
``MOST_TAGS`` rows, and their similarities are taken block by block in the tasks. The order-dependent groupings run in
the driver, on at most ``MOST_GROUPED`` tags.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.ordering import top_per_group
from lexmill.sources.tables import cut

MOST_TAGS = 20_000
MOST_GROUPED = 2_000
BLOCK, BLOCK_BYTES, CENTRES = 1024, 64 << 20, 256


def unit(rows) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    m = np.asarray(rows, dtype="float64")
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def _blocks(queries: DataFrame, id_col: str, vec_col: str, block_bytes: int):
    ids, vecs = [], []
    for r in queries.select(id_col, vec_col).where(f"{vec_col} is not null").toLocalIterator():
        ids.append(r[0])
        vecs.append(np.asarray(r[1], dtype="float32"))
        if len(ids) * vecs[0].nbytes >= block_bytes:
            yield np.array(ids), np.stack(vecs)
            ids, vecs = [], []
    if ids:
        yield np.array(ids), np.stack(vecs)


def _merged(ids: np.ndarray, sims: np.ndarray, own: np.ndarray, more: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` of two lists of candidates per row, by falling similarity and rising id."""
    all_ids, all_sims = np.hstack([ids, own]), np.hstack([sims, more])
    order = np.lexsort((all_ids, -all_sims), axis=1)[:, :k]
    return np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1)


def top_similar(queries: DataFrame, rows: DataFrame, id_col: str, vec_col: str, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, place, neighbour_id, cosine: the ``k`` most similar other rows of each query.

    Exact. Queries go to the tasks in blocks of a bounded number of bytes; each block reads the rows once, and each task keeps
    ``k`` rows per query over all it reads. Ties go to the lower id.
    """
    spark = rows.sparkSession

    def near(block):
        given = spark.sparkContext.broadcast(block)

        def run(batches):
            ids, q = given.value
            top_ids, top_sims = np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), -np.inf)
            for batch in batches:
                have = batch[batch[vec_col].notna()]
                if not len(have):
                    continue
                own, u = have[id_col].to_numpy().astype(np.int64), unit(np.stack(have[vec_col].to_numpy())).T
                for at in range(0, len(ids), BLOCK):
                    part = slice(at, at + BLOCK)
                    sims = np.round(unit(q[part]) @ u, 9)
                    sims[ids[part, None] == own[None, :]] = -np.inf
                    top_ids[part], top_sims[part] = _merged(top_ids[part], top_sims[part], np.broadcast_to(own, sims.shape), sims, k)
            row, place = np.nonzero(np.isfinite(top_sims))
            yield pd.DataFrame({"query_id": ids[row], "neighbour_id": top_ids[row, place], "cosine": top_sims[row, place]})

        return rows.select(id_col, vec_col).mapInPandas(run, "query_id bigint, neighbour_id bigint, cosine double")

    parts = [near(b) for b in _blocks(queries, id_col, vec_col, block_bytes)]
    if not parts:
        return spark.createDataFrame([], "query_id bigint, place int, neighbour_id bigint, cosine double")
    return top_per_group(reduce(DataFrame.unionByName, parts), ["query_id"], [F.desc("cosine"), "neighbour_id"], k).select("query_id", "place", "neighbour_id", "cosine")


def centroids(rows: DataFrame, label: str, vec_col: str) -> DataFrame:
    """label, n, centroid: mean unit vector per label, summed by position."""
    norm = F.sqrt(F.aggregate(vec_col, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    scaled = rows.where(F.col(label).isNotNull() & F.col(vec_col).isNotNull()).select(label, F.posexplode(F.transform(vec_col, lambda x: x / norm)).alias("k", "x"))
    means = scaled.groupBy(label, "k").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return means.groupBy(label).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).select(label, "n", F.transform("v", lambda p: p["x"]).alias("centroid"))


def bounded(df: DataFrame, most: int = MOST_TAGS) -> pd.DataFrame:
    """A table known to be small, in the driver; more than ``most`` rows are refused."""
    got = df.limit(most + 1).toPandas()
    if len(got) > most:
        raise ValueError(f"more than {most} tags; group them first")
    return got


def assign(rows: DataFrame, centres: pd.DataFrame, id_col: str, vec_col: str, label: str) -> DataFrame:
    """id, label of the nearest centre and its cosine (V07); the centres are bounded."""
    names, c = centres[label].to_numpy(), unit(np.stack(centres["centroid"]))

    def run(batches):
        for batch in batches:
            have = batch[batch[vec_col].notna()]
            if len(have):
                sims = np.round(unit(np.stack(have[vec_col].to_numpy())) @ c.T, 9)
                best = sims.argmax(axis=1)
                yield pd.DataFrame({"id": have[id_col].to_numpy(), "label": names[best], "cosine": sims[np.arange(len(best)), best]})

    return rows.select(id_col, vec_col).mapInPandas(run, "id bigint, label int, cosine double")


def gated(assigned: DataFrame, floor: float = 0.45, quantile: float = 0.05) -> DataFrame:
    """Assignments at or above their cluster's threshold, max(floor, quantile)."""
    limits = assigned.groupBy("label").agg(F.greatest(F.lit(floor), F.percentile("cosine", F.lit(quantile))).alias("least"))
    return assigned.join(F.broadcast(limits), "label").where("cosine >= least").select("id", "label", "cosine")


def kmeans(rows: DataFrame, vec_col: str, k: int, seeds: list[int]) -> DataFrame:
    """Cluster of every row under the seed with the least cost."""
    vectors = rows.where(F.col(vec_col).isNotNull()).withColumn("features", array_to_vector(F.col(vec_col).cast("array<double>")))
    fitted = [KMeans(k=k, seed=s, maxIter=20, distanceMeasure="cosine").fit(vectors) for s in seeds]
    best = min(fitted, key=lambda m: m.summary.trainingCost)
    return best.transform(vectors).drop("features").withColumnRenamed("prediction", "cluster")


def mutual_edges(m: np.ndarray, k: int, least: float) -> list[tuple[int, int, float]]:
    """Edges (i < j) where each is among the other's ``k`` most similar, at or above ``least``."""
    sims = unit(m) @ unit(m).T
    np.fill_diagonal(sims, -np.inf)
    near = [set(np.lexsort((np.arange(len(m)), -row))[:k]) for row in sims]
    return [(i, j, float(sims[i, j])) for i in range(len(m)) for j in sorted(near[i]) if i < j and i in near[j] and sims[i, j] >= least]


def communities(n: int, edges: list[tuple[int, int, float]], resolution: float = 1.0, passes: int = 20) -> list[int]:
    """Communities by moving nodes to the neighbour community with most modularity gain."""
    own = list(range(n))
    links: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        links[i][j] = links[j][i] = w
    strength = [sum(x.values()) for x in links]
    whole = sum(strength) or 1.0
    total = dict(enumerate(strength))
    for _ in range(passes):
        moved = False
        for i in range(n):
            total[own[i]] -= strength[i]
            into: dict[int, float] = {}
            for j, w in links[i].items():
                into[own[j]] = into.get(own[j], 0.0) + w
            gain = lambda c: into.get(c, 0.0) - resolution * strength[i] * total.get(c, 0.0) / whole  # noqa: B023, E731
            best = max(sorted({own[i], *into}), key=lambda c: (gain(c), c == own[i]))
            moved = moved or best != own[i]
            own[i] = best
            total[best] = total.get(best, 0.0) + strength[i]
        if not moved:
            break
    return _named(own)


def seed_groups(m: np.ndarray, counts: np.ndarray, least: float) -> list[int]:
    """Greedy groups: rows by falling count join the first group whose seed is similar enough."""
    u, out, seeds = unit(m), [-1] * len(m), []
    for i in sorted(range(len(m)), key=lambda i: (-counts[i], i)):
        hit = next((g for g, s in enumerate(seeds) if u[i] @ u[s] >= least), None)
        if hit is None:
            seeds.append(i)
            hit = len(seeds) - 1
        out[i] = hit
    return out


def merge_groups(m: np.ndarray, counts: np.ndarray, least: float) -> list[int]:
    """Agglomerative merging of the most similar pair of weighted centres until none is similar enough.

    Only rows whose nearest centre changed are looked at again.
    """
    n = len(m)
    sums, members = [m[i] * counts[i] for i in range(n)], {i: [i] for i in range(n)}
    u = unit(np.array(sums)) if n else np.zeros((0, 1))
    sims = u @ u.T
    np.fill_diagonal(sims, -np.inf)
    best = sims.argmax(axis=1) if n else np.zeros(0, dtype=int)
    while len(members) > 1:
        top = sims[np.arange(n), best]
        i = int(top.argmax())
        if top[i] < least:
            break
        i, j = sorted((i, int(best[i])))
        sums[i] = sums[i] + sums[j]
        members[i] = sorted(members[i] + members.pop(j))
        u[i] = unit([sums[i]])[0]
        row = u @ u[i]
        row[[k for k in range(n) if k not in members]] = -np.inf
        row[i] = -np.inf
        sims[i], sims[:, i] = row, row
        sims[j], sims[:, j] = -np.inf, -np.inf
        stale = [k for k in members if best[k] in (i, j) or k == i or sims[k, i] > sims[k, best[k]]]
        best[stale] = sims[stale].argmax(axis=1)
    out = [0] * n
    for g, i in enumerate(sorted(members)):
        for k in members[i]:
            out[k] = g
    return out


def gated_groups(m: np.ndarray, counts: np.ndarray, least: float, coherence: float, passes: int = 4) -> list[int]:
    """Rows by falling count go to the nearest weighted centre that is similar enough, as long as the group's mean similarity to its
    centre stays at ``coherence`` (V10); further passes move rows again until nothing changes."""
    u, own, groups, founded = unit(m), [-1] * len(m), {}, 0
    order = sorted(range(len(m)), key=lambda i: (-counts[i], i))

    def centre(members):
        return unit([(u[members] * counts[members][:, None]).sum(axis=0)])[0]

    for _ in range(passes):
        before = list(own)
        for i in order:
            if own[i] >= 0:
                groups[own[i]].remove(i)
                if not groups[own[i]]:
                    del groups[own[i]]
            own[i] = -1
            for sim, g in sorted(((float(centre(x) @ u[i]), -g) for g, x in groups.items()), reverse=True):
                new = [*groups[-g], i]
                if sim >= least and float(np.average(u[new] @ centre(new), weights=counts[new])) >= coherence:
                    own[i] = -g
                    break
            if own[i] < 0:
                own[i], founded = founded, founded + 1
            groups.setdefault(own[i], []).append(i)
        if _named(own) == _named(before):
            break
    return _named(own)


def _named(own: list[int]) -> list[int]:
    """Group numbers in the order that they appear."""
    names = {g: k for k, g in enumerate(dict.fromkeys(own))}
    return [names[g] for g in own]


def snowball_groups(m: np.ndarray, counts: np.ndarray, least: float, by_centre: bool) -> list[int]:
    """Rows by falling count roll into groups.

    Pairwise: a row joins the group of its most similar row, or founds one with it. By centre: it joins the group with the
    nearest centre if that is at least as near as the nearest row still free, else it founds one with that row. Below
    ``least`` it stays alone.
    """
    u, own, groups = unit(m), [-1] * len(m), []
    for i in sorted(range(len(m)), key=lambda i: (-counts[i], i)):
        if own[i] >= 0:
            continue
        sims = np.round(u @ u[i], 12)
        sims[i] = -np.inf
        free = np.where([g < 0 for g in own], sims, -np.inf)
        j = int((free if by_centre else sims).argmax())
        group, value = (own[j], sims[j]) if not by_centre else (-1, free[j])
        if by_centre and groups:
            near = np.array([float(unit([u[g].sum(axis=0)])[0] @ u[i]) for g in groups])
            if near.max() >= value:
                group, value = int(near.argmax()), float(near.max())
        if value < least:
            groups.append([i])
            own[i] = len(groups) - 1
        elif group >= 0:
            groups[group].append(i)
            own[i] = group
        else:
            groups.append([i, j])
            own[i] = own[j] = len(groups) - 1
    return own


def balanced_groups(m: np.ndarray, k: int, rounds: int = 12) -> list[int]:
    """Groups of sizes that differ by one at most (V13): rows with the clearest centre choose first, centres are taken anew."""
    u, k = unit(m), max(1, min(k, len(m)))
    if not len(u):
        return []
    seeds = [0]
    while len(seeds) < k:  # the row least like the seeds so far
        seeds.append(int((u @ u[seeds].T).max(axis=1).argmin()))
    centres, own = u[seeds], None
    for _ in range(rounds):
        room = [len(u) // k + (g < len(u) % k) for g in range(k)]
        sims, new = u @ centres.T, [-1] * len(u)
        for i in np.argsort(-sims.max(axis=1), kind="stable"):
            g = next(int(g) for g in np.argsort(-sims[i], kind="stable") if room[g])
            new[i], room[g] = g, room[g] - 1
        if new == own:
            break
        own = new
        centres = unit([u[[i for i, g in enumerate(own) if g == c]].sum(axis=0) for c in range(k)])
    return own


def modularity(n: int, edges: list[tuple[int, int, float]], own: list[int]) -> float:
    """Weighted modularity of a partition; 0 without edges."""
    whole = sum(w for _, _, w in edges)
    if not whole:
        return 0.0
    strength = [0.0] * n
    for i, j, w in edges:
        strength[i] += w
        strength[j] += w
    inside = sum(w for i, j, w in edges if own[i] == own[j]) / whole
    total: dict[int, float] = {}
    for i, s in enumerate(strength):
        total[own[i]] = total.get(own[i], 0.0) + s
    return inside - sum((t / (2 * whole)) ** 2 for t in total.values())


# Weights of the parts of a partition's score, and what it should look like.
SCORE = {"modularity": 1.0, "margin": 0.80, "coherence": 0.25, "shared_pct": 0.004, "blob": -0.50, "singles": -0.20, "count": -0.08}
MOST_PCT, BEST_COUNT = 24.0, 32


def partition_metrics(m: np.ndarray, counts: np.ndarray, own: list[int], edges: list[tuple[int, int, float]]) -> dict[str, float]:
    """How good a partition of weighted rows is (V05); margins are to the nearest other centre, 1 where there is none."""
    u, own_ = unit(m), np.array(own)
    kinds = sorted(set(own))
    centres = unit([u[own_ == g].mean(axis=0) for g in kinds])
    sims = u @ centres.T
    at = np.array([kinds.index(g) for g in own])
    mine = sims[np.arange(len(u)), at]
    sims[np.arange(len(u)), at] = -np.inf
    margins = np.where(np.isfinite(sims.max(axis=1)), mine - sims.max(axis=1), 1.0)
    sizes = np.array([counts[own_ == g].sum() for g in kinds])
    members = np.array([(own_ == g).sum() for g in kinds])
    largest, shared = 100 * sizes.max() / counts.sum(), 100 * sizes[members > 1].sum() / counts.sum()
    parts = {
        "modularity": modularity(len(u), edges, own),
        "margin": float(np.average(margins, weights=counts)),
        "coherence": float(np.average(mine, weights=counts)),
        "shared_pct": float(shared),
        "blob": max(0.0, largest - MOST_PCT) / MOST_PCT,
        "singles": float((members == 1).sum()) / len(kinds),
        "count": abs(len(kinds) - BEST_COUNT) / BEST_COUNT,
    }
    return {"n_groups": len(kinds), "n_singles": int((members == 1).sum()), "largest_pct": float(largest), "p10_margin": float(np.percentile(margins, 10)), **parts, "score": sum(SCORE[k] * v for k, v in parts.items())}


def grid(m: np.ndarray, counts: np.ndarray, ks: list[int], floors: list[float], resolutions: list[float]) -> list[dict]:
    """Metrics of the communities for every choice of neighbours, floor and resolution that has edges (V06), the best score first."""
    out = []
    for k in ks:
        for floor in floors:
            edges = mutual_edges(m, k, floor)
            out += [{"k": k, "floor": floor, "resolution": r, "n_edges": len(edges), **partition_metrics(m, counts, communities(len(m), edges, r), edges)} for r in resolutions if edges]
    return sorted(out, key=lambda x: (-x["score"], x["k"], x["floor"], x["resolution"]))


def sweep(m: np.ndarray, counts: np.ndarray, thresholds: list[float], sizes: list[int]) -> list[dict]:
    """The grouping methods at every threshold or size (V20): method, parameter, and the metrics of the partition."""
    methods = {"seed": seed_groups, "merge": merge_groups, "gated": lambda m, c, t: gated_groups(m, c, t, t), "snowball": lambda m, c, t: snowball_groups(m, c, t, False), "snowball_centre": lambda m, c, t: snowball_groups(m, c, t, True)}
    runs = [(name, t, f(m, counts, t)) for t in thresholds for name, f in methods.items()] + [("balanced", float(k), balanced_groups(m, k)) for k in sizes]
    return [{"method": name, "parameter": t, **partition_metrics(m, counts, own, [])} for name, t, own in runs]


def metrics(rows: DataFrame, centres: pd.DataFrame, id_col: str, vec_col: str, label: str) -> DataFrame:
    """``partition_metrics`` of rows of any number, each of weight one, without a graph (V05); the centres are bounded.

    One pass gives own similarity and margin, the rest is aggregation.
    """
    names, c = list(centres[label]), unit(np.stack(centres["centroid"]))

    def run(batches):
        place = {x: k for k, x in enumerate(names)}
        for batch in batches:
            have = batch[batch[vec_col].notna() & batch[label].isin(place)]
            if len(have):
                sims = unit(np.stack(have[vec_col].to_numpy())) @ c.T
                at = have[label].map(place).to_numpy()
                mine = sims[np.arange(len(at)), at]
                sims[np.arange(len(at)), at] = -np.inf
                yield pd.DataFrame({"label": have[label].to_numpy(), "own": mine, "margin": np.where(np.isfinite(sims.max(axis=1)), mine - sims.max(axis=1), 1.0)})

    told = rows.select(id_col, vec_col, label).mapInPandas(run, "label int, own double, margin double")
    per = told.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    size = per.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") == 1).alias("n_singles"), (100 * F.max("n") / F.sum("n")).alias("largest_pct"))
    whole = told.agg(F.avg("own").alias("coherence"), F.avg("margin").alias("margin"), F.percentile("margin", F.lit(0.1)).alias("p10_margin"))
    return size.withColumn("one", F.lit(1)).join(whole.withColumn("one", F.lit(1)), "one").drop("one")


def near_centres(spark, table: pd.DataFrame, label: str, k: int | None = None, floor: float = -2.0) -> DataFrame:
    """a, b, w, place: the ``k`` most similar other centres of each, or all, from ``floor`` on.

    The centres are bounded and sent to the tasks, each of which multiplies its own block of them.
    """
    names, m = table[label].to_numpy(), unit(np.stack(table["centroid"])) if len(table) else np.zeros((0, 1))
    given = spark.sparkContext.broadcast((names, m))

    def run(batches):
        labels, u = given.value
        for batch in batches:
            for start in batch["id"]:
                sims = np.round(u[start : start + CENTRES] @ u.T, 12)
                out = []
                for i, row in enumerate(sims, start):
                    row[i] = -np.inf
                    order = np.lexsort((np.arange(len(row)), -row))[: k if k is not None else len(row)]
                    out += [(int(labels[i]), int(labels[j]), float(row[j]), p) for p, j in enumerate(order, 1) if np.isfinite(row[j]) and row[j] >= floor]
                yield pd.DataFrame(out, columns=["a", "b", "w", "place"])

    blocks = max(1, -(-len(table) // CENTRES))
    return spark.range(0, blocks * CENTRES, CENTRES, blocks).mapInPandas(run, "a int, b int, w double, place int")


def mutual(near: DataFrame) -> DataFrame:
    """a < b, w: pairs where each is near the other."""
    back = near.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return near.where("a < b").join(back, ["a", "b"]).select("a", "b", "w")


def adjacency(near: DataFrame) -> DataFrame:
    """a, b, w: neighbours of either side with the squared similarity, the larger of both."""
    both = near.select("a", "b", "w").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.groupBy("a", "b").agg(F.max(F.col("w") * F.col("w")).alias("w"))


def named(support: DataFrame, centres: DataFrame, words: DataFrame) -> DataFrame:
    """The name of each group (V19): of its words (grp, word, n) the one with the most support-weighted cosine to the group's centre.

    ``centres`` has grp and centroid, ``words`` word and v.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda t, z: t + z)
    both = support.join(centres, "grp").join(words, "word")
    score = dot(F.col("centroid"), F.col("v")) / F.sqrt(dot(F.col("centroid"), F.col("centroid")) * dot(F.col("v"), F.col("v"))) + 0.035 * F.log1p("n")
    return both.withColumn("score", F.round(score, 9)).groupBy("grp").agg(F.max_by(F.struct("word", "score"), F.struct("score", "n", "word")).alias("b")).select("grp", "b.word", "b.score")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of an edge table (src, dst), by hash-to-minimum with pointer jumping.

    Every round is a join on node ids; lineage is cut by a checkpoint. Loops end after a number of rounds
    that grows with the logarithm of the longest path.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    links = cut(both)
    labels = cut(links.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("c")).withColumnRenamed("src", "node"))
    while True:
        seen = links.join(labels.withColumnsRenamed({"node": "dst", "c": "dc"}), "dst").groupBy(F.col("src").alias("node")).agg(F.min("dc").alias("m"))
        near = labels.join(seen, "node").select("node", "c", F.least("c", "m").alias("new"))
        jump = near.join(labels.withColumnsRenamed({"node": "new", "c": "nc"}), "new", "left").select("node", F.col("c").alias("old"), F.least(F.col("new"), F.coalesce("nc", "new")).alias("c"))
        after = cut(jump)
        changed = not after.where("c <> old").isEmpty()
        labels = after.select("node", "c")
        if not changed:
            return labels.withColumnRenamed("c", "component")


def weighted_jaccard(bags: DataFrame, group: str, item: str, n: str, pairs: DataFrame) -> DataFrame:
    """Weighted Jaccard of the bags of given pairs of groups (a, b)."""
    size = bags.groupBy(group).agg(F.sum(n).alias("size"))
    a = bags.select(F.col(group).alias("a"), F.col(item).alias("i"), F.col(n).alias("na"))
    b = bags.select(F.col(group).alias("b"), F.col(item).alias("i"), F.col(n).alias("nb"))
    shared = pairs.join(a, "a").join(b, ["b", "i"]).groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("shared"))
    sizes = pairs.join(size.withColumnsRenamed({group: "a", "size": "sa"}), "a").join(size.withColumnsRenamed({group: "b", "size": "sb"}), "b")
    whole = sizes.join(shared, ["a", "b"], "left").na.fill({"shared": 0})
    return whole.select("a", "b", F.round(F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared")), 6).alias("jaccard"))


def weighted_jaccard_all(bags: DataFrame, group: str, item: str, n: str) -> DataFrame:
    """Weighted Jaccard of every pair a < b of groups, 0 where nothing is shared or both are empty.

    Bags meet on their items, so pairs without a shared one cost nothing but their row. The groups are bounded.
    """
    size = bags.groupBy(group).agg(F.sum(n).alias("size"))
    own = sorted((x, int(s)) for x, s in bounded(size, MOST_GROUPED).itertuples(index=False))
    sides = [bags.select(F.col(group).alias(s), F.col(item).alias("i"), F.col(n).alias(f"n{s}")) for s in "ab"]
    shared = sides[0].join(sides[1], "i").where("a < b").groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("shared"))
    pairs = bags.sparkSession.createDataFrame([(a, x, b, y) for k, (a, x) in enumerate(own) for b, y in own[k + 1 :]], "a string, sa bigint, b string, sb bigint")
    whole = pairs.join(shared, ["a", "b"], "left").na.fill({"shared": 0})
    union = F.col("sa") + F.col("sb") - F.col("shared")
    return whole.select("a", "b", F.when(union > 0, F.round(F.col("shared") / union, 6)).otherwise(0.0).alias("jaccard"))


def cooccurrence(words: DataFrame, width: int, least: int) -> DataFrame:
    """Ordered word pairs within ``width`` places of a document, counted from ``least`` on, with Dice.

    ``words`` has doc_id, pos, word. A word meets at most ``width`` others, so pairs grow as the text does.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    ahead = F.array(*(F.lead("word", k).over(w) for k in range(1, width + 1)))
    windowed = words.select(F.col("word").alias("a"), ahead.alias("ahead"))
    pairs = windowed.select("a", F.explode(F.array_compact("ahead")).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    own = words.groupBy("word").agg(F.count(F.lit(1)).alias("w"))
    return pairs.join(own.withColumnsRenamed({"word": "a", "w": "wa"}), "a").join(own.withColumnsRenamed({"word": "b", "w": "wb"}), "b").select("a", "b", "n", F.round(2 * F.col("n") / (F.col("wa") + F.col("wb")), 6).alias("dice"))


def tfidf(tokens: DataFrame, doc: str, term: str, least_df: int, top: int) -> DataFrame:
    """The ``top`` terms of each document by (1 + ln tf) (ln((1 + N) / (1 + df)) + 1), from ``least_df`` documents on."""
    tf = tokens.groupBy(doc, term).agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(term).agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least_df)
    n = tokens.select(doc).distinct().agg(F.count(F.lit(1))).scalar()
    score = F.round((1 + F.log("tf")) * (F.log((1 + n) / (1 + F.col("df"))) + 1), 6)
    return top_per_group(tf.join(df, term).select(doc, term, score.alias("score")), [doc], [F.desc("score"), term], top)


def ngram_features(grams: DataFrame, doc: str, least_df: int = 2, most_share: float = 0.3, top: int = 180) -> DataFrame:
    """doc, gram, weight: the ``top`` grams of each document by sublinear TF-IDF, scaled to length one.

    Grams of fewer than ``least_df`` documents or of more than ``most_share`` of them are left out; ties go by spelling.
    """
    n = grams.select(doc).distinct().agg(F.count(F.lit(1))).scalar()
    tf = grams.groupBy(doc, "gram").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= least_df) & (F.col("df") <= most_share * n))
    scored = tf.join(df, "gram").select(doc, "gram", ((1 + F.log("tf")) * (F.log((1 + n) / (1 + F.col("df"))) + 1)).alias("x"))
    kept = top_per_group(scored, [doc], [F.desc("x"), "gram"], top)
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(doc)))
    return kept.select(doc, "gram", (F.col("x") / length).alias("weight"))


def feature_cosines(features: DataFrame, doc: str) -> DataFrame:
    """a < b, cosine of every pair of documents with a shared feature; other pairs are 0 and have no row."""
    a = features.select(F.col(doc).alias("a"), "gram", F.col("weight").alias("wa"))
    b = features.select(F.col(doc).alias("b"), "gram", F.col("weight").alias("wb"))
    return a.join(b, "gram").where("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("cosine"))


def procrustes(pairs: DataFrame, a: str, b: str) -> np.ndarray:
    """The rotation that best maps ``a`` vectors to ``b`` vectors (V18); tasks sum the D by D products."""

    def run(batches):
        total = None
        for batch in batches:
            x, y = unit(np.stack(batch[a].to_numpy())), unit(np.stack(batch[b].to_numpy()))
            total = x.T @ y if total is None else total + x.T @ y
        if total is not None:
            yield pd.DataFrame([(i, j, total[i, j]) for i in range(total.shape[0]) for j in range(total.shape[1])], columns=["i", "j", "x"])

    sums = pairs.select(a, b).mapInPandas(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    m = np.zeros((sums["i"].max() + 1, sums["j"].max() + 1))
    m[sums["i"], sums["j"]] = sums["x"]
    u, _, v = np.linalg.svd(m)
    return u @ v


def csls(rows: DataFrame, centres: pd.DataFrame, rotation: np.ndarray, id_col: str, vec_col: str, label: str, k: int = 10) -> DataFrame:
    """id, label, csls: for each rotated row the centre with the highest CSLS, 2 cos minus both mean cosines to the ``k`` nearest of the other side.

    The centres are bounded; tasks keep only the ``k`` best rows of each centre. Ties go to the first centre.
    """
    names, c = centres[label].to_numpy(), unit(np.stack(centres["centroid"]))

    def cosines(batch):
        return np.round(unit(np.stack(batch[vec_col].to_numpy())) @ rotation @ c.T, 9)

    def nearest(batches):
        best = np.empty((0, len(c)))
        for batch in batches:
            if len(batch):
                best = -np.sort(-np.vstack([best, cosines(batch)]), axis=0)[:k]
        yield pd.DataFrame([(t, float(x)) for row in best for t, x in enumerate(row)], columns=["t", "x"])

    have = rows.where(F.col(vec_col).isNotNull()).select(id_col, vec_col)
    means = top_per_group(have.mapInPandas(nearest, "t int, x double"), ["t"], [F.desc("x")], k).groupBy("t").agg(F.avg("x").alias("x")).toPandas()
    of_centre = np.zeros(len(c))
    of_centre[means["t"]] = means["x"]

    def pick(batches):
        for batch in batches:
            if len(batch):
                sims = cosines(batch)
                of_row = -np.sort(-sims, axis=1)[:, :k].mean(axis=1)
                scores = np.round(2 * sims - of_row[:, None] - of_centre[None, :], 9)
                at = scores.argmax(axis=1)
                yield pd.DataFrame({"id": batch[id_col].to_numpy(), "label": names[at], "csls": scores[np.arange(len(at)), at]})

    return have.mapInPandas(pick, "id bigint, label int, csls double")


def self_learned(rows: DataFrame, centres: pd.DataFrame, rotation: np.ndarray, id_col: str, vec_col: str, label: str, rounds: int = 5, k: int = 10) -> tuple[DataFrame, np.ndarray]:
    """``csls`` after further rounds (V18): the rotation is fitted anew on the pairs that the last one found, of each centre the row
    that fits it best, until no row finds another centre or the rounds are over. Gives the last result and its rotation.
    """
    spark = rows.sparkSession
    given = spark.createDataFrame([(int(x), [float(v) for v in c]) for x, c in zip(centres[label], centres["centroid"])], "label int, _centre array<double>")
    own = cut(csls(rows, centres, rotation, id_col, vec_col, label, k))
    for _ in range(rounds):
        best = own.groupBy("label").agg(F.max_by("id", F.struct("csls", -F.col("id"))).alias("id"))
        pairs = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v")).join(best, "id").join(given, "label")
        after = procrustes(pairs, "_v", "_centre")
        new = cut(csls(rows, centres, after, id_col, vec_col, label, k))
        moved = new.alias("n").join(own.alias("o"), "id").where("n.label <> o.label").isEmpty()
        own, rotation = new, after
        if moved:
            break
    return own, rotation
