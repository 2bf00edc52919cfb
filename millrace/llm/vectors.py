"""Near-duplicates among embeddings by search in a robust-pruned flat graph.

Vectors of a label are split into shards: sampled pivots divide what is larger than SHARD, and each
vector goes to the two nearest pivots, so shards overlap. Each shard builds a graph by robust pruning
(a neighbour is kept unless one kept before it is nearer to it by the factor ALPHA). The adjacency
lists of a vector from all its shards are united. Every vector is then a query: greedy search from
itself and the medoids of its shards, and from there on along all vectors within SLACK, until nothing
new is in range. What it meets that is at home in a shard it wasn't sent to, sends it there in the next
round, where the search also starts from what was met. The nearest vectors of a vector in a large group
are a small part of the group only, so each also keeps SPREAD vectors from all over those within SLACK:
with them the range holds together.

Every link is verified by the cosine in double precision. A vector is counted in its home shard only,
so no link counts twice and pairs are never listed; what leaves a task is a count for each query and
links that span what it found. `audit` measures the recall against brute force.

Equal vectors of a label are one node with a multiplicity. Shards are bounded; nothing is gathered by
label. The pivots of a cell are sent to its chunks by a join on the cell.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label
or id, link with nothing and are their own component. Vectors of different lengths are never
compared. Repeated rows are vectors of their own. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.workspace import stored

COSINE = 0.98
SLACK = 0.95  # search goes on along vectors of at least this cosine
REACH = 2 * SLACK**2 - 1  # two vectors within SLACK of a third have at least this cosine
SHARD = 1_500
MOST_PIVOTS = 64
LEVELS = 12
CHUNK = 4_096
NEAREST, DEGREE, ALPHA, SPREAD = 64, 24, 1.2, 8
MEDOIDS, BEAM = 16, 8


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prepared(rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """key, node (null where the row links with nothing), cell, v."""
    v = F.col("v")
    fine = (
        F.col("id").isNotNull()
        & F.col("label").isNotNull()
        & (F.size("v") > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    cell = F.concat_ws(":", F.col("label").cast("string"), F.size("v").cast("string"))
    node = F.unhex(F.md5(F.concat_ws("|", cell, v.cast("string"))))
    kept = F.coalesce(fine, F.lit(False))
    named = rows.select(
        F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")
    )
    return named.select("id", F.when(kept, node).alias("node"), F.when(kept, cell).alias("cell"), "v")


def sharded(nodes: DataFrame) -> DataFrame:
    """shard, node, v, home: the vector's own shard among its shards."""
    done = None
    members = nodes.select(F.col("cell").alias("shard"), "node", "v", F.lit(True).alias("own"))
    for level in range(LEVELS):
        members = stored(members, "vector_cells")
        sizes = members.groupBy("shard").agg(F.count("*").alias("size"))
        large = stored(sizes.where(F.col("size") > (SHARD if level < LEVELS - 1 else 1 << 62)), "vector_large")
        small = members.join(large.select("shard"), "shard", "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            break
        members = split(members.join(large, "shard"), level)
    done = stored(done, "vector_shards")
    home = done.where("own").select("node", F.col("shard").alias("home"))
    return done.drop("own").join(home, "node")


def split(members: DataFrame, level: int) -> DataFrame:
    """Members of large cells to the cells of their two nearest pivots."""
    wanted = F.least(F.ceil(2 * F.col("size") / SHARD) + 2, F.lit(MOST_PIVOTS))
    drawn = (F.shiftrightunsigned(F.xxhash64("node", F.lit(level)), 11)).cast("double") / float(1 << 53)
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    pivots = members.where(drawn < wanted / F.col("size")).select(
        "shard", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "node", "v"
    )
    pivots = stored(pivots, "vector_pivots")
    dealt = members.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).drop("size")

    def assign(some: pd.DataFrame, to: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(to):
            return some.drop(columns="chunk")
        to = to.sort_values("node", kind="stable")
        near = np.argsort(-(unit(some["v"]) @ unit(to["v"]).T), axis=1, kind="stable")[:, :2]
        parts = []
        for rank in range(near.shape[1]):
            part = some.drop(columns="chunk")
            part["shard"] = [f"{s}/{p}" for s, p in zip(some["shard"], near[:, rank])]
            part["own"] = part["own"] & (rank == 0)
            parts.append(part)
        return pd.concat(parts)

    by = ["shard", "chunk"]
    return dealt.groupBy(*by).cogroup(pivots.groupBy(*by)).applyInPandas(
        assign, "shard string, node binary, v array<double>, own boolean"
    )


def pruned(x: np.ndarray, of: int, candidates: np.ndarray) -> list[int]:
    """Robust pruning of the candidates, nearest first."""
    distance = 1 - x[candidates] @ x[of]
    order = np.argsort(distance, kind="stable")
    candidates, distance = candidates[order], distance[order]
    between = 1 - x[candidates] @ x[candidates].T
    alive, kept = candidates != of, []
    while alive.any() and len(kept) < DEGREE:
        k = int(np.argmax(alive))
        kept.append(int(candidates[k]))
        alive &= ALPHA * between[k] > distance
        alive[k] = False
    return kept


def medoids(x: np.ndarray) -> np.ndarray:
    """The vector nearest to the mean, then each time the one farthest from those chosen."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(MEDOIDS, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    return np.unique(chosen)


def shard_graph(x: np.ndarray) -> list[list[int]]:
    n = len(x)
    starts = medoids(x)
    lists: list[list[int]] = []
    spread: list[set[int]] = [set() for _ in range(n)]
    drawn = np.random.default_rng(n).random(n)
    for first in range(0, n, 256):
        near = x[first : first + 256] @ x.T
        top = np.argpartition(-near, min(NEAREST, n - 1), axis=1)[:, : NEAREST + 1]
        lists += [pruned(x, first + i, np.union1d(row, starts)) for i, row in enumerate(top)]
        for i in np.flatnonzero((near >= SLACK).sum(axis=1) > NEAREST):
            group = np.flatnonzero(near[i] >= SLACK)
            place = ((np.arange(SPREAD) + drawn[first + i]) * len(group) / SPREAD).astype(int)
            spread[first + i].update(set(group[place].tolist()) - {int(first + i)})
    back: list[set[int]] = [set(row) for row in lists]
    for i, row in enumerate(lists):
        for j in row:
            back[j].add(i)
    for i, row in enumerate(back):
        if len(row) > 2 * DEGREE:
            back[i] = set(pruned(x, i, np.array(sorted(row))))
    for i, row in enumerate(spread):  # both ways, and never pruned
        for j in row:
            back[i].add(j)
            back[j].add(i)
    return [sorted(row) for row in back]


def graph(members: DataFrame) -> DataFrame:
    """shard, node, v, home, near: the united adjacency list of the node, with the homes of its nodes.

    A node beyond REACH has no home there: no query can have it and the list's node both within SLACK.
    """

    def build(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("node", kind="stable")
        node = shard["node"].to_numpy()
        x = unit(shard["v"])
        lists = shard_graph(x)
        a = np.repeat(np.arange(len(node)), [len(r) for r in lists])
        b = np.fromiter((j for r in lists for j in r), int, len(a))
        # the last digit of a cosine depends on the shard, its class may not: it is a hint for the search only
        close = np.einsum("ij,ij->i", x[a], x[b]) >= REACH
        return pd.DataFrame({"a": node[a], "b": node[b], "close": close})

    edges = members.groupBy("shard").applyInPandas(build, "a binary, b binary, close boolean")
    edges = edges.groupBy("a", "b").agg(F.max("close").alias("close"))
    homes = members.where(F.col("shard") == F.col("home")).select(F.col("node").alias("b"), "home")
    lists = edges.join(homes, "b").groupBy(F.col("a").alias("node")).agg(
        F.collect_list(F.struct("b", F.when(F.col("close"), F.col("home")).alias("home"))).alias("near")
    )
    joined = members.join(lists, "node", "left")
    return joined.select(
        "shard", "node", "v", "home", F.col("near.b").alias("near"), F.col("near.home").alias("near_home")
    )


def search(
    x: np.ndarray, lists: list[np.ndarray], starts: np.ndarray, queries: np.ndarray, entry: np.ndarray
) -> np.ndarray:
    """Cosines of the queries (rows) to the vectors that the search met; -2 to others."""
    n_queries, n = len(queries), len(x)
    score = np.full((n_queries, n), -2.0)
    done = np.zeros((n_queries, n), bool)
    degree = np.array([len(r) for r in lists])
    flat = np.concatenate(lists) if degree.sum() else np.zeros(0, int)
    offset = np.cumsum(degree) - degree
    score[:, starts] = queries @ x[starts].T
    score[np.arange(n_queries), entry] = np.einsum("ij,ij->i", queries, x[entry])

    def expand(q: np.ndarray, node: np.ndarray) -> None:
        done[q, node] = True
        size = degree[node]
        to = flat[np.repeat(offset[node] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        of = np.repeat(q, size)
        fresh = score[of, to] == -2.0
        pair = np.unique(of[fresh] * n + to[fresh])
        of, to = pair // n, pair % n
        for first in range(0, len(of), 1 << 15):
            part = slice(first, first + (1 << 15))
            score[of[part], to[part]] = np.einsum("ij,ij->i", queries[of[part]], x[to[part]])

    active = np.arange(n_queries)
    while len(active):  # greedy: those of the beam that aren't expanded yet
        own = score[active]
        beam = np.partition(own, -min(BEAM, n), axis=1)[:, -min(BEAM, n)]
        q, best = np.nonzero((own >= beam[:, None]) & (own > -2.0) & ~done[active])
        if len(q):
            expand(active[q], best)
        active = active[np.unique(q)]
    while True:  # range: all within the slack
        q, node = np.nonzero((score >= SLACK) & ~done)
        if not len(q):
            return score
        expand(q, node)


FOUND = "kind int, a binary, b binary, shard string, n long"


def searched(graph: DataFrame, queries: DataFrame) -> DataFrame:
    """What the searches of the queries (shard, node, v, asked, entry) find: counts, links and further shards.

    entry: a vector of the shard to start from, beside the medoids.
    """

    def run(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(shard) and len(asked):
            shard = shard.sort_values("node", kind="stable").reset_index(drop=True)
            x, node, home = unit(shard["v"]), shard["node"].tolist(), shard["home"].to_numpy()
            here = home == shard["shard"].iloc[0]
            place = {b: i for i, b in enumerate(node)}
            empty: tuple = ()
            near = [empty if r is None else r for r in shard["near"]]
            lists = [np.array([place[b] for b in r if b in place], int) for r in near]
            away = [
                [(h, b) for b, h in zip(r, empty if hs is None else hs) if h is not None and b not in place]
                for r, hs in zip(near, shard["near_home"])
            ]
            copies = shard["n"].to_numpy()
            starts = medoids(x)
            root = list(range(len(node)))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for first in range(0, len(asked), 512):
                part = asked.iloc[first : first + 512]
                entry = np.array([place[b] for b in part["entry"]], int)
                score = search(x, lists, starts, unit(part["v"]), entry)
                for q, known, line in zip(part["node"], part["asked"], score):
                    close = np.flatnonzero(line >= SLACK)
                    linked = close[line[close] >= COSINE]
                    others = [i for i in linked if node[i] != q]
                    count = int(sum(copies[i] for i in others if here[i]))
                    if count:
                        rows.append((0, q, None, None, count))
                    if others:
                        anchor = place.get(q)
                        if anchor is None:
                            anchor = others[0]
                            rows.append((1, q, node[anchor], None, 0))
                        for i in others:
                            root[find(i)] = find(anchor)
                    known = set(known)
                    more = {h: b for i in close for h, b in away[i]} | {home[i]: node[i] for i in close}
                    rows += [(2, q, b, h, 0) for h, b in more.items() if h not in known]
            rows += [(1, node[i], node[find(i)], None, 0) for i in range(len(node)) if find(i) != i]
        return pd.DataFrame(rows, columns=["kind", "a", "b", "shard", "n"])

    return graph.groupBy("shard").cogroup(queries.groupBy("shard")).applyInPandas(run, FOUND)


def linked(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """key, n_links, component_id (least key that can be reached), kept; one row per vector."""
    named = prepared(rows, key, label, vector)
    usable = named.where("node is not null")
    nodes = stored(
        usable.groupBy("node", "cell").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("v").alias("v")),
        "vector_nodes",
    )
    members = stored(sharded(nodes), "vector_members")
    built = stored(graph(members).join(nodes.select("node", "n"), "node"), "vector_graph")
    asked = members.groupBy("node").agg(F.collect_set("shard").alias("asked"))
    queries = members.select("shard", "node", "v", F.col("node").alias("entry")).join(asked, "node")
    found = None
    while True:
        new = stored(searched(built, queries), "vector_found")
        found = new if found is None else found.unionByName(new)
        more = new.where("kind = 2").groupBy(F.col("a").alias("node"), "shard").agg(F.min("b").alias("entry"))
        more = stored(more, "vector_asked")
        if more.isEmpty():
            break
        asked = (
            asked.select("node", F.explode("asked").alias("shard"))
            .unionByName(more.drop("entry"))
            .groupBy("node")
            .agg(F.collect_set("shard").alias("asked"))
        )
        queries = more.join(nodes.select("node", "v"), "node").join(asked, "node")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("found"))
    labels = components(stored(found.where("kind = 1").select("a", "b"), "vector_links"))
    known = nodes.drop("v", "cell").join(labels, "node", "left").withColumn("part", F.coalesce("component", "node"))
    least = known.groupBy("part").agg(F.min("least").alias("component_id"))
    known = known.join(least, "part").join(counts, "node", "left")
    known = known.select("node", "component_id", (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("links"))
    joined = named.select("id", "node").join(known, "node", "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        F.col("id").alias(key),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def audit(rows: DataFrame, result: DataFrame, queries: int = 256, key: str = "vec_id", label: str = "label",
          vector: str = "embedding") -> float:
    """Share of the links of some vectors (a bounded number, by hash) that the result has."""
    named = prepared(rows, key, label, vector).where("node is not null")
    some = named.orderBy(F.xxhash64("id"), "id").limit(queries).collect()
    by_cell: dict[str, list] = {}
    for r in some:
        by_cell.setdefault(r.cell, []).append((r.id, r.v))
    shared = rows.sparkSession.sparkContext.broadcast(by_cell)

    def brute(batches):
        for frame in batches:
            for cell, part in frame.groupby("cell"):
                asked = shared.value.get(cell, [])
                if asked:
                    near = unit(pd.Series([v for _, v in asked])) @ unit(part["v"]).T
                    yield pd.DataFrame({"id": [i for i, _ in asked], "n": (near >= COSINE).sum(axis=1)})

    kind = named.schema["id"].dataType.simpleString()
    exact = named.select("id", "cell", "v").mapInPandas(brute, f"id {kind}, n long")
    exact = exact.groupBy("id").agg((F.sum("n") - 1).alias("n"))
    both = exact.join(result.select(F.col(key).alias("id"), "n_links"), "id").agg(F.sum("n"), F.sum("n_links")).first()
    return both[1] / both[0] if both[0] else 1.0
