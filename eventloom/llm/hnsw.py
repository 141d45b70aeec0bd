"""Embedding near-duplicates over hierarchical navigable small-world graphs, one per shard.

Vectors are dealt into shards; each shard gets a graph (Malkov and Yashunin, 2018), and every vector
queries every shard. A query whose beam is full of near-duplicates goes on through the graph from all
of them until no neighbour is close enough. Each shard is audited once, when its graph is built, with
vectors of its own as queries (vectors are dealt by hash, so others are like them): ``DRAWN`` drawn at
random, and up to ``AUDITED`` for which a beam of ``WIDE`` finds partners, are compared with the whole shard,
and the beam is doubled until the mean recall of those with true partners (others than themselves) reaches
``RECALL``. Where no beam below one ``WIDEST``-th of the shard does, queries are compared with all its vectors.
Every candidate is verified by its cosine in double precision. Links are united to components.

Scale: exact copies are one vector before indexing, so a group of copies is one query and one node.
Shards hold at most about ``SHARD`` vectors and ``BLOCK`` queries meet one shard in one task, so a
task's memory is bounded. An index is a file of the shared folder, which workers map into memory where the folder is one
of the machine and else read and keep one at a time; rows with it would fill the executors' heaps. Querying every shard is the method: with a fixed number of shards work
grows as n log n, beyond ``SHARD`` vectors each as n squared over ``SHARD``. A task returns one
row per query with links and a spanning forest of its links, never all pairs, and holds about ``LINKS`` links at a
time. Indexes are written files, results written tables; a lost executor costs its tasks.

Defined results: null vectors, empty ones, zero ones and those with null or non-finite components link with
nothing; vectors of another length only link with those of their own. Rows with the same id are
connected to each other. A null vec_id has no links, a null component and is not kept. An empty table gives an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import components, in_worker, table, union_roots
from eventloom.llm.kneser_ney import _qualified
from eventloom.session import cut, fresh_dir

THRESHOLD = 0.95
SHARDS, SHARD, BLOCK = 4, 50_000, 8_192
NEAR, BUILD_BEAM, BEAM = 12, 32, 32  # neighbours above the ground layer (twice as many there), beams
AT_ONCE, EXPANDED = 256, 4  # queries that descend together, nodes that each expands in a step
AUDITED, RECALL, WIDEST = 64, 0.99, 8
DRAWN, TRIED, WIDE = 256, 4_096, 128  # vectors audited at random, tried for partners, and the beam they are tried with
AUDIT = 0  # in place of a beam: find it by auditing the queries at hand
LINKS = 1_000_000  # links that a task holds at a time
NARROW = 1e-4  # single-precision margin below the threshold; double precision decides


class Graph:
    """Layered graph over unit vectors; all steps work on many queries together."""

    def __init__(self, x: np.ndarray, near: list[np.ndarray] | None = None, entry: int = 0):
        self.x, self.near, self.entry = x, near, entry
        if near is None:
            self._build()

    def _build(self) -> None:
        n = len(self.x)
        draw = np.random.default_rng(n)
        level = np.minimum(-np.log(1 - draw.random(n)) / np.log(NEAR), 8).astype(int)
        order = np.argsort(-level, kind="stable")  # upper layers are complete before lower ones grow
        self.near = [np.full((n, NEAR * (2 if layer == 0 else 1)), -1, np.int32) for layer in range(level.max() + 1)]
        self.entry, done = int(order[0]), 1
        while done < n:
            batch = order[done : done + min(done, AT_ONCE)]
            self._insert(batch, level[batch])
            done += len(batch)

    def _insert(self, batch: np.ndarray, level: np.ndarray) -> None:
        q = self.x[batch]
        at = np.full((len(batch), 1), self.entry)
        found = {}
        for layer in range(len(self.near) - 1, -1, -1):
            at, sims = self._beam(q, at, layer, BUILD_BEAM if layer <= level.max() else EXPANDED)
            found[layer] = (at, sims)
        for layer, (at, sims) in found.items():
            here = np.flatnonzero(level >= layer)
            if not len(here):
                continue
            among = q[here] @ q[here].T
            np.fill_diagonal(among, -np.inf)
            few = min(NEAR, len(here))
            best = np.argpartition(-among, few - 1, axis=1)[:, :few]
            ids = np.concatenate([at[here], np.where(np.isfinite(np.take_along_axis(among, best, 1)), batch[here][best], -1)], axis=1)
            close = np.concatenate([sims[here], np.take_along_axis(among, best, 1)], axis=1)
            chosen = self._diverse(ids, close, self.near[layer].shape[1])
            self.near[layer][batch[here]] = chosen
            self._back(layer, batch[here], chosen)

    def _back(self, layer: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """Give the chosen neighbours their new neighbour, choosing anew among old and new ones."""
        width = self.near[layer].shape[1]
        to, source = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        to, source = to[to >= 0], source[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(first, count)
        held = (self.near[layer][targets] >= 0).sum(axis=1)
        room = np.repeat(held + count <= width, count)  # lists with room just take the new ones
        self.near[layer][to[room], (np.repeat(held, count) + rank)[room]] = source[room]
        for low in range(0, int(count.max()) if len(count) else 0, width):
            now = (rank >= low) & (rank < low + width) & ~room
            rows = np.repeat(np.arange(len(targets)), count)[now]
            ids = np.full((len(targets), 2 * width), -1)
            ids[:, :width] = self.near[layer][targets]
            ids[rows, width + rank[now] - low] = source[now]
            touched = np.unique(rows)
            for at in range(0, len(touched), AT_ONCE):
                t = touched[at : at + AT_ONCE]
                sims = np.einsum("bd,bcd->bc", self.x[targets[t]], self.x[ids[t]])
                sims[ids[t] < 0] = -np.inf
                self.near[layer][targets[t]] = self._diverse(ids[t], sims, width)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """At most ``most`` neighbours: first those closer to the node than to any chosen one, then the nearest."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        c = self.x[ids]
        among = c @ c.transpose(0, 2, 1)
        chosen = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            apart = ~((among[:, k] > sims[:, k, None]) & chosen).any(axis=1)
            chosen[:, k] = (ids[:, k] >= 0) & apart & (chosen.sum(axis=1) < most)
        first = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, first, 1)
        if out.shape[1] < most:
            out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
        return out

    def _beam(self, q: np.ndarray, start: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``beam`` nodes of a layer for each query, nearest first; -1 and -inf fill up."""
        near, count = self.near[layer], len(q)
        seen = np.zeros((count, len(self.x)), bool)
        ids = np.full((count, beam), -1)
        ids[:, : start.shape[1]] = start[:, :beam]
        sims = np.full((count, beam), -np.inf, np.float32)
        r, k = np.nonzero(ids >= 0)
        sims[r, k] = np.einsum("pd,pd->p", q[r], self.x[ids[r, k]])
        seen[r, ids[r, k]] = True
        open_ = ids >= 0
        steps = min(EXPANDED, beam)
        while True:
            waiting = np.where(open_, sims, -np.inf)
            rows = np.flatnonzero(open_.any(axis=1))
            if not len(rows):
                break
            best = np.argpartition(-waiting[rows], steps - 1, axis=1)[:, :steps]
            use = np.take_along_axis(open_[rows], best, 1)
            open_[rows[:, None], best] = False
            picked = np.where(use, ids[rows[:, None], best], 0)
            new = np.where(use[:, :, None], near[picked], -1).reshape(len(rows), -1)
            new.sort(axis=1)
            fresh = new >= 0
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            fresh &= ~seen[rows[:, None], np.maximum(new, 0)]
            r, k = np.nonzero(fresh)
            close = np.full(new.shape, -np.inf, np.float32)
            if len(r):
                seen[rows[r], new[r, k]] = True
                close[r, k] = np.einsum("pd,pd->p", q[rows[r]], self.x[new[r, k]])
            all_ids, all_sims = np.concatenate([ids[rows], new], axis=1), np.concatenate([sims[rows], close], axis=1)
            all_open = np.concatenate([open_[rows], fresh], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[rows], open_[rows] = np.take_along_axis(all_sims, top, 1), np.take_along_axis(all_open, top, 1)
            ids[rows] = np.where(np.isfinite(sims[rows]), np.take_along_axis(all_ids, top, 1), -1)
            open_[rows] &= ids[rows] >= 0
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def within(self, q: np.ndarray, limit: float, beam: int) -> Iterator[np.ndarray]:
        """Nodes with a similarity of ``limit`` or more that the search finds, for each query; one after the
        other, as each may have as many as the shard has."""
        at = np.full((len(q), 1), self.entry)
        for layer in range(len(self.near) - 1, 0, -1):
            at, _ = self._beam(q, at, layer, EXPANDED)
        ids, sims = self._beam(q, at, 0, beam)
        for i in range(len(q)):
            hits = ids[i][sims[i] >= limit]
            yield self._flood(q[i], hits, limit) if len(hits) == beam else hits

    def _flood(self, q: np.ndarray, hits: np.ndarray, limit: float) -> np.ndarray:
        """All nodes reachable from the hits through nodes at or above the limit."""
        seen, all_, front = np.zeros(len(self.x), bool), [hits], hits
        seen[hits] = True
        while len(front):
            around = np.unique(self.near[0][front])
            around = around[around >= 0]
            around = around[~seen[around]]
            seen[around] = True
            front = around[self.x[around] @ q >= limit]
            all_.append(front)
        return np.concatenate(all_)


def unit(x: np.ndarray, kind=np.float64) -> np.ndarray:
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # exact, and no square over- or underflows
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(kind)


def others(hits: np.ndarray, own: int) -> np.ndarray:
    return hits[hits != own]


def partners(exact: np.ndarray, queries: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """All vectors within the threshold of each query, itself excepted."""
    return [others(np.flatnonzero(row), o) for row, o in zip(queries @ exact.T >= THRESHOLD, own)]


def audited(graph: Graph, exact: np.ndarray, queries: np.ndarray, own: np.ndarray) -> int | None:
    """Beam at which the mean recall of queries with true partners reaches ``RECALL``; None if none does."""
    order, drawn, truth = np.random.default_rng(len(queries)).permutation(len(queries)), [], []
    for at in range(0, len(order), AUDITED):
        some = order[at : at + AUDITED]
        found = partners(exact, queries[some], own[some])
        drawn += [i for i, t in zip(some, found) if len(t)]
        truth += [t for t in found if len(t)]
        if len(drawn) >= AUDITED:
            break
    if not drawn:  # then every query has been compared, and there is nothing to find
        return BEAM
    single, beam = queries[drawn].astype(np.float32), BEAM
    while beam * WIDEST <= len(exact):
        got = graph.within(single, THRESHOLD - NARROW, beam)
        if np.mean([len(np.intersect1d(t, g)) / len(t) for t, g in zip(truth, got)]) >= RECALL:
            return beam
        beam *= 2
    return None


def audited_shard(graph: Graph, exact: np.ndarray) -> int | None:
    """Beam of a shard, from an audit whose cost is linear in it."""
    order = np.random.default_rng(len(exact)).permutation(len(exact))
    tried, paired = order[:TRIED], []
    for at in range(0, len(tried), AT_ONCE):
        some = tried[at : at + AT_ONCE]
        found = graph.within(exact[some].astype(np.float32), THRESHOLD - NARROW, min(WIDE, len(exact)))
        paired += [i for i, h in zip(some, found) if (exact[others(h, i)] @ exact[i] >= THRESHOLD).any()]
        if len(paired) >= AUDITED:
            break
    chosen = np.unique(np.r_[order[:DRAWN], np.array(paired[:AUDITED], order.dtype)])
    return audited(graph, exact, exact[chosen], chosen)


def search(
    graph: Graph, exact: np.ndarray, queries: np.ndarray, own: np.ndarray | None = None, beam: int | None = AUDIT
) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Verified hits of unit vectors (double precision), some queries at a time, as many as have about
    ``LINKS`` hits; the beam is wide enough for the audited recall; None compares with all. ``own`` is each query's node, which is no hit of it, or -1."""
    own = np.full(len(queries), -1) if own is None else own
    single = queries.astype(np.float32)
    if beam == AUDIT:
        beam = audited(graph, exact, queries, own)
    step = AT_ONCE if beam else AUDITED
    for at in range(0, len(queries), step):
        q, o = queries[at : at + step], own[at : at + step]
        if beam is None:
            yield at, partners(exact, q, o)
            continue
        found = graph.within(single[at : at + step], THRESHOLD - NARROW, min(beam, max(len(exact), 1)))
        first, held, size = at, [], 0
        for h, x, i in zip(found, q, o):
            held.append(others(h[exact[h] @ x >= THRESHOLD], i))
            size += len(held[-1])
            if size >= LINKS:
                yield first, held
                first, held, size = first + len(held), [], 0
        if held:
            yield first, held


def _packed(arrays: dict[str, np.ndarray]) -> tuple[bytes, str]:
    """Arrays one behind the other, and what they are: name -> type, shape and place."""
    parts, listed, size = [], {}, 0
    for name, array in arrays.items():
        listed[name] = (array.dtype.str, array.shape, size)
        parts.append(np.ascontiguousarray(array).tobytes())
        parts.append(bytes(-len(parts[-1]) % 64))  # so that the next one lies as its type needs
        size += len(parts[-2]) + len(parts[-1])
    return b"".join(parts), json.dumps(listed)


def _unpacked(raw: np.ndarray, listed: str) -> dict[str, np.ndarray]:
    """The arrays of :func:`_packed`, where they lie."""
    out = {}
    for name, (kind, shape, at) in json.loads(listed).items():
        out[name] = raw[at : at + int(np.prod(shape)) * np.dtype(kind).itemsize].view(kind).reshape(shape)
    return out


def _raw(path: str) -> np.ndarray:
    """A shard's file: mapped where the folder is one of the machine, else read and kept by the worker."""
    files, at = pafs.FileSystem.from_uri(path)
    if isinstance(files, pafs.LocalFileSystem):
        return np.memmap(at, np.uint8, "r")

    def read() -> np.ndarray:
        with files.open_input_file(at) as f:
            return np.frombuffer(f.read(), np.uint8)

    return in_worker(path, read)


def _index(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's vectors, graph and beam (-1: compare with all), packed."""
    x = np.stack(rows["embedding"].to_numpy())
    exact = unit(x)
    graph = Graph(exact.astype(np.float32))
    beam, vec = audited_shard(graph, exact) or -1, rows["vec"].to_numpy().astype(bytes)
    packed, listed = _packed({
        "x": x, "vec": vec, "order": np.argsort(vec), "rep": rows["rep"].to_numpy(), "copies": rows["copies"].to_numpy(),
        "beam_entry": np.array([beam, graph.entry]), **{f"near_{i}": layer for i, layer in enumerate(graph.near)},
    })
    return pd.DataFrame({"shard": [key[0]], "packed": [packed], "listed": [listed]})


def _filed(made: pd.DataFrame, folder: str) -> pd.DataFrame:
    """A packed shard as a file of the shared folder: (shard, name, listed). An index is some twenty MB, which
    rows would bring through the executor's heap once for each block of queries."""
    files, base = pafs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    name = uuid.uuid4().hex  # a task that runs again writes a file of its own
    with files.open_output_stream(f"{base}/{name}") as out:
        out.write(made["packed"].iloc[0])
    return made.assign(name=name)[["shard", "name", "listed"]]


def _answer(key: tuple, queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """(vec, links) of each query with links to other vectors of the shard, and links (a, b) that span its components."""
    if not len(queries) or not len(index):
        return pd.DataFrame({"vec": [], "links": [], "a": [], "b": []}, dtype=object)
    packed = index["packed"].iloc[0]
    return _answers(queries, _unpacked(np.frombuffer(packed, np.uint8), index["listed"].iloc[0]))


def _answers(queries: pd.DataFrame, z: dict[str, np.ndarray]) -> pd.DataFrame:
    vec, rep, copies, order, (beam, entry) = z["vec"], z["rep"], z["copies"], z["order"], z["beam_entry"].tolist()
    near = [z[f"near_{i}"] for i in range(sum(name.startswith("near_") for name in z))]
    exact, asked = unit(z["x"]), unit(np.stack(queries["embedding"].to_numpy()))
    graph, own = Graph(exact.astype(np.float32), near, entry), queries["rep"].to_numpy()
    named = queries["vec"].to_numpy().astype(bytes)
    itself = order[np.minimum(np.searchsorted(vec, named, sorter=order), len(vec) - 1)]
    itself = np.where(vec[itself] == named, itself, -1)
    nodes, place = np.unique(np.concatenate([own, rep]), return_inverse=True)
    label, links = np.arange(len(nodes)), np.zeros(len(own), np.int64)
    for at, found in search(graph, exact, asked, itself, None if beam < 0 else beam):
        a = np.repeat(place[at : at + len(found)], [len(h) for h in found])
        h = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
        links[at : at + len(found)] = [copies[x_].sum() for x_ in found]
        b = place[len(own) + h]
        label = union_roots(len(nodes), np.r_[a, np.arange(len(nodes))], np.r_[b, label])
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    hit = np.flatnonzero(links)
    none_a, none_b = [None] * len(hit), [None] * len(tied)
    return pd.DataFrame(
        {
            "vec": pd.Series([*queries["vec"].to_numpy()[hit], *none_b], dtype=object),
            "links": pd.Series([*links[hit].tolist(), *none_b], dtype=object),
            "a": pd.Series([*none_a, *nodes[tied].tolist()], dtype=object),
            "b": pd.Series([*none_a, *nodes[label[tied]].tolist()], dtype=object),
        }
    )


def _indexes(placed: DataFrame) -> dict[int, tuple[str, str]]:
    """Files of all shards and what is in them; one small row for each comes to the driver."""
    folder = _qualified(placed.sparkSession, fresh_dir(placed.sparkSession, "shards"))

    def file(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _filed(_index(key, rows), folder)

    made = placed.groupBy("shard").applyInPandas(file, "shard long, name string, listed string")
    return {r.shard: (f"{folder}/{r['name']}", r.listed) for r in made.collect()}


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    single = vectors.select(vectors[embedding]).dtypes[0][1] == "array<float>"
    kind = "array<float>" if single else "array<double>"  # either way the cosine is one of doubles
    v = vectors.select(vectors[vec_id].alias("vec_id"), vectors[embedding].cast(kind).alias("embedding"))
    e = F.col("embedding")
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.col("vec_id").isNotNull() & (F.size(e) > 0) & ~bad & F.exists(e, lambda c: c != 0)
    name = F.sha2(F.concat_ws(",", e.cast("array<string>")), 256)  # equal vectors have equal names
    named = cut(v.select("vec_id", F.when(F.coalesce(usable, F.lit(False)), name).alias("vec"), "embedding"))
    reps = named.filter("vec is not null").groupBy("vec").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")
    )
    reps = cut(reps)
    count = reps.count()
    shards, blocks = max(SHARDS, -(-count // SHARD)), max(1, -(-count // BLOCK))
    size = F.size("embedding").cast("long") * shards
    placed = reps.withColumn("shard", size + F.pmod(F.xxhash64("vec"), F.lit(shards)))
    indexes = _indexes(placed)
    asked = reps.select(
        "vec", "rep", "embedding", F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(size, size + shards - 1)).alias("shard"),
    )

    def answer(key: tuple, queries: pd.DataFrame) -> pd.DataFrame:
        if key[0] not in indexes:  # no vector of this length was dealt to the shard
            return pd.DataFrame({"vec": [], "links": [], "a": [], "b": []}, dtype=object)
        path, listed = indexes[key[0]]
        return _answers(queries, _unpacked(_raw(path), listed))

    answers = cut(asked.groupBy("shard", "block").applyInPandas(answer, "vec string, links long, a long, b long"))
    roots = cut(components(answers.filter("a is not null").select("a", "b")))
    # copies of a vector are known without the search, which leaves the vector itself out
    degree = answers.filter("vec is not null").groupBy("vec").agg(F.sum("links").alias("others"))
    n_links = F.coalesce("others", F.lit(0)) + F.col("copies") - 1
    per_vec = (
        reps.select("vec", "rep", "copies")
        .join(degree, "vec", "left")
        .join(roots, F.col("rep") == roots["node"], "left")
        .select(F.col("vec").alias("v"), "rep", n_links.alias("n_links"), F.coalesce("root", "rep").alias("component"))
    )
    # rows of one id with different vectors are one node
    own = named.filter("vec_id is not null").groupBy("vec_id").agg(F.min("vec").alias("one"), F.max("vec").alias("other"))
    if own.filter("one <> other").isEmpty():
        joined = named.join(per_vec, named["vec"] == per_vec["v"], "left")
    else:
        ties = named.filter("vec is not null").join(reps.select(F.col("vec").alias("v"), "rep"), F.col("vec") == F.col("v"))
        roots = cut(components(ties.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")).union(roots.select("node", "root"))))
        per_vec = per_vec.drop("component").join(roots, F.col("rep") == roots["node"], "left").select(
            "v", "n_links", F.coalesce("root", "rep").alias("component")
        )
        joined = named.join(per_vec, named["vec"] == per_vec["v"], "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
