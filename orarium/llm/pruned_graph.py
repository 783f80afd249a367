"""Embedding near-duplicates over a robust-pruned flat graph.

Equal vectors are one class. Around dense spots classes are gathered into balls: vectors so near a common middle that all
of them are linked with each other for certain (each within half the threshold's angle). A ball is one node of the graph,
with its middle and radius, so a group of thousands of copies costs a few nodes, however hot it is.

- Shards: centres are fitted on a bounded sample; each node lies in the cells of its `OVERLAP` nearest centres, and a
  centre with too many nodes has several cells.
- Graph: in each cell a node's nearest candidates and some drawn ones are pruned (a candidate goes if a chosen one is
  nearer to it by the factor `ALPHA`), reverse edges are added, and a node's lists of all cells are united.
- Search: every node runs a greedy search with a beam from the medoid of each cell of its nearest centres (and from
  itself where it lies there). Whatever is in range is expanded as well, so a search goes on for as long as it finds more.
- Audit: for a bounded sample of vectors all links are counted by brute force; below `RECALL` the search is run again over
  twice the centres with twice the beam, until it covers every cell.
- Verification: of two balls in range either all members are linked for certain, by the angles, or the members are
  compared in double precision. Only counts and links between balls leave a task, no pairs within a group.

Defined results: a vector that is null, empty, all zeros, or holds a null, NaN or infinite component is linked with
nothing, as is a row without an id (component null, kept). Vectors of different lengths are not linked. Rows that share an
id are vectors of their own; equal vectors are linked, whatever their ids. Further columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orarium.llm.bbit_minhash import groups
from orarium.llm.common import arrow_map, batch, discard, pick, written
from orarium.llm.components import components

COSINE = 0.9
#: Vectors that the centres are fitted on, nodes a centre is meant for, most centres, most vectors of a cell.
SAMPLE, SHARD, MOST_CENTRES, CELL = 16_384, 2048, 1024, 4096
OVERLAP, DEGREE, CANDIDATES, DRAWN, ALPHA = 2, 16, 40, 8, 1.2
#: First number of centres and beam of a search; vectors that the audit compares with all others, and what it asks for.
PROBES, BEAM, AUDIT, RECALL = 3, 16, 1024, 0.97
#: Angles nearer to a bound than this are settled by comparing vectors.
SLACK = 1e-6


def stacked(column: pa.Array | pa.ChunkedArray, size: int, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, size)


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


# --- classes and centres ---


def digests(vectors: DataFrame) -> DataFrame:
    """vec_id, and size, sid (digest) and unit of the vectors that can be linked."""
    types = {"vec_id": pa.int64(), "size": pa.int32(), "sid": pa.binary(), "unit": pa.binary()}

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sids, units = [], []
            for size, x in zip(b.column("size").to_pylist(), b.column("x"), strict=True):
                if size is None:
                    sids.append(None)
                    units.append(None)
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                sids.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest())
                v = v / np.abs(v).max()
                units.append((v / np.linalg.norm(v)).tobytes())
            yield batch(types, b.column("vec_id"), b.column("size"), sids, units)

    whole = F.col("vec_id").isNotNull() & F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    rows = vectors.select("vec_id", F.transform("x", lambda c: c.cast("double")).alias("x")).withColumn("size", F.when(whole, F.size("x")))
    return arrow_map(rows.select("vec_id", "size", F.when(F.col("size").isNotNull(), F.col("x")).alias("x")), digest, "vec_id long, size int, sid binary, unit binary")


def fitted_centres(units: np.ndarray, count: int) -> np.ndarray:
    """Directions of the means of `count` clusters, by a few rounds over the sample."""
    rng = np.random.default_rng(11)
    centres = units[rng.choice(len(units), min(count, len(units)), replace=False)].copy()
    for _ in range(4):
        near = np.concatenate([(units[at : at + 2048] @ centres.T).argmax(axis=1) for at in range(0, len(units), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, units)
        length = np.linalg.norm(sums, axis=1)
        centres[length > 0] = sums[length > 0] / length[length > 0, None]
    return centres


def placed(df: DataFrame, unit: str, centres: np.ndarray, near: int) -> DataFrame:
    """df with `shards`: the `near` centres nearest to its unit vector, nearest first."""
    k, size = min(near, len(centres)), centres.shape[1]
    names = df.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                cosines = stacked(part.column(unit), size) @ centres.T
                best = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
                best = np.take_along_axis(best, np.argsort(-np.take_along_axis(cosines, best, axis=1), axis=1, kind="stable"), axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*names, "shards"])

    return arrow_map(df, place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", shards array<int>")


def cells_of(df: DataFrame) -> dict[int, int]:
    """How many cells each centre has, for rows that lie in each of their `shards`; at most a number for each centre."""
    return {r.shard: -(-r["n"] // CELL) for r in df.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.count("*").alias("n")).collect()}


def cell_number(cells: dict[int, int], shard: str):
    """The number of a centre's cells, as a column."""
    several = {k: v for k, v in cells.items() if v > 1}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in several.items() for x in kv])[F.col(shard)], F.lit(1)) if several else F.lit(1)


def by_cell(df: DataFrame, *within: str) -> DataFrame:
    return df.repartition("shard", "part").sortWithinPartitions("shard", "part", *within)


# --- balls ---


def gathered(units: np.ndarray, cosine: float) -> list[np.ndarray]:
    """The rows of each ball: those within half the angle of the middle of a dense spot; the others alone."""
    g = units.astype(np.float32) @ units.astype(np.float32).T
    near, half, left, out = g >= cosine, math.acos(cosine) / 2 - SLACK, np.ones(len(units), bool), []
    degree = near.sum(axis=1)
    for i in np.argsort(-degree, kind="stable"):
        if degree[i] < 2:
            break
        if left[i]:
            own = np.flatnonzero(near[i] & left)
            middle = units[own].mean(axis=0)
            core = own[angles(units[own] @ (middle / np.linalg.norm(middle))) <= half]
            if len(core) > 1 and i in core:
                out.append(core)
                left[core] = False
    return out + [np.array([i]) for i in np.flatnonzero(left)]


def balls(classes: DataFrame, centres: np.ndarray, cosine: float) -> DataFrame:
    """ball (the smallest cid of its members), middle, radius, weight, least (smallest vec_id) and the members' cids, ns
    and units."""
    size = centres.shape[1]
    types = {"ball": pa.int64(), "middle": pa.binary(), "radius": pa.float64(), "weight": pa.int64(), "least": pa.int64(), "cids": pa.list_(pa.int64()), "ns": pa.list_(pa.int64()), "units": pa.binary()}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ("shard", "part")):
            u, cid, n, rid = stacked(group["unit"], size), *(group[c].to_numpy() for c in ("cid", "n", "rid"))
            rows = []
            for own in gathered(u, cosine):
                middle = u[own].sum(axis=0)
                middle = u[own[0]] if len(own) == 1 else middle / np.linalg.norm(middle)
                radius = 0.0 if len(own) == 1 else float(angles(u[own] @ middle).max())
                rows.append((int(cid[own].min()), middle.tobytes(), radius, int(n[own].sum()), int(rid[own].min()), cid[own].tolist(), n[own].tolist(), u[own].tobytes()))
            yield batch(types, *map(list, zip(*rows, strict=True)))

    rows = written(placed(classes, "unit", centres, 1), "placed")
    dealt = F.pmod(F.xxhash64("cid"), cell_number(cells_of(rows), "shard")).cast("int")
    rows = rows.select("cid", "rid", "n", "unit", F.col("shards")[0].alias("shard")).withColumn("part", dealt)
    return arrow_map(by_cell(rows, "cid"), gather, "ball long, middle binary, radius double, weight long, least long, cids array<long>, ns array<long>, units binary")


# --- the graph ---


def pruned(units: np.ndarray, degree: int = DEGREE) -> list[np.ndarray]:
    """Each row's neighbours: its nearest rows and some drawn ones, robustly pruned, and the nearest rows that chose it."""
    n = len(units)
    rng, width = np.random.default_rng(n), min(CANDIDATES, n - 1)
    if not width:
        return [np.zeros(0, np.int64)] * n
    froms, tos, cosines = [], [], []
    for at in range(0, n, 256):
        own = np.arange(at, min(at + 256, n))
        c = units[own] @ units.T
        c[np.arange(len(own)), own] = -2
        near = np.argpartition(-c, width - 1, axis=1)[:, :width]
        near = np.concatenate([near, rng.integers(0, n, (len(own), DRAWN))], axis=1)
        cos = np.take_along_axis(c, near, axis=1)
        order = np.argsort(-cos, axis=1, kind="stable")
        near, cos = np.take_along_axis(near, order, axis=1), np.take_along_axis(cos, order, axis=1)
        between = 2 - 2 * np.matmul(units[near], units[near].transpose(0, 2, 1))
        alive, chosen, count = near != own[:, None], np.zeros(near.shape, bool), np.zeros(len(own), int)
        for j in range(near.shape[1]):
            take = alive[:, j] & (count < degree)
            chosen[:, j], count = take, count + take
            alive &= ~(take[:, None] & ((ALPHA**2 * between[:, j] <= 2 - 2 * cos) | (near == near[:, [j]])))
        who, which = np.nonzero(chosen)
        froms.append(own[who])
        tos.append(near[who, which])
        cosines.append(cos[who, which])
    a, b, cos = np.concatenate(froms), np.concatenate(tos), np.concatenate(cosines)
    order = np.lexsort((-cos, b))  # the edges into a row, nearest first
    rank = np.arange(len(b)) - np.searchsorted(b[order], b[order], side="left")
    back = order[rank < degree]
    ends = np.unique(np.stack([np.concatenate([a, b[back]]), np.concatenate([b, a[back]])]), axis=1)
    return np.split(ends[1], np.searchsorted(ends[0], np.arange(1, n)))


def adjacency(nodes: DataFrame, size: int) -> DataFrame:
    """ball, nbrs: the lists of all cells united; nodes: shard, part, ball, point."""
    types = {"ball": pa.int64(), "nbrs": pa.list_(pa.int64())}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ("shard", "part")):
            ball = group["ball"].to_numpy()
            yield batch(types, ball.tolist(), [ball[x].tolist() for x in pruned(stacked(group["point"], size, np.float32))])

    lists = arrow_map(by_cell(nodes.select("shard", "part", "ball", "point"), "ball"), build, "ball long, nbrs array<long>")
    return lists.groupBy("ball").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))


class Cell:
    """The nodes of a cell with what their lists hold of it, ready for searches."""

    def __init__(self, rows: pa.Table, size: int, angle: float):
        rows = rows.sort_by("ball")
        self.ball, self.radius, self.angle = rows["ball"].to_numpy(), rows["radius"].to_numpy(), angle
        self.points = stacked(rows["point"], size, np.float32)
        nbrs = rows["nbrs"].combine_chunks()
        flat, owner = nbrs.flatten().to_numpy(), np.repeat(np.arange(len(nbrs)), np.diff(nbrs.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(self.ball, flat), len(self.ball) - 1)
        here = self.ball[at] == flat
        owner, at = owner[here], at[here]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
        self.lists = np.full((len(self.ball), int(rank.max(initial=0)) + 1), -1)
        self.lists[owner, rank] = at
        self.medoid = int(np.argmax(self.points @ self.points.mean(axis=0)))

    def search(self, ball: np.ndarray, points: np.ndarray, radius: np.ndarray, beam: int) -> Iterator[tuple[int, int]]:
        """The pairs (smaller ball, larger ball) in range of each query."""
        n, q = len(self.ball), len(ball)
        at = np.minimum(np.searchsorted(self.ball, ball), n - 1)
        own = np.where(self.ball[at] == ball, at, -1)
        seen, todo = np.zeros((q, n), bool), {}
        ids, cos, fresh = np.full((q, beam), -1), np.full((q, beam), -2.0, np.float32), np.zeros((q, beam), bool)
        who, nodes = np.arange(q), np.stack([np.full(q, self.medoid), own], axis=1)
        while len(who):
            new = (nodes >= 0) & ~seen[who[:, None], nodes]
            seen[np.broadcast_to(who[:, None], nodes.shape)[new], nodes[new]] = True
            c = np.where(new, np.matmul(self.points[nodes], points[who][:, :, None])[:, :, 0], -2)
            hit = new & (angles(c) <= self.angle + self.radius[nodes] + radius[who][:, None] + 1e-3)
            for i, j in zip(*np.nonzero(hit), strict=True):
                node, query = int(nodes[i, j]), int(who[i])
                todo.setdefault(query, []).append(node)
                if node != own[query]:
                    a, b = int(ball[query]), int(self.ball[node])
                    yield min(a, b), max(a, b)
            all_ids, all_cos = np.concatenate([ids[who], nodes], axis=1), np.concatenate([cos[who], c], axis=1)
            all_fresh = np.concatenate([fresh[who], new], axis=1)
            best = np.argpartition(-all_cos, beam - 1, axis=1)[:, :beam]
            ids[who], cos[who], fresh[who] = (np.take_along_axis(x, best, axis=1) for x in (all_ids, all_cos, all_fresh))
            nearest = np.where(fresh, cos, -3).argmax(axis=1)
            going = fresh[np.arange(q), nearest]
            going[list(todo)] = True
            who = np.flatnonzero(going)
            expand = ids[who, nearest[who]]
            from_beam = np.ones(len(who), bool)
            for k in np.flatnonzero(np.isin(who, list(todo))):
                expand[k], from_beam[k] = todo[who[k]].pop(), False
                if not todo[who[k]]:
                    del todo[who[k]]
            fresh[who[from_beam], nearest[who[from_beam]]] = False
            nodes = self.lists[expand]


def found_pairs(nodes: DataFrame, queries: DataFrame, size: int, cosine: float, beam: int) -> DataFrame:
    """p < q: balls in range of each other, as the searches of all cells find them.

    nodes: shard, part, ball, point, radius, nbrs, each also a query of its cell; queries: shard, part, ball, point, radius."""
    types, angle = {"p": pa.int64(), "q": pa.int64()}, math.acos(cosine)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell, held = None, None, []

        def run(rows: pa.Table | pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, rows.num_rows, 512):
                part = rows.slice(at, 512)
                pairs = set(cell.search(part["ball"].to_numpy(), stacked(part["point"], size, np.float32), part["radius"].to_numpy(), beam))
                if pairs:
                    yield batch(types, *map(list, zip(*pairs, strict=True)))

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("shard", "part", "kind")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                *now, kind = keys[:, begin].tolist()
                if held and (kind or now != key):  # all nodes of the cell are there
                    table = pa.Table.from_batches(held)
                    cell, held = Cell(table, size, angle), []
                    yield from run(table)
                if now != key:
                    key, cell = now, None
                if not kind:
                    held.append(b.slice(begin, end - begin))
                elif cell is not None:
                    yield from run(b.slice(begin, end - begin))
        if held:
            table = pa.Table.from_batches(held)
            cell = Cell(table, size, angle)
            yield from run(table)

    own = nodes.select("shard", "part", F.lit(0).alias("kind"), "ball", "point", "radius", "nbrs")
    further = queries.select("shard", "part", F.lit(1).alias("kind"), "ball", "point", "radius", F.lit(None).cast("array<long>").alias("nbrs"))
    return arrow_map(by_cell(own.unionByName(further), "kind", "ball"), search, "p long, q long").distinct()


# --- verification ---


def verified(pairs: DataFrame, nodes: DataFrame, size: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """The links between balls, certain ones with the weights they add (p, q, all), and cid, more: what the members of
    other pairs add to each class."""
    angle = math.acos(cosine)
    head = nodes.select("ball", "middle", "radius", "weight")
    both = pairs.join(head.select(*[F.col(c).alias(f"{c}_p") for c in head.columns]), F.col("p") == F.col("ball_p")).join(head.select(*[F.col(c).alias(f"{c}_q") for c in head.columns]), F.col("q") == F.col("ball_q"))
    types = {"p": pa.int64(), "q": pa.int64(), "weight_p": pa.int64(), "weight_q": pa.int64(), "sure": pa.bool_()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                apart = angles((stacked(b.column("middle_p"), size) * stacked(b.column("middle_q"), size)).sum(axis=1))
                spread = b.column("radius_p").to_numpy() + b.column("radius_q").to_numpy()
                some = pa.array(apart <= angle + spread + SLACK)
                yield batch(types, *(b.column(c) for c in ("p", "q", "weight_p", "weight_q")), pa.array(apart + spread <= angle - SLACK)).filter(some)

    measured = written(arrow_map(both.select("p", "q", "middle_p", "middle_q", "radius_p", "radius_q", "weight_p", "weight_q"), measure, "p long, q long, weight_p long, weight_q long, sure boolean"), "measured")
    members = nodes.select("ball", "cids", "ns", "units")
    open_pairs = measured.where("NOT sure").select("p", "q").join(members.select(*[F.col(c).alias(f"{c}_p") for c in members.columns]), F.col("p") == F.col("ball_p")).join(members.select(*[F.col(c).alias(f"{c}_q") for c in members.columns]), F.col("q") == F.col("ball_q"))
    found = {"p": pa.int64(), "q": pa.int64(), "cids": pa.list_(pa.int64()), "more": pa.list_(pa.int64())}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x, y = (np.frombuffer(r[c]).reshape(-1, size) for c in ("units_p", "units_q"))
                hits = x @ y.T >= cosine
                if hits.any():
                    more = np.concatenate([hits @ np.array(r["ns_q"]), hits.T @ np.array(r["ns_p"])])
                    yield batch(found, [r["p"]], [r["q"]], [r["cids_p"] + r["cids_q"]], [more.tolist()])

    compared = written(arrow_map(open_pairs.select("p", "q", "cids_p", "ns_p", "units_p", "cids_q", "ns_q", "units_q"), compare, "p long, q long, cids array<long>, more array<long>"), "compared")
    links = measured.where("sure").select("p", "q", "weight_p", "weight_q").unionByName(compared.select("p", "q", F.lit(0).cast("long").alias("weight_p"), F.lit(0).cast("long").alias("weight_q")))
    return links, compared.select(F.inline(F.arrays_zip(F.col("cids").alias("cid"), F.col("more").alias("more")))).groupBy("cid").agg(F.sum("more").alias("more"))


def counted(links: DataFrame, more: DataFrame, nodes: DataFrame) -> DataFrame:
    """cid, n_links and component_id of every class."""
    sides = F.array(F.struct(F.col("p").alias("ball"), F.col("weight_q").alias("w")), F.struct(F.col("q").alias("ball"), F.col("weight_p").alias("w")))
    added = links.select(F.inline(sides)).groupBy("ball").agg(F.sum("w").alias("added"))
    known = components(links.select(F.col("p").alias("u"), F.col("q").alias("v"))).withColumnRenamed("node", "ball")
    whole = nodes.select("ball", "weight", "least").join(added, "ball", "left").join(known, "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    rows = nodes.select("ball", F.explode("cids").alias("cid")).join(whole.join(least, "component"), "ball").join(more, "cid", "left")
    return rows.select("cid", (F.col("weight") - 1 + F.coalesce("added", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")


def audit(classes: DataFrame, counts: DataFrame, size: int, cosine: float, sample: int = AUDIT) -> float:
    """The share of the links of a sample of classes, counted against all vectors, that the counts hold."""
    rows = classes.orderBy(F.xxhash64("sid", F.lit("audit"))).limit(sample).select("cid", "unit").collect()
    cids, units = [r.cid for r in rows], np.stack([np.frombuffer(r.unit) for r in rows])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cids), np.int64)
        for b in batches:
            if b.num_rows:
                total += (units @ stacked(b.column("unit"), size).T >= cosine) @ b.column("n").to_numpy()
        yield batch({"cid": pa.int64(), "there": pa.int64()}, cids, total.tolist())

    there = {r.cid: r.there - 1 for r in arrow_map(classes.select("unit", "n"), count, "cid long, there long").groupBy("cid").agg(F.sum("there").alias("there")).collect()}
    if not any(there.values()):
        return 1.0
    found = {r.cid: r.n_links for r in counts.join(F.broadcast(counts.sparkSession.createDataFrame([(c,) for c in cids], "cid long")), "cid", "left_semi").collect()}
    return sum(min(found.get(c, 0), n) for c, n in there.items()) / sum(there.values())


def narrowed(df: DataFrame) -> DataFrame:
    """df with `point`, the middle in single precision, in place of it."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("middle")
            yield b.set_column(at, "point", pa.array([np.frombuffer(x).astype(np.float32).tobytes() for x in b.column("middle").to_pylist()], pa.binary()))

    return arrow_map(df, narrow, ", ".join(f"{'point' if f.name == 'middle' else f.name} {f.dataType.simpleString()}" for f in df.schema))


def class_links(classes: DataFrame, n: int, size: int, cosine: float, probes: int, beam: int, recall: float) -> DataFrame:
    """cid, n_links and component_id of the classes (cid, rid, n, sid, unit), all vectors of one length."""
    sample = np.stack([np.frombuffer(r.unit) for r in classes.orderBy(F.xxhash64("sid")).limit(SAMPLE).select("unit").collect()])
    centres = fitted_centres(sample, max(1, min(-(-n // SHARD), MOST_CENTRES)))
    nodes = written(balls(classes.select("cid", "rid", "n", "unit"), centres, cosine), "balls")
    own = placed(nodes.select("ball", "middle", "radius"), "middle", centres, OVERLAP)
    own = written(narrowed(own), "own")
    number = cell_number(cells_of(own), "shard")
    part = F.pmod(F.xxhash64("ball"), number).cast("int")
    own = own.select("ball", "point", "radius", F.explode("shards").alias("shard")).withColumn("part", part)
    lists = written(adjacency(own, size), "lists")
    while True:
        # in its own cells a node is a query as it lies there; this adds the other cells of its nearest centres
        asked = narrowed(placed(nodes.select("ball", "middle", "radius"), "middle", centres, probes))
        asked = asked.select("ball", "point", "radius", F.posexplode("shards").alias("nth", "shard"))
        asked = asked.select("*", F.explode(F.sequence(F.lit(0), (number - 1).cast("int"))).alias("part")).where((F.col("nth") >= OVERLAP) | (F.col("part") != part))
        pairs = written(found_pairs(own.join(lists, "ball"), asked, size, cosine, beam), "found")
        links, more = verified(pairs, nodes, size, cosine)
        counts = written(counted(links, more, nodes), "counts")
        if audit(classes, counts, size, cosine) >= recall or probes >= len(centres):
            return counts
        discard(pairs, counts)
        probes, beam = 2 * probes, 2 * beam


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, probes: int = PROBES, beam: int = BEAM, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = written(digests(pick(vectors, vec_id=id_col, x=vector_col).withColumn("vec_id", F.col("vec_id").cast("long"))), "vectors")
    linked = rows.where("sid IS NOT NULL")
    grouped = linked.groupBy("size", "sid").agg(F.min("vec_id").alias("rid"), F.count("*").alias("n"), F.first("unit").alias("unit"))
    classes = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = None
    for r in classes.groupBy("size").agg(F.count("*").alias("n")).collect():
        own = class_links(classes.where(F.col("size") == r.size), r.n, r.size, cosine, probes, beam, recall)
        found = own if found is None else found.unionByName(own)
    alone = rows.where("sid IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return alone
    whole = classes.select("cid", "sid").join(found, "cid")
    return linked.select("vec_id", "sid").join(whole, "sid").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(alone)
