"""Operator 9, MinHash near-duplicates: SuperMinHash signatures, banding, verification, union-find.

Each text's set of word shingles gets a SuperMinHash signature: every element
walks a random permutation of the slots, its k-th step proposes the value
k + u, and a text stops as soon as all slots are filled, for later steps cannot
be smaller. Ranks within one element are correlated, so estimates vary less
than plain MinHash. Texts with one set form a class; only classes are banded.

A bucket's members are first compared with one hub, the member that shares most
buckets with others. What a bucket still holds in several components is
compared across components on full sets: a bucket of up to ``LARGE`` members
pair by pair; larger buckets that share components form groups, in which a
block of members meets a block of members. So every pair that shares a bucket is
in one component already, or tested. Pairs at the limit of 0.8 share a bucket
with a chance of 1 - (1 - 0.8**5)**40, all but 1.3e-7.

A class is one 128-bit set digest; it is named by 64 bits of it, and by a hash of
both halves where two digests share those. Texts without a shingle (null, empty,
no words) are linked with nothing: their component is their own doc_id. Rows that
repeat a doc_id each keep a row. In ``components`` a null doc_id joins its class
and is never the kept one. ``first_of_groups`` keeps one row of each group: the
least doc_id, else a row without one; of rows that repeat both doc_id and text
one stays. An empty table gives an empty table; other columns are ignored by
``components`` and pass through ``first_of_groups``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import in_batches, partitions_for, sieve, sifted, stored, unused

BANDS, ROWS = 40, 5
SLOTS = BANDS * ROWS
#: Members of one (hub, block) in verification, and sizes of the two sides of a block in a large bucket's group.
MEMBERS, MINOR, MAJOR = 64, 256, 512
#: Members up to which a bucket's pairs across components are listed.
LARGE = 64
#: Members of a large bucket that go to one task.
PART = 512
#: Nodes that a union-find holds before it hands on its forest, and counted edges up to which one task joins all forests.
FOREST, ONE_TASK = 100_000, 10_000
#: Bytes whose elements walk their permutations at once: they hold two bytes a slot.
CHUNK_BYTES = 1 << 18
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(2**64 - 1)


def shingle_sets(chunk: tokens.Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, row by row, and each row's run among them."""
    h, ptr = chunk.hashes(fold=True), chunk.word_ptr
    rows, n = np.diff(ptr), len(h)
    if n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(ptr), dtype=np.int64)
    acc = h.copy()
    short = np.minimum(rows, width)  # words in the row's shingles
    for k in range(1, width):
        acc[: n - k] = tokens.mix(acc[: n - k] * np.uint64(0xD6E8FEB86659FD93) + h[k:] + np.uint64(k)) if n > k else acc[: n - k]
    if width > 1 and (rows < width).any():  # a whole short sequence is one shingle; it may end before the width
        for r in np.flatnonzero((rows < width) & (rows > 0)):
            v = h[ptr[r] : ptr[r] + 1].copy()
            for k in range(1, rows[r]):
                v = tokens.mix(v * np.uint64(0xD6E8FEB86659FD93) + h[ptr[r] + k : ptr[r] + k + 1] + np.uint64(k))
            acc[ptr[r]] = v[0] ^ np.uint64(0xA5A5A5A5A5A5A5A5)
    count = np.where(rows == 0, 0, rows - short + 1)
    row = np.repeat(np.arange(len(rows)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + ptr[:-1][row]
    el = acc[at]
    key = tokens.mix(el + (row.astype(np.uint64) + np.uint64(1)) * _GOLD)
    _, first = np.unique(key, return_index=True)
    first.sort()
    el, row = el[first], row[first]
    return el, np.searchsorted(row, np.arange(len(rows) + 1))


def superminhash(el: np.ndarray, ptr: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """A row of ``slots`` values (step << 32 | u) for each run of distinct elements."""
    rows = len(ptr) - 1
    sig = np.full(rows * slots, _EMPTY, dtype=np.uint64)
    row = np.repeat(np.arange(rows), np.diff(ptr))
    left = np.diff(ptr) > 0
    swaps: list[np.ndarray] = []
    perm = None
    for step in range(slots):
        if not len(el):
            break
        x = tokens.mix(el + np.uint64((step + 1) * int(_GOLD) % 2**64))
        u = x & np.uint64(0xFFFFFFFF)
        k = step + (((x >> np.uint64(32)) * np.uint64(slots - step)) >> np.uint64(32)).astype(np.int64)
        if perm is None and step >= 8:
            perm = np.tile(np.arange(slots, dtype=np.int16), (len(el), 1))
            lines = np.arange(len(el))
            for i, s in enumerate(swaps):
                perm[lines, i], perm[lines, s] = perm[lines, s], perm[lines, i].copy()
        if perm is None:
            slot = k.copy()
            for i in range(step - 1, -1, -1):
                slot[slot == swaps[i]] = i
            swaps.append(k)
        else:
            lines = np.arange(len(el))
            slot = perm[lines, k].astype(np.int64)
            perm[lines, k] = perm[lines, step]
        place = row * slots + slot
        open_ = sig[place] == _EMPTY
        np.minimum.at(sig, place[open_], u[open_] | np.uint64(step << 32))
        left &= (sig.reshape(rows, slots) == _EMPTY).any(axis=1)
        stay = left[row]
        if not stay.all():
            el, row = el[stay], row[stay]
            swaps = [s[stay] for s in swaps] if perm is None else swaps
            perm = perm[stay] if perm is not None else None
    return sig.reshape(rows, slots)


def signatures(column: pa.Array, width: int) -> dict[str, np.ndarray]:
    out: dict[str, list] = {"n": [], "node": [], "node2": [], "bands": []}
    salt = tokens.mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD)
    for chunk in tokens.chunks(column, CHUNK_BYTES):
        el, ptr = shingle_sets(chunk, width)
        sig = superminhash(el, ptr)
        bands = np.broadcast_to(salt, (len(sig), BANDS)).copy()
        per = sig.reshape(len(sig), BANDS, ROWS)
        for r in range(ROWS):
            bands = tokens.mix(bands * np.uint64(0xD6E8FEB86659FD93) + per[:, :, r])
        out["n"].append(np.diff(ptr))
        out["node"].append(tokens.sums(tokens.mix(el ^ np.uint64(0x243F6A8885A308D3)), ptr).view(np.int64))
        out["node2"].append(tokens.sums(tokens.mix(el ^ np.uint64(0x13198A2E03707344)), ptr).view(np.int64))
        out["bands"].append(bands.view(np.int64))
    return {k: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for k, v in out.items()}


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                got = signatures(batch.column(batch.schema.get_field_index("text")), width)
                n = batch.num_rows
                bands = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * BANDS).astype(np.int32)), pa.array(got["bands"].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.schema.get_field_index("row_key")), pa.array(got["n"].astype(np.int64)), pa.array(got["node"]), pa.array(got["node2"]), bands], names=["doc_id", "row_key", "n_shingles", "node", "node2", "bands"])

    return run


def _verified(width: int):
    """Streams rows sorted by (hub, block), the hub's text first; yields (node, hub) of members similar to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            group = list(zip(batch.column("hub").to_pylist(), batch.column("block").to_pylist(), strict=True))
            node, is_hub = batch.column("node").to_pylist(), batch.column("is_hub").to_pylist()
            found: list[tuple[int, int]] = []
            for chunk in tokens.chunks(batch.column("text")):
                el, ptr = shingle_sets(chunk, width)
                for r in range(chunk.first, chunk.last):
                    mine = el[ptr[r - chunk.first] : ptr[r - chunk.first + 1]]
                    if is_hub[r]:
                        at, hub = group[r], np.sort(mine)
                    elif group[r] == at and len(mine) and len(hub):
                        place = np.searchsorted(hub, mine)
                        place[place == len(hub)] = 0
                        both = int((hub[place] == mine).sum())
                        if 100 * both >= 80 * (len(mine) + len(hub) - both):
                            found.append((node[r], group[r][0]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["u", "v"])

    return run


def _links(minor: list[tuple], major: list[tuple]) -> tuple[list[int], list[int]]:
    """Pairs of other components with full sets at the limit or above; rows are (node, comp, set).

    Intersections are products of 0/1 rows over the elements that both sides hold.
    """
    us, vs = [], []
    mine = np.concatenate([x[2] for x in minor])
    held = np.unique(mine)
    theirs = np.concatenate([x[2] for x in major])
    place = np.searchsorted(held, theirs)
    place[place == len(held)] = 0
    hit = held[place] == theirs
    columns, column = np.unique(place[hit], return_inverse=True)
    left = np.zeros((len(minor), len(columns)), dtype=np.float32)
    right = np.zeros((len(major), len(columns)), dtype=np.float32)
    sizes = [np.array([len(x[2]) for x in side]) for side in (minor, major)]
    right[np.repeat(np.arange(len(major)), sizes[1])[hit], column] = 1
    at = np.searchsorted(columns, np.searchsorted(held, mine))
    at[at == len(columns)] = 0
    if len(columns):
        there = columns[at] == np.searchsorted(held, mine)
        left[np.repeat(np.arange(len(minor)), sizes[0])[there], at[there]] = 1
    both = np.rint(left @ right.T).astype(np.int64)
    comps = [np.array([x[1] for x in side], dtype=np.int64) for side in (minor, major)]
    x, y = np.nonzero((100 * both >= 80 * (sizes[0][:, None] + sizes[1][None, :] - both)) & (comps[0][:, None] != comps[1][None, :]))
    # one link from a node to a component is enough
    _, first = np.unique(np.stack([x, comps[1][y]], axis=1), axis=0, return_index=True)
    for i in first:
        us.append(minor[x[i]][0])
        vs.append(major[y[i]][0])
    return us, vs


def _split(rows: list[tuple], most: int = 50_000) -> Iterator[list[tuple]]:
    """Runs of ``rows`` whose sets hold about ``most`` elements, 64 rows at the most: they bound the products' size."""
    part, n = [], 0
    for r in rows:
        if part and (n + len(r[2]) > most or len(part) == 64):
            yield part
            part, n = [], 0
        part.append(r)
        n += len(r[2])
    if part:
        yield part


def _crossed(width: int):
    """Streams rows sorted by (group, i, j, side), the minor side first; yields links across components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, minor = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("group", "i", "j")), strict=True))
            side, node, comp = (batch.column(c).to_pylist() for c in ("side", "node", "comp"))
            us: list[int] = []
            vs: list[int] = []
            major: list[tuple] = []

            def test(major=major, us=us, vs=vs) -> None:
                for a in _split(minor):
                    for b in _split(major):
                        u, v = _links(a, b)
                        us += u
                        vs += v
                major.clear()

            for chunk in tokens.chunks(batch.column("text")):
                el, ptr = shingle_sets(chunk, width)
                for r in range(chunk.first, chunk.last):
                    if keys[r] != key:
                        test()
                        key, minor[:] = keys[r], []
                    mine = el[ptr[r - chunk.first] : ptr[r - chunk.first + 1]].copy()
                    if len(mine):
                        (major if side[r] else minor).append((node[r], comp[r], mine))
            test()
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's edges, ``FOREST`` nodes at a time: at most one edge a node remains."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    def edges() -> pa.RecordBatch:
        nodes = [x for x in parent if find(x) != x]
        out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])
        parent.clear()
        return out

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= FOREST:
            yield edges()
    yield edges()


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp): for each node of ``edges`` (u, v) the smallest node it reaches.

    Union-find within partitions; what remains, if it is counted to be small, is
    joined by one task, and else goes through alternating star contractions,
    each round written to the shared folder. Rounds grow with the logarithm of
    the component size, and nothing but a checksum reaches the driver.
    """
    now = stored(in_batches(edges.select("u", "v"), _forest, "u bigint, v bigint"), name)
    if now.count() <= ONE_TASK:
        return stored(in_batches(now.coalesce(1), _labels, "node bigint, comp bigint"), name)
    return _contracted(now, name)


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) of all nodes of a few edges that one partition holds."""
    edges = [e for b in batches for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    (forest,) = _forest(iter([pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["u", "v"])]))
    comp = dict(zip(forest.column(0).to_pylist(), forest.column(1).to_pylist(), strict=True))
    comp |= {c: c for c in comp.values()}
    yield pa.RecordBatch.from_arrays([pa.array(list(comp), pa.int64()), pa.array(list(comp.values()), pa.int64())], names=["node", "comp"])


def _contracted(now: DataFrame, name: str) -> DataFrame:
    """Star contractions until nothing changes."""
    before = None
    while True:
        # large star: neighbours above the node go to its smallest neighbour
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below the node, and the node, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e")).select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct()
        now = stored(small, name)
        check = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
        if check == before:
            break
        before = check
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _texts_of(nodes: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(row_key, text) of the rows that stand for ``nodes`` and a few others: the texts of all others stay where they are."""
    keys = stored(reps.select("node", "row_key").join(nodes.select("node"), "node", "left_semi").select("row_key"), "wanted-rows")
    return sifted(docs.select("row_key", "text"), "row_key", sieve(keys, "row_key"))


def _ends(pairs: DataFrame, u: str, v: str) -> DataFrame:
    """(node) of all ends of ``pairs``."""
    return pairs.select(F.explode(F.array(u, v)).alias("node")).distinct()


def _similar(pairs: DataFrame, nodes: DataFrame, reps: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Of ``pairs`` (u, hub), whose ends are ``nodes``, those whose full sets have a similarity of 0.8 or more, as (u, v)."""
    placed = pairs.select(F.col("u").alias("node"), "hub", F.lit(False).alias("is_hub"))
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    placed = placed.join(blocks, "hub").select("node", "hub", F.pmod(F.xxhash64("node", "hub"), F.col("blocks")).cast("int").alias("block"), "is_hub")
    hubs = blocks.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_hub"))
    roles = placed.unionByName(hubs).join(reps.select("node", "row_key"), "node")
    with_text = _texts_of(nodes, reps, docs).join(roles, "row_key")
    n = partitions_for(docs.sparkSession)
    dealt = with_text.select("hub", "block", "is_hub", "node", "text").repartition(n, "hub", "block")
    return in_batches(dealt.sortWithinPartitions("hub", "block", F.desc("is_hub")), _verified(width), "u bigint, v bigint")


def _classes(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, n_shingles, node) of each row, and (node, comp) of the classes that are linked with others."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row_key", row_key())
    signed = stored(in_batches(keyed, _signed(width), "doc_id bigint, row_key bigint, n_shingles bigint, node bigint, node2 bigint, bands array<bigint>"), "signatures")
    # digests that share a name: none is expected, and each then gets a name of its own
    halves = signed.where("n_shingles > 0").groupBy("node").agg(F.min("node2").alias("low"), F.max("node2").alias("high"))
    clashes = stored(halves.where("low <> high").select(F.col("node").alias("clash")), "digest-clashes")
    signed = signed.join(clashes, F.col("node") == F.col("clash"), "left")
    signed = signed.withColumn("node", F.when(F.col("clash").isNotNull(), F.xxhash64("node", "node2")).otherwise(F.col("node"))).drop("clash", "node2")
    # one row stands for its class; its text is found again by row_key
    picked = signed.where("n_shingles > 0").groupBy("node").agg(F.min("row_key").alias("row_key"))
    reps = stored(signed.drop("node").join(picked, "row_key").dropDuplicates(["node"]).select("node", "row_key", "bands"), "classes")
    return signed.drop("bands"), _linked(signed, reps, keyed, width)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))


def components(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text), linked at a similarity of 0.8 or more."""
    signed, whole = _classes(docs, width)
    least = signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least.join(whole, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
    label = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of = stored(named.join(label, "comp").select("node", "component_id"), "labels")
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(of, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _with_bucket(members: DataFrame, of: DataFrame) -> DataFrame:
    """``members`` of buckets joined with a row for each bucket; both have the bucket's size, by which a large one is dealt in parts."""
    parts = F.floor(F.col("size") / PART)
    dealt = members.withColumn("part", F.pmod(F.xxhash64("node"), parts + 1))
    return dealt.join(of.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts))), ["band", "bucket", "size", "part"]).drop("part")


def _linked(signed: DataFrame, reps: DataFrame, keyed: DataFrame, width: int) -> DataFrame:
    """(node, comp) of the classes that are linked with others."""
    banded = reps.select("node", F.posexplode("bands").alias("band", "bucket"))
    buckets = banded.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(banded.join(buckets, ["band", "bucket"]), "buckets")
    reach = shared.groupBy("node").agg(F.sum("size").alias("reach"))
    ranked = shared.join(reach, "node").select("band", "bucket", "size", F.struct("reach", "node").alias("rank"))
    hubs = ranked.groupBy("band", "bucket", "size").agg(F.max("rank").alias("rank")).select("band", "bucket", "size", F.col("rank.node").alias("hub"))
    starred = _with_bucket(shared, hubs).where("node <> hub")
    first = stored(starred.select(F.col("node").alias("u"), "hub").distinct(), "hub-pairs")
    edges = stored(_similar(first, _ends(first, "u", "hub"), reps, keyed, width), "hub-links")
    comp = stored(connected(edges), "hub-components")

    # what one bucket still holds in several components is compared across them
    members = stored(shared.join(comp, "node", "left").select("band", "bucket", "size", "node", F.coalesce("comp", "node").alias("comp")), "bucket-members")
    mixed = members.groupBy("band", "bucket", "size").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band", "bucket", "size")
    mixed = stored(_with_bucket(members, mixed), "mixed-buckets")

    # large buckets: what they join is one group, all pairs of which are tested, a block against a block
    large = mixed.where(F.col("size") > LARGE)
    hub_of = large.groupBy("band", "bucket", "size").agg(F.min("comp").alias("hub"))
    across = _with_bucket(large, hub_of).where("comp <> hub").select(F.col("comp").alias("u"), F.col("hub").alias("v")).distinct()
    joined = stored(connected(across).select(F.col("node").alias("comp"), F.col("comp").alias("group")), "groups")
    grouped = stored(large.select("node", "comp").distinct().join(joined, "comp"), "group-members")
    parts = grouped.groupBy("group", "comp").agg(F.count("*").alias("c"))
    plan = parts.groupBy("group").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("total")).select("group", F.col("main.comp").alias("main"), F.ceil((F.col("total") - F.col("main.c")) / MINOR).cast("int").alias("is"), F.ceil(F.col("total") / MAJOR).cast("int").alias("js"))
    rows = grouped.join(plan, "group")
    minor = rows.where("comp <> main").select("group", "node", "comp", F.pmod(F.xxhash64("node"), F.col("is")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("js") - 1)).alias("j"), F.lit(0).alias("side"))
    major = rows.select("group", "node", "comp", F.explode(F.sequence(F.lit(0), F.col("is") - 1)).alias("i"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("js")).cast("int").alias("j"), F.lit(1).alias("side"))
    n = partitions_for(keyed.sparkSession)
    placed = minor.unionByName(major).join(reps.select("node", "row_key"), "node")
    dealt = _texts_of(grouped, reps, keyed).join(placed, "row_key").select("group", "i", "j", "side", "node", "comp", "text").repartition(n, "group", "i", "j")
    far = in_batches(dealt.sortWithinPartitions("group", "i", "j", "side"), _crossed(width), "u bigint, v bigint")

    # small buckets: their pairs, but for those tested above or before
    of = grouped.select("node", "group")
    small = mixed.where(F.col("size") <= LARGE).join(of, "node", "left").select("band", "bucket", "node", "comp", F.coalesce("group", "node").alias("group"))
    a, b = small.alias("a"), small.alias("b")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.comp") != F.col("b.comp")) & (F.col("a.group") != F.col("b.group")))
    seen = pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    tested = stored(seen.join(first.select(F.least("u", "hub").alias("u"), F.greatest("u", "hub").alias("v")), ["u", "v"], "left_anti"), "small-pairs")
    # the end that is in more pairs serves as the hub, so that its text moves once a block
    degree = tested.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    sided = tested.join(degree.select(F.col("node").alias("u"), F.col("d").alias("du")), "u").join(degree.select(F.col("node").alias("v"), F.col("d").alias("dv")), "v")
    swap = F.col("du") > F.col("dv")
    rest = _similar(sided.select(F.when(swap, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("hub")), _ends(tested, "u", "v"), reps, keyed, width)
    return stored(connected(comp.where("node <> comp").select(F.col("node").alias("u"), F.col("comp").alias("v")).unionByName(rest).unionByName(far)), "components")


def first_of_groups(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row of each group of ``docs``, and all rows without a shingle; all columns stay as they are."""
    signed, whole = _classes(docs, width)
    rows = signed.groupBy("row_key", "node", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    linked = rows.where("n_shingles > 0").join(whole, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = linked.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key", "n")).alias("first")).select("first.row_key", "first.n")
    kept = stored(first.unionByName(rows.where("n_shingles = 0").select("row_key", F.lit(1).cast("long").alias("n"))), "kept-rows")
    key = unused(docs.columns, "row_key")
    named = docs.withColumn(key, row_key())
    of = lambda which: kept.where(which).select(F.col("row_key").alias(key))
    # rows that go, or repeat doc_id and text, alone move to be told apart; all others stay where they are
    moving = sieve(stored(signed.select("row_key").join(kept.where("n = 1"), "row_key", "left_anti").distinct(), "moving-rows"), "row_key")
    maybe = sifted(named, key, moving)
    once = maybe.join(of("n = 1"), key, "left_semi")
    again = maybe.join(of("n > 1"), key, "left_semi").dropDuplicates([key])
    return sifted(named, key, moving, out=True).unionByName(once).unionByName(again).select(*(F.col(f"`{c}`") for c in docs.columns))
