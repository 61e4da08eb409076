"""Near-duplicate groups by MinHash bands, verified by odd sketches and by full shingle sets.

A document's set is its distinct five-word shingles (64-bit hashes). Documents of equal sets are one
class from the start. Each class's MinHash samples give band keys; classes that share a key are
candidates. The samples are also folded into an odd sketch, a bitmap in which each sample flips one
bit: the count of ones of two sketches' XOR estimates their similarity precisely where it is high,
so pairs far below the threshold are dropped before any set is read. The remaining pairs are
confirmed on their full sets, and links are joined to components.

No step forms all pairs of a group as rows. First each bucket's members are held against its
smallest one: two pairs a member at most, filtered by sketches, then confirmed on full sets, with the
smallest ones' sets copied for every ``HUB`` pairs. What these links join is one component. Buckets
of one component are done, however large. In the others only pairs across components can still join
anything: members outside a bucket's largest component are held against all of it by their
sketches, in the tasks, and only each one's nearest partner and a forest leave them; the nearest
partners are confirmed likewise. Where nothing more is found so, all members that still have a promising partner
in another component are compared by their full sets, the outside ones against all, in blocks, so
that no link between different components is left out.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.llm import shared
from citeforge.llm.components import connected_components
from citeforge.llm.textvec import Flat, column, flat_slices

WIDTH = 5
SIMILAR = 75  # percent
BANDS, ROWS = 32, 4  # at similarity 0.75 a pair shares no band with probability 5e-6
SAMPLES = BANDS * ROWS
LONGS = 8  # 512 bits of odd sketch
#: Pairs whose estimate is lower are dropped; at a true similarity of 0.75 this is 5 deviations off.
LEAST_ESTIMATE = 0.5
BUCKET_BLOCK = 512  # members of a bucket that are compared by sketches in one task
BRANCHES = 16  # that a member of a forest gets before others have theirs
BLOCK = 256  # classes of a cluster that are compared by full sets in one task
WIDE_ROWS = 1 << 12  # rows with sets or sketches that one task writes where their number is known
HUB = 128  # pairs with one and the same set that are confirmed in one task
FRUITFUL = 10  # nearest partners are confirmed once more while one in so many of them is linked

_SEEDS = np.random.default_rng(20240229)
_MUL = _SEEDS.integers(1 << 31, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_ADD = _SEEDS.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_SLOT = _SEEDS.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(flat: Flat, width: int = WIDTH) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, sorted. Fewer words than ``width`` are one shingle."""
    import xxhash

    words = flat.lower().words()
    codes, distinct = words.encode()
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for w in distinct.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.uint64, len(distinct))
    h = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    n = len(h)
    chain = h.copy()
    for k in range(1, width):
        chain[: n - k] = _mix(chain[: n - k] * _C1 + h[k:]) if n > k else chain[: n - k]
    out = []
    for i in range(flat.n):
        a, b = int(words.at[i]), int(words.at[i + 1])
        if b - a >= width:
            out.append(np.unique(chain[a : b - width + 1]))
        elif b > a:
            x = h[a : a + 1].copy()
            for k in range(a + 1, b):
                x = _mix(x * _C1 + h[k : k + 1])
            out.append(_mix(x + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def samples_of(s: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that is not empty."""
    high = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, np.uint32(0xFFFFFFFF))
    for a in range(0, len(high), 512):
        np.minimum(least, (high[a : a + 512, None] * _MUL + _ADD).min(0), out=least)
    return least


def bands_of(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; rows of ``samples`` are documents."""
    x = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), x.shape[:2])
    for k in range(ROWS):
        key = _mix(key * _C1 + x[:, :, k])
    return key.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps: sample i of value v flips bit hash(i, v); ``LONGS`` 64-bit words a row."""
    bit = (_mix(samples.astype(np.uint64) * _C1 + _SLOT) % np.uint64(64 * LONGS)).astype(np.int64)
    flips = np.zeros((len(samples), 64 * LONGS), np.uint8)
    np.add.at(flips, (np.arange(len(samples))[:, None], bit), 1)
    return np.packbits(flips & 1, axis=1).view(np.int64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist())


SKETCH = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>, " + ", ".join(f"o{k} long" for k in range(LONGS))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = column(batch, "doc_id")
        for a, b, flat in flat_slices(column(batch, "text")):
            sets = shingle_sets(flat)
            samples = np.stack([samples_of(s) if len(s) else np.zeros(SAMPLES, np.uint32) for s in sets])
            ids = np.array([_digest(s) for s in sets], np.int64)
            offs = np.arange(len(sets) + 1, dtype=np.int32) * BANDS
            odd = odd_sketches(samples)
            arrays = [keys.slice(a, b - a), column(batch, "text_key").slice(a, b - a), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(ids[:, 0]), pa.array(ids[:, 1])]
            arrays.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(bands_of(samples).reshape(-1))))
            arrays += [pa.array(np.ascontiguousarray(odd[:, k])) for k in range(LONGS)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands", *(f"o{k}" for k in range(LONGS))])


ODD = [f"o{k}" for k in range(LONGS)]
#: Ones of two sketches' XOR up to which the estimate reaches ``LEAST_ESTIMATE``.
MOST_ONES = int(64 * LONGS * (1 - np.exp((LEAST_ESTIMATE - 1) * 4 * SAMPLES / (64 * LONGS))) / 2)
SETS = "node long, set_a long, set_b long, members array<long>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = column(batch, "doc_id")
        for a, b, flat in flat_slices(column(batch, "text"), 1 << 20):
            sets = shingle_sets(flat)
            ids = np.array([_digest(s) for s in sets], np.int64)
            offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            members = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(ids[:, 0]), pa.array(ids[:, 1]), members], names=["node", "set_a", "set_b", "members"])


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows of equal keys from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([column(batch, k).to_numpy() for k in keys])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            now = tuple(key[:, a])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _ones(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ones of the XOR of each row of ``x`` with each of ``y``."""
    out = np.zeros((len(x), len(y)), np.uint16)
    for k in range(LONGS):
        out += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return out


def _odd(table: pa.Table) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in ODD], axis=1).view(np.uint64)


def _across(table: pa.Table) -> np.ndarray:
    """Whether a pair of the group's rows belongs to this group: different components, and across
    its blocks, if it has two."""
    part, block, i, j = table["component"].to_numpy(), table["block"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
    apart = part[:, None] != part[None, :]
    return apart & (block[:, None] != block[None, :]) if i != j else apart


PAIRS = "a long, b long, ones int"


def _pairs_batch(pairs: list[tuple[int, int, int]]) -> pa.RecordBatch:
    a, b = ([pick(p[:2]) for p in pairs] for pick in (min, max))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([p[2] for p in pairs], pa.int32())], names=["a", "b", "ones"])


class Roots:
    """Union-find by numbers."""

    def __init__(self):
        self.top: dict[int, int] = {}

    def of(self, x: int) -> int:
        while (up := self.top.get(x, x)) != x:
            self.top[x] = up = self.top.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.of(x), self.of(y)
        self.top[max(x, y)] = min(x, y)
        return x != y


def _forest(near: np.ndarray, ones: np.ndarray) -> set[tuple[int, int]]:
    """Each row's nearest pair, and as many more as connect all that promising pairs connect."""
    left, roots, out = near.any(1), Roots(), set()
    for u in np.flatnonzero(left).tolist():
        v = int(np.where(near[u], ones[u], 64 * LONGS).argmin())
        roots.join(u, v)
        out.add((min(u, v), max(u, v)))
    while left.any():
        start = int(np.flatnonzero(left)[0])
        left[start] = False
        queue = deque([start])
        while queue:  # few branches at a time, so that no member becomes the hub of a large group
            u = queue.pop()
            fresh = np.flatnonzero(near[u] & left)
            if len(fresh) > BRANCHES:
                queue.appendleft(u)
                fresh = fresh[:BRANCHES]
            left[fresh] = False
            queue.extend(fresh.tolist())
            out |= {(min(u, v), max(u, v)) for v in fresh.tolist() if roots.join(u, v)}
    return out


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bucket's promising pairs across components: each member's nearest one, and a forest."""
    out: list[tuple[int, int, int]] = []
    for table in groups(batches, ["bucket", "i", "j"]):
        node, odd = table["node"].to_numpy(), _odd(table)
        ones = _ones(odd, odd)
        near = (ones <= MOST_ONES) & _across(table)
        out += [(int(node[u]), int(node[v]), int(ones[u, v])) for u, v in sorted(_forest(near, ones))]
        if len(out) > 20_000:
            yield _pairs_batch(out)
            out = []
    yield _pairs_batch(out)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group that join different components, by full sets, the nearest pairs first."""
    out: list[tuple[int, int, int]] = []
    for table in groups(batches, ["cluster", "i", "j"]):
        node, odd, part = table["node"].to_numpy(), _odd(table), table["component"].to_numpy()
        ones = _ones(odd, odd)
        fit = (ones <= MOST_ONES) & _across(table)
        a, b = np.nonzero(np.triu(fit, 1))
        order = np.argsort(ones[a, b], kind="stable")
        members = table["members"].combine_chunks()
        at, values = members.offsets.to_numpy(), members.values.to_numpy().view(np.uint64)
        roots = Roots()
        for u, v in zip(a[order].tolist(), b[order].tolist(), strict=True):
            if roots.of(int(part[u])) == roots.of(int(part[v])):
                continue
            s, t = values[at[u] : at[u + 1]], values[at[v] : at[v + 1]]
            if 100 * min(len(s), len(t)) < SIMILAR * max(len(s), len(t)):
                continue
            both = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * both >= SIMILAR * (len(s) + len(t) - both):
                roots.join(int(part[u]), int(part[v]))
                out.append((int(node[u]), int(node[v]), int(ones[u, v])))
        if len(out) > 20_000:
            yield _pairs_batch(out)
            out = []
    yield _pairs_batch(out)


def similarity_estimate(difference):
    """Jaccard similarity from the ones of two sketches' XOR."""
    n = 64.0 * LONGS
    share = F.least(difference.cast("double") / n, F.lit(0.4999))
    return 1 + n / (4.0 * SAMPLES) * F.log(1 - 2 * share)


def _dealt(rows: DataFrame, key: str, block: int, kept: list[str]) -> DataFrame:
    """Rows (key, node, component, n and ``kept``) of a written table, dealt to groups (key, i, j) of two blocks at most,
    so that every two rows of different components meet; ``n`` is the number of the key's rows.

    Keys of up to ``block`` rows are one group. In larger ones, rows outside the largest component
    are dealt to blocks 0 to k - 1 and the others to blocks k on, and a group is a pair of blocks of
    which the first is an outside one; rows of the largest component are copied only k times.
    """
    columns = [key, "i", "j", "block", "node", "component", *kept]
    zero = F.lit(0).cast("long")
    whole = rows.where(F.col("n") <= block).withColumns({"i": zero, "j": zero, "block": zero}).select(columns)
    large = rows.where(F.col("n") > block)
    if large.isEmpty():
        return whole
    parts = large.groupBy(key, "component").agg(F.count("*").alias("rows"))
    main = parts.groupBy(key).agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.max("rows").alias("inside"), F.sum("rows").alias("all"))
    blocks = main.select(key, "main", F.ceil((F.col("all") - F.col("inside")) / block).alias("k"), F.ceil(F.col("inside") / block).alias("m"))
    large = large.join(shared.small(shared.materialize(blocks.where("k > 0"), "blocks", rows.count() // block)), key)
    h, outside = F.xxhash64("node"), F.col("component") != F.col("main")
    own = F.when(outside, F.pmod(h, F.col("k"))).otherwise(F.col("k") + F.pmod(h, F.col("m")))
    last = F.when(outside, F.col("k") + F.col("m") - 1).otherwise(F.col("k") - 1)
    large = large.withColumn("block", own).withColumn("other", F.explode(F.sequence(zero, last)))
    large = large.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    return whole.unionByName(large.select(columns))


def _compared(rows: DataFrame, key: str, compare) -> DataFrame:
    groups_ = rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "node")
    return groups_.mapInArrow(compare, PAIRS).groupBy("a", "b").agg(F.min("ones").alias("ones"))


def _beside(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b, salt) with ``columns`` of both nodes, as a_... and b_...

    Many pairs may share one b: its row is copied for each of its salts, and no task gets more
    pairs of it than have one salt.
    """
    side = lambda c: table.select(F.col("node").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in columns])
    hubs = pairs.select("b", "salt").distinct().join(side("b"), "b")
    return pairs.join(side("a"), "a").join(hubs, ["b", "salt"])


def _near_by_sketch(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sketches promise a similarity at the threshold."""
    met = _beside(pairs, classes, ODD)
    ones = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in ODD), F.lit(0))
    return met.where(ones <= MOST_ONES).select("a", "b", "salt")


def _sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, members) of some nodes, a written table: their texts are read again, those alone."""
    n = nodes.count()
    ids = shared.materialize(classes.select("node", "set_a", "set_b").join(shared.small(nodes), "node", "left_semi"), "candidates", n)
    fits = F.broadcast if shared.is_small(ids) else (lambda side: side)
    texts = docs.join(fits(ids.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi").select("doc_id", "text")
    # An id may have several texts; each of its sets is a row.
    sets = texts.mapInArrow(_sets, SETS).join(fits(ids), ["node", "set_a", "set_b"], "left_semi")
    sets = sets.groupBy("node", "set_a", "set_b").agg(F.first("members").alias("members")).drop("set_a", "set_b")
    return shared.materialize(sets, "sets", n, WIDE_ROWS)


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of written pairs."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return shared.materialize(ends, "ends", 2 * pairs.count())


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The written pairs (a, b, salt) that reach the threshold on their full sets."""
    met = _beside(pairs, sets, ["members"])
    both = F.size(F.array_intersect("a_members", "b_members"))
    either = F.size("a_members") + F.size("b_members") - both
    return shared.materialize(met.where(100 * both >= SIMILAR * either).select("a", "b").distinct(), "links", pairs.count(), WIDE_ROWS)


def _open(members: DataFrame, components: DataFrame | None, classes: DataFrame) -> DataFrame:
    """Members (node, bucket, n, component) of buckets that hold two components or more, with their
    sketches."""
    n = members.count()
    if components is not None:
        members = members.join(shared.small(components), "node", "left")
        members = members.withColumn("component", F.coalesce("component", "node"))
        members = shared.materialize(members, "placed", n)
    else:
        members = members.withColumn("component", F.col("node"))
    mixed = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    members = shared.materialize(members.join(mixed.select("bucket"), "bucket", "left_semi"), "mixed", n)
    return shared.materialize(members.join(classes.select("node", *ODD), "node"), "open", members.count(), WIDE_ROWS)


def _promised(members: DataFrame, components: DataFrame | None, classes: DataFrame) -> DataFrame:
    """Promising pairs across components in the same bucket; every node that has one is in a pair."""
    rows = _open(members, components, classes)
    return shared.materialize(_compared(_dealt(rows, "bucket", BUCKET_BLOCK, ODD), "bucket", _promising), "promising", 2 * rows.count())


def _nearest(pairs: DataFrame) -> DataFrame:
    """Each node's most promising pair: at most as many pairs as nodes, no node with many of them."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.struct("ones", "a", "b").alias("pair"))
    best = ends.groupBy("node").agg(F.min("pair").alias("pair")).select("pair.a", "pair.b").distinct()
    return best.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(HUB)))


def _joined(components: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Components of the links and of what was joined before; None where there is neither."""
    if links.isEmpty():
        return components
    before = [components.select(F.col("node").alias("a"), F.col("component").alias("b"))] if components is not None else []
    rows = links.count() + (components.count() if before else 0)
    return connected_components(links.select("a", "b").union(before[0]) if before else links, rows)


def link_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of the classes, a written table, that are linked with another one."""
    n = classes.count()
    keys = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    members = shared.materialize(keys.join(buckets, "bucket"), "members", BANDS * n)
    # Of the smallest members of its buckets, a node is held against the smallest one and against
    # that of its largest bucket.
    first, large = F.min("least").alias("first"), F.max_by("least", F.struct("n", -F.col("least"))).alias("large")
    stars = members.groupBy("node").agg(first, large, F.max("n").alias("n"))
    stars = stars.select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array("first", "large"))).alias("b"), "n").where("a <> b")
    stars = stars.select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / HUB)).alias("salt"))
    near = shared.materialize(_near_by_sketch(stars, classes), "stars", 2 * n)
    members = members.select("node", "bucket", "n")
    components = _joined(None, _confirmed(near, _sets_of(_ends(near), classes, docs)))
    while True:
        pairs = _promised(members, components, classes)
        nearest = shared.materialize(_nearest(pairs), "nearest", pairs.count())
        # Every node of a promising pair has a nearest one, so these are the sets of all of them.
        nodes = _ends(nearest)
        sets = _sets_of(nodes, classes, docs)
        links = _confirmed(nearest, sets)
        components = _joined(components, links)
        if FRUITFUL * links.count() <= nearest.count():
            break
    if not pairs.isEmpty():
        components = _joined(components, _last_links(pairs, components, classes, nodes, sets))
    if components is None:
        return classes.select("node", F.col("node").alias("component")).limit(0)
    return components


def _last_links(pairs: DataFrame, components: DataFrame | None, classes: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that join different components, by full sets of all nodes with a promising partner.

    Promising pairs put components into clusters outside which no link can lie. The pairs may be of
    an earlier round, before some components became one. ``nodes`` are all that are in pairs, and
    ``sets`` theirs.
    """
    n = nodes.count()
    part = nodes.withColumn("component", F.col("node"))
    if components is not None:
        part = nodes.join(shared.small(components), "node", "left").withColumn("component", F.coalesce("component", "node"))
    part = shared.materialize(part, "parts", n)
    fits = F.broadcast if shared.is_small(part) else (lambda side: side)
    of = lambda c: fits(part.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part")))
    edges = pairs.join(of("a"), "a").join(of("b"), "b").select(F.col("a_part").alias("a"), F.col("b_part").alias("b"))
    clusters = connected_components(edges, pairs.count()).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    placed = shared.materialize(part.join(shared.small(clusters), "component"), "clusters", n)
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("n"))
    placed = shared.materialize(placed.join(sizes, "cluster"), "clusters", n)
    odd = classes.select("node", *ODD).join(shared.small(nodes), "node", "left_semi")
    rows = shared.materialize(sets.join(shared.small(placed), "node").join(odd, "node"), "rows", n, WIDE_ROWS)
    return shared.materialize(_compared(_dealt(rows, "cluster", BLOCK, ["members", *ODD]), "cluster", _exact), "links", rows.count())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (the text's hash), n_shingles, component_id and kept for each row of ``docs``.

    Texts without a word, and null texts, have an empty set and are linked with nothing. Rows
    without an id are linked with nothing either; their component is null and they are kept. Rows
    of equal id are one document when their sets are equal, else each is linked by its own set; the
    smallest id of a component is kept, in every row that has it. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    sketches = shared.materialize(rows.mapInArrow(_sketch, SKETCH), "sketches")
    usable = sketches.where("n_shingles > 0 and doc_id is not null")
    kept = [F.first(c).alias(c) for c in ("bands", *(f"o{k}" for k in range(LONGS)))]
    classes = usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), *kept)
    classes = shared.materialize(classes, "classes", sketches.count(), WIDE_ROWS)
    found = link_classes(rows, classes)
    known = classes.select("set_a", "set_b", "node", "copies").join(shared.small(found), "node", "left").where("copies > 1 or component is not null")
    known = shared.materialize(known.select("set_a", "set_b", F.coalesce("component", "node").alias("component")), "known", classes.count())
    out = sketches.join(shared.small(known), ["set_a", "set_b"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are; of repeated rows one stays.

    Rows without an id, and texts without a word, stay. Columns of any names may be there.
    """
    found = shared.materialize(near_duplicates(docs), "near-duplicates")
    id_, text_key = F.col("doc_id").cast("long"), F.xxhash64("text")
    rows = docs.select(F.struct("*").alias("row"), id_.alias("id"), text_key.alias("key"))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    kept = rows.join(shared.small(shared.materialize(gone, "gone")), ["id", "key"], "left_anti")
    again = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_distinct("text_key").alias("texts")).where("rows > texts")
    again = shared.materialize(again.select(F.col("doc_id").alias("id")), "again")
    if not again.isEmpty():
        again = shared.small(again)
        once = kept.join(again, "id", "left_anti")
        kept = once.unionByName(kept.join(again, "id", "left_semi").dropDuplicates(["id", "key"]))
    return kept.select("row.*")


def op7_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
