"""Near-duplicate documents by b-bit MinHash.

1. Equal shingle sets fall into one class, a node, by their hash; one text of each goes on.
2. Bands of MinHash values make buckets.  In each bucket the node that shares most buckets with others is the hub (of a
   family of copies, the original), and every other member is a candidate pair with it: a bucket of m members gives m-1
   pairs, not m squared.
3. The low `BITS` bits of all minima are packed; the share of equal entries, corrected for chance collisions, estimates
   similarity and drops pairs far below the threshold.
4. Candidates are confirmed on the full sets: first the most similar one of each node, then those whose ends are still
   in different components.
5. Members that are not in their hub's component are compared with everything else in the bucket on the packed
   signatures, in blocks, and again confirmed on full sets, so a link that does not pass through the hub is found as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_slices
from .common import drop_tables, few_rows, save, small_batches
from .components import components
from .shingles import overlap, shingle_sets

BANDS, ROWS, BITS = 32, 4, 2
PRODUCTS = 256
PERMUTATIONS = 2 * PRODUCTS  # both halves of a 64-bit product are hashes; the bands use the first of the upper ones
SLACK = 5.0  # standard deviations of the signature estimate below the threshold that still go to the full sets
FRAGMENT, FRAGMENT_BYTES = 1024, 4 << 20  # rows and bytes of a block of a family

_RNG = np.random.default_rng(42)
_A = _RNG.integers(1, 2**63, PRODUCTS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**63, PRODUCTS, dtype=np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """texts x permutations of 32-bit minima; every set holds at least one shingle."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), PERMUTATIONS), np.uint32)
    for i in range(PRODUCTS):
        halves = (flat * _A[i] + _B[i]).view(np.uint32).reshape(-1, 2)
        out[:, i] = np.minimum.reduceat(halves[:, 1], at)
        out[:, PRODUCTS + i] = np.minimum.reduceat(halves[:, 0], at)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """rows x bytes: `BITS` planes of bits, one after the other."""
    return np.concatenate([np.packbits((low >> b) & 1, axis=1) for b in range(BITS)], axis=1)


def similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Collision-corrected estimate from packed signatures; any leading shape, last axis the bytes."""
    half = PERMUTATIONS // 8
    differ = x ^ y
    planes = differ[..., :half]
    for b in range(1, BITS):
        planes = planes | differ[..., b * half : (b + 1) * half]
    equal = 1 - np.bitwise_count(planes).sum(axis=-1, dtype=np.int64) / PERMUTATIONS
    chance = 0.5**BITS
    return (equal - chance) / (1 - chance)


def floor_for(threshold: float) -> float:
    chance = 0.5**BITS
    p = threshold + (1 - threshold) * chance
    return (p - SLACK * (p * (1 - p) / PERMUTATIONS) ** 0.5 - chance) / (1 - chance)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, most=1_500_000):
                sets = shingle_sets([x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()], size)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list[list[int] | None] = [None] * len(sets)
                sigs: list[bytes | None] = [None] * len(sets)
                nodes: list[int | None] = [None] * len(sets)
                if full:
                    low = minima([sets[i] for i in full])
                    pack = packed(low)
                    for k, i in enumerate(full):
                        keys[i] = [int(x) for x in np.array([xxhash.xxh3_64_intdigest(low[k, r : r + ROWS].tobytes(), seed=r) for r in range(0, BANDS * ROWS, ROWS)], np.uint64).view(np.int64)]
                        sigs[i], nodes[i] = pack[k].tobytes(), xxhash.xxh3_64_intdigest(sets[i].tobytes()) - 2**63
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "row", "n_shingles", "node", "sig", "bands"],
                )

    return run


def _confirm(size: int, percent: int):
    """Rows (a, b, text_a, text_b), those with one b together, to the linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, base = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            sets = shingle_sets(batch.column("text_a").cast(pa.binary()).to_pylist(), size)
            keep = []
            for i, (s, hub) in enumerate(zip(sets, b)):
                if hub != last or base is None:
                    last, base = hub, shingle_sets([batch.column("text_b")[i].as_py().encode()], size)[0]
                both = overlap(s, base)
                if 100 * both >= percent * (len(s) + len(base) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    return run


def _estimate(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("sig_a", "sig_b"))
            alike = similarity(x, y)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(alike)], PAIR_NAMES)
            yield out.filter(pa.array(alike >= least))

    return run


def _blocks(least: float, size: int, percent: int):
    """Rows with two blocks of a family to the links between different components, one for each member and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                n, m = row["few"], row["many"]
                x, y = (np.frombuffer(b"".join(r["sig"] for r in z), np.uint8).reshape(len(z), -1) for z in (n, m))
                kx, ky = (np.array([r["bands"] for r in z], np.int64) for z in (n, m))
                other, others = np.array([r["component"] for r in m]), np.array([r["node"] for r in m])
                away = np.array([r["away"] for r in m])
                sets: dict[int, np.ndarray] = {}
                full = lambda r: sets[r["node"]] if r["node"] in sets else sets.setdefault(r["node"], shingle_sets([r["text"].encode()], size)[0])  # noqa: B023, E731
                found = []
                for i, r in enumerate(n):
                    # A pair of two such members is seen from both sides: it counts once.
                    alike = similarity(x[i], y)
                    hit = np.flatnonzero((alike >= least) & (other != r["component"]) & ~(away & (others < r["node"])))
                    hit = hit[(ky[hit] == kx[i]).any(axis=1)]
                    done: set[int] = set()
                    for j in hit[np.argsort(-alike[hit], kind="stable")].tolist():
                        if other[j] not in done:
                            s, t = full(r), full(m[j])
                            both = overlap(s, t)
                            if 100 * both >= percent * (len(s) + len(t) - both):
                                done.add(other[j])
                                found.append((r["node"], m[j]["node"]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


PAIR_NAMES = ["a", "b", "alike"]
PAIRS = "a long, b long, alike double"


def confirm_links(texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; `texts` has node and text."""
    first = pairs.select("a", "b").join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
    second = first.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")
    return second.mapInArrow(_confirm(size, percent), "a long, b long")


def _between(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components, named ca and cb."""
    for end in ("a", "b"):
        pairs = pairs.join(groups.withColumnsRenamed({"node": end, "component": f"c{end}"}), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return pairs.filter("ca <> cb")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and row (hash of doc_id and text) for every row of `docs` (doc_id, text).

    A set is the distinct shingles of `size` words; fewer words make one shingle.  Texts that are null or without words
    have none, link with nothing and are kept.  Documents link if 100 * intersection >= percent * union; a component is
    named by its smallest doc_id, whose row is kept.  Rows that repeat a doc_id are documents of their own with one name;
    a row without an id is kept only if no row of its component has one and its hash is the smallest.
    """
    small_batches(docs.sparkSession)
    least = floor_for(percent / 100)
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    rows = save(docs.mapInArrow(_signatures(size), "doc_id long, row long, n_shingles long, node long, sig binary, bands array<long>"), "signatures")
    classes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = save(classes, "classes")
    members = save(classes.select("node", F.posexplode("bands").alias("band", "key")), "members")
    place = ["band", "key"]
    sizes = save(members.groupBy(*place).agg(F.count("*").alias("m")).filter("m > 1"), "sizes")
    inside = save(members.join(sizes, place), "inside")
    degree = save(inside.groupBy("node").agg(F.sum("m").alias("degree")), "degree")
    ranked = save(inside.join(degree, "node").select(*place, "m", "node", F.struct("degree", F.xxhash64("node").alias("h"), "node").alias("rank")), "ranked")
    # The texts of all nodes that share a bucket; the others link with nothing.
    shared = classes.join(degree, "node").select("node", "row")
    texts = save(docs.select("row", "text").join(shared, "row").select("node", "text"), "texts")
    drop_tables(members, sizes, inside, degree)

    hubs = save(ranked.groupBy(*place).agg(F.max("rank").alias("hub")).select(*place, F.col("hub.node").alias("b")), "hubs")
    pairs = save(ranked.select(*place, F.col("node").alias("a")).join(hubs, place).filter("a <> b").select("a", "b").distinct(), "pairs")
    sigs = classes.select("node", "sig")
    both = pairs.join(sigs.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a").join(sigs.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b")
    near = save(both.select("a", "b", "sig_a", "sig_b").mapInArrow(_estimate(least), PAIRS), "near")
    drop_tables(pairs)
    best = save(near.groupBy("a").agg(F.max(F.struct("alike", "b")).alias("x")).select("a", "x.b"), "best")
    links = save(confirm_links(texts, best, size, percent), "links")
    groups = components(links)

    rest = save(_between(near.join(best, ["a", "b"], "left_anti"), groups).select("a", "b"), "rest")
    new = save(confirm_links(texts, rest, size, percent), "links")
    drop_tables(near, best, rest)
    if not new.isEmpty():
        links = links.unionByName(new)
        groups = components(links)

    # Members outside their hub's component meet all members of their family: the nodes that such buckets hold together.
    # Both sides come in blocks of bounded size, and only links leave a block.
    component = F.coalesce("component", "node")
    named = save(ranked.join(groups, "node", "left").select(*place, "node", component.alias("component")), "named")
    held = save(hubs.withColumnRenamed("b", "node").join(groups, "node", "left").select(*place, F.col("node").alias("hub"), component.alias("hub_component")), "held")
    named = save(named.join(held, place).withColumn("away", F.col("component") != F.col("hub_component")).drop("hub_component"), "away")
    loose = save(named.filter("away").select(*place).distinct(), "loose")
    drop_tables(ranked, hubs, held)
    open_ = save(named.join(loose, place).groupBy("node", "component", "hub").agg(F.bool_or("away").alias("away")), "open")
    families = components(open_.select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("component", "family")
    open_ = open_.groupBy("node", "component").agg(F.bool_or("away").alias("away")).join(families, "node").join(classes.select("node", "sig", "bands"), "node").join(texts, "node")
    open_ = save(open_, "members")
    drop_tables(loose, texts)
    size_of = F.octet_length("text")
    volume = open_.groupBy("family").agg(F.count("*").alias("n"), F.sum(size_of).alias("bytes"), F.count_if("away").alias("k"), F.sum(F.when(F.col("away"), size_of)).alias("k_bytes"))
    blocks = lambda n, b: F.ceil(F.greatest(F.col(n) / FRAGMENT, F.col(b) / FRAGMENT_BYTES)).cast("int")
    volume = save(volume.filter("k > 0").select("family", blocks("n", "bytes").alias("ys"), blocks("k", "k_bytes").alias("xs")), "volume")
    open_ = save(open_.join(volume, "family"), "dealt")
    item = F.struct("node", "component", "sig", "bands", "away", "text")
    spot = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    many = open_.groupBy("family", spot("ys").alias("y")).agg(F.collect_list(item).alias("many"))
    few = open_.filter("away").groupBy("family", "ys", spot("xs").alias("x")).agg(F.collect_list(item).alias("few"))
    few = few.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("ys") - 1)))
    with few_rows(docs.sparkSession, 8):
        late = save(few.join(many, ["family", "y"]).select("few", "many").mapInArrow(_blocks(least, size, percent), "a long, b long"), "late")
    drop_tables(open_, volume)
    if not late.isEmpty():
        groups = components(links.unionByName(late))

    named = classes.select("node", "doc_id", "row").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = save(named, "components")
    least_of = save(named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("row").alias("least_row")), "names")
    of_node = save(named.select("node", "component").join(least_of, "component").drop("component"), "nodes")
    drop_tables(classes, links, named, least_of)
    out = rows.select("doc_id", "row", "n_shingles", "node").join(of_node, "node", "left")
    kept = F.when(F.col("node").isNull(), F.lit(True)).when(F.col("component_id").isNull(), F.col("row") == F.col("least_row")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "row")
