"""Near-duplicate classes by BagMinHash: weighted Jaccard of word-shingle multisets.

Texts of equal words form one node.  A node's shingles, with their counts, give a signature of
REGISTERS values: for every shingle a Poisson process runs over its discretised weight, whose
dyadic intervals (0,1], (1,2], (2,4], ... have processes of their own, so a count of w takes
log w of them; each point of a process hits a register, and a register keeps the earliest point.
Two nodes agree in a register with the probability of their weighted Jaccard similarity.  Bands of
ROWS registers are buckets.  Nodes that share a bucket are candidates, each is held against the
bucket's leader, and what similarity on the whole multisets confirms is a link.  Later rounds
take new leaders while a bucket spans several components; after ROUNDS of them all pairs of
different components that still share a bucket are compared in blocks, so no link that could
join two classes stays untested.  Links, buckets and classes are tables; none is collected.
Rows are told apart by a number that they get when they are first stored, so null and repeated
ids need no care.  A bucket of more than HOT nodes is dealt over several salts, and its leader is
sent to each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import decided, dropped, likely, numbered, told, written
from .tokens import slices

WORDS = 5
SIMILARITY = 0.8
ROWS, BANDS = 4, 24
REGISTERS = ROWS * BANDS
ROUNDS = 3
#: Nodes of a bucket that one salt gets, about.
HOT = 1024
#: Nodes of a cluster, and bytes of their multisets, that meet in one block of the last round, and the signature
#: agreement below which a pair is not looked at: for a similarity of 0.8 over 96 registers it lies six deviations low.
BLOCK, BLOCK_BYTES, LEAST_AGREEMENT = 1024, 16 << 20, 0.55
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SHINGLES = 400_000  # of documents that are sketched together


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], n: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of all windows of ``n`` words, repeats included; fewer words form one shingle."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = max(1, len(words) - n + 1)
    total = np.zeros(count, np.uint64)
    for i in range(min(n, len(words))):
        total = _mix(total + _GOLDEN) ^ each[i : i + count]
    return np.sort(_mix(total))


def node_of(words: list[bytes]) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def bag_signatures(keys: np.ndarray, counts: np.ndarray, owner: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m registers of n multisets: ``keys`` are their distinct elements, ``owner`` the multiset of each."""
    registers = np.full(n * m, np.inf)
    steps = np.ones(len(counts), np.int64)  # dyadic intervals that a count reaches
    reach = counts > 1
    steps[reach] = 1 + np.ceil(np.log2(counts[reach])).astype(np.int64)
    at = np.repeat(np.arange(len(keys)), steps)
    interval = np.arange(len(at)) - np.repeat(np.cumsum(steps) - steps, steps)
    low = np.where(interval > 0, 1 << np.maximum(interval - 1, 0), 0)
    length = np.maximum(low, 1)
    seed = _mix(keys[at] ^ _mix(interval.astype(np.uint64) * _GOLDEN))
    doc, weight, time = owner[at], counts[at], np.zeros(len(at))
    rate = (m * length).astype(float)
    latest = np.full(n, np.inf)
    point = 0
    while len(seed):
        point += 1
        bits = _mix(seed + np.uint64(point * int(_GOLDEN) % (1 << 64)))
        time = time - np.log(((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        live = time < latest[doc]
        if not live.all():
            seed, doc, weight, time, rate, low, length, bits = (x[live] for x in (seed, doc, weight, time, rate, low, length, bits))
        if not len(seed):
            break
        register = ((_mix(bits ^ _GOLDEN) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        place = doc * m + register.astype(np.int64)
        wide = length > 1
        if wide.any():  # a point of a wide interval has a place in it, which the weight must cover
            inside = (_mix(bits) >> np.uint64(11)).astype(float) * 2.0**-53 * length
            valid = ~wide | (low + np.floor(inside) < weight)
            np.minimum.at(registers, place[valid], time[valid])
        else:
            np.minimum.at(registers, place, time)
        latest = registers.reshape(n, m).max(axis=1)
    return registers.reshape(n, m)


def buckets_of(signatures: np.ndarray) -> np.ndarray:
    """n x BANDS hashes of the bands, the band's number included."""
    bits = signatures.view(np.uint64).reshape(len(signatures), BANDS, ROWS)
    total = np.broadcast_to(_mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN), bits.shape[:2]).copy()
    for i in range(ROWS):
        total = _mix(total ^ bits[:, :, i]) + _GOLDEN
    return total.view(np.int64)


def _counted(shingles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in shingles], np.int64)
    joined = np.concatenate(shingles) if shingles else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(shingles)), lengths)
    first = np.ones(len(joined), bool)
    first[1:] = (joined[1:] != joined[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(first)
    return joined[starts], np.diff(np.append(starts, len(joined))), owner[starts]


def sketches(rows: DataFrame) -> DataFrame:
    """row, doc_id, node, buckets (one for each band; none for texts without words) of rows of (row, doc_id, text)."""

    def sketch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def done(ids, nodes, shingles):
            keys, counts, owner = _counted(shingles)
            buckets = buckets_of(bag_signatures(keys, counts, owner, len(nodes)))
            filled = np.array([len(s) > 0 for s in shingles])
            offsets = np.concatenate([[0], np.cumsum(np.where(filled, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(buckets[filled].reshape(-1)))
            told = zip(*ids)
            return pa.RecordBatch.from_arrays([pa.array(next(told), pa.int64()), pa.array(next(told), pa.int64()), pa.array(nodes, pa.int64()), lists], ["row", "doc_id", "node", "buckets"])

        ids, nodes, shingles, held = [], [], [], 0
        for batch in slices(batches):
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = (text or "").encode().split()
                ids.append((row, doc_id))
                nodes.append(node_of(words))
                shingles.append(shingle_hashes(words))
                held += len(words)
                if held >= _SHINGLES:
                    yield done(ids, nodes, shingles)
                    ids, nodes, shingles, held = [], [], [], 0
        if ids:
            yield done(ids, nodes, shingles)

    return rows.select("row", "doc_id", "text").mapInArrow(sketch, "row long, doc_id long, node long, buckets array<long>")


def _multisets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, keys, counts, signature (binary) of the nodes in ``wanted`` (node, row of one of its texts)."""

    def take(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            told = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts, owner = _counted([shingle_hashes((text or "").encode().split())])
                signature = bag_signatures(keys, counts, owner, 1)
                told.append((node, keys.tobytes(), counts.astype("<u4").tobytes(), _mix(signature.view(np.uint64)).astype("<u2").tobytes()))
            columns = zip(*told) if told else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["node", "keys", "counts", "signature"])

    joined = likely(rows.select("row", "text"), wanted, "row").join(wanted, "row").select("node", "text")
    return written(joined.mapInArrow(take, "node long, keys binary, counts binary, signature binary"), "multisets")


def similarity(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> float:
    """Weighted Jaccard of two multisets given as sorted keys and counts."""
    ka, kb = np.frombuffer(a[0], np.uint64), np.frombuffer(b[0], np.uint64)
    ca, cb = np.frombuffer(a[1], "<u4").astype(np.int64), np.frombuffer(b[1], "<u4").astype(np.int64)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[ia], cb[ib]).sum())
    either = int(ca.sum() + cb.sum()) - both
    return both / either if either else 1.0


def _verified(pairs: DataFrame, multisets: DataFrame, least: float) -> DataFrame:
    """ra, rb: the roots of the pairs (a, b, ra, rb) of ``pairs`` whose similarity is ``least`` or more."""

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            ka, ca, kb, cb = (batch.column(c).to_pylist() for c in ("ka", "ca", "kb", "cb"))
            good = pa.array([i for i in range(len(ka)) if similarity((ka[i], ca[i]), (kb[i], cb[i])) >= least], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("ra").take(good), batch.column("rb").take(good)], ["ra", "rb"])

    sides = [multisets.select(F.col("node").alias(x), F.col("keys").alias(f"k{x}"), F.col("counts").alias(f"c{x}")) for x in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("ra", "rb", "ka", "ca", "kb", "cb")
    return joined.mapInArrow(verify, "ra long, rb long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of all nodes in ``links`` (a, b) but the roots.

    Large-star and small-star steps in turn until only stars are left.  The least neighbours of
    nodes that are not the least themselves are stored before they are joined, so Spark knows
    their size, and can split a node with many neighbours where it does not broadcast.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up = 1 and down > 0)").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lower = written(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u"), "least-neighbours")
        large = written(both.where("v > u").join(lower, "u", "left").select(F.col("v").alias("a"), F.coalesce("m", "u").alias("b")).distinct(), "large-star")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least-neighbours")
        old, edges = edges, written(large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "small-star")
        for table in (old, lower, large, least):
            dropped(table)


def _salted(by_bucket: DataFrame) -> DataFrame:
    """Rows of (bucket, salts, ...) once for each salt of their bucket."""
    return by_bucket.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def _rooted(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return buckets.withColumn("root", F.col("node"))
    return buckets.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """``labels`` (node, root) after ``links`` (ra, rb) between roots; components are sought among these roots only."""
    if links.isEmpty():
        return labels
    new = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    if labels is None:
        return new
    moved = labels.join(new.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return written(moved.unionByName(new), "labels")


def _in_blocks(rest: DataFrame, nodes: DataFrame, multisets: DataFrame, least: float) -> DataFrame:
    """Links (ra, rb) between different roots from all pairs of ``rest`` (bucket, salt, salts, node, root) that share a bucket.

    Nodes that buckets connect form a cluster, and each cluster is cut into blocks, by number and
    by bytes, so a multiset travels once for each block of its cluster, not once for each bucket.
    A pair of blocks is compared in one group: pairs whose roots differ, which share a bucket, and
    whose signatures do not rule similarity out are verified; a link joins the two roots there, so
    at most one link less than there are roots comes out.
    """
    hubs = _salted(rest.groupBy("bucket").agg(F.min("node").alias("hub"), F.first("salts").alias("salts")))
    stars = rest.select("bucket", "salt", "node").join(hubs, ["bucket", "salt"]).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    clusters = components(stars).withColumnRenamed("root", "hub")
    bytes_ = multisets.select("node", (F.octet_length("keys") + F.octet_length("counts")).cast("long").alias("bytes"))
    clustered = rest.select("node", "root").distinct().join(clusters, "node", "left").select("node", "root", F.coalesce("hub", "node").alias("cluster")).join(bytes_, "node")
    clustered = written(clustered, "clustered")
    sizes = clustered.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    dealt = clustered.join(written(sizes, "cluster-sizes"), "cluster").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")
    full = multisets.join(nodes.select("node", "buckets"), "node")
    dealt = dealt.join(full, "node")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        signs = np.stack([np.frombuffer(s, "<u2") for s in group["signature"]])
        buckets = np.stack(group["buckets"].to_list())
        first, mine = group["root"].to_numpy(), group["own"].to_numpy()
        roots = first.copy()
        sets = list(zip(group["keys"], group["counts"]))
        right, found = np.flatnonzero(mine == key[2]), []
        for x in np.flatnonzero(mine == key[1]):
            apart = right[roots[right] != roots[x]]
            if key[1] == key[2]:
                apart = apart[apart > x]
            if not len(apart):
                continue
            near = apart[(signs[apart] == signs[x]).mean(axis=1) >= LEAST_AGREEMENT]
            near = near[(buckets[near] == buckets[x]).any(axis=1)]
            for y in near:
                if roots[x] != roots[y] and similarity(sets[x], sets[y]) >= least:
                    found.append((first[x], first[y]))
                    roots[roots == roots[y]] = roots[x]
        return pd.DataFrame(found, columns=["ra", "rb"], dtype="int64")

    return dealt.groupBy("cluster", "i", "j").applyInPandas(compare, "ra long, rb long")


def _classes(rows: DataFrame, least: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Of a stored table (row, doc_id, text): row, doc_id, node of every row; node, first, root of every node.

    ``first``: (doc_id is null, doc_id, row) of the node's first row.  A root is some node of the class.
    """
    marked = written(sketches(rows), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    nodes = written(marked.groupBy("node").agg(F.first("buckets").alias("buckets"), F.min(first).alias("first")), "nodes")
    placed = nodes.select(F.explode("buckets").alias("bucket"), "node")
    shared = written(placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / HOT).cast("int").alias("salts")), "shared-buckets")
    salt = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt")
    buckets = written(placed.join(shared, "bucket").select("bucket", salt, "salts", "node"), "buckets")
    wanted = nodes.select("node", F.col("first.row").alias("row")).join(buckets.select("node").distinct(), "node", "left_semi")
    multisets = _multisets(rows, written(wanted, "candidates"))
    labels, open_buckets = None, buckets.withColumn("led", F.lit(False))
    for _ in range(rounds):
        rooted = _rooted(open_buckets, labels)
        by_root = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.min(F.when(~F.col("led"), F.col("node"))).alias("node"), F.first("salts").alias("salts"))
        # the leader is a node that has not led yet, of the component with fewest nodes in the bucket
        candidates = F.min(F.when(F.col("node").isNotNull(), F.struct("n", "node", "root")))
        leaders = by_root.groupBy("bucket").agg(F.count_if(F.col("node").isNotNull()).alias("open"), candidates.alias("next"), F.first("salts").alias("salts"))
        leaders = _salted(leaders.where("open > 1").select("bucket", "salts", F.col("next.node").alias("leader"), F.col("next.root").alias("leader_root")))
        round_rows = written(rooted.join(leaders, ["bucket", "salt"]), "round")
        pairs = round_rows.where("root <> leader_root").select(F.col("node").alias("a"), F.col("leader").alias("b"), F.col("root").alias("ra"), F.col("leader_root").alias("rb")).distinct()
        labels = _relabelled(labels, written(_verified(pairs, multisets, least), "found"))
        open_buckets = round_rows.select("bucket", "salt", "salts", "node", (F.col("led") | (F.col("node") == F.col("leader"))).alias("led"))
    rest = _rooted(open_buckets.where(~F.col("led")), labels)
    several = rest.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.first("salts").alias("salts")).where("x <> y").select("bucket", "salts")
    rest = written(rest.join(_salted(several), ["bucket", "salt"]).select("bucket", "salt", "salts", "node", "root"), "rest")
    if not rest.isEmpty():
        labels = _relabelled(labels, written(_in_blocks(rest, nodes, multisets, least), "found"))
    dropped(multisets)
    return marked, written(_rooted(nodes.select("node", "first"), labels), "roots")


def near_duplicate_classes(docs: DataFrame, least: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) of every row of ``docs``.

    Null and empty texts, and all without words, are copies of one another.  Rows of a null doc_id
    belong to the class of their text like others; a class with none but such rows has class_id
    null.  Repeated rows come out as often as they went in; other columns are ignored; an empty
    table gives no rows.
    """
    marked, roots = _classes(numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("row", "doc.doc_id", "doc.text"), least, rounds)
    classes = written(roots.groupBy("root").agg(F.min("first.doc_id").alias("class_id")), "class-ids")
    named = written(roots.join(classes, "root").select("node", "class_id"), "classes")
    return marked.select("doc_id", "node").join(named, "node").select("doc_id", "class_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one of least doc_id, any one of them where that repeats.

    All columns stay, whatever their names.  A class whose rows all have a null doc_id keeps one of them.
    """
    rows = numbered(docs)

    def first() -> DataFrame:
        _, roots = _classes(rows.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").alias("text")), SIMILARITY, ROUNDS)
        return roots.groupBy("root").agg(F.min("first").alias("first")).select("first.row", F.lit(1).alias("kept"))

    return told(rows, decided(first, "kept"), "kept").where("kept = 1").select("doc.*")


def op10_bagminhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    from .store import documents

    return near_duplicate_classes(documents(spark, sf_dir))
