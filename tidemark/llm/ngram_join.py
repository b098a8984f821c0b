"""Similarity join of documents on their sets of word n-grams, by multiple global token orders.

Under any total order of tokens, two sets of Jaccard similarity t or more share at least l tokens among the first
n - ceil(t * n) + l tokens of each (their prefixes; l grows with n, and the smaller of the two l holds). The join holds two
different orders against each other: a token that is rare enough in the first order's prefixes makes candidates, a document
with fewer than l tokens shared in its first prefix leaves at once, and a pair must then share l tokens of its prefixes under
the first order and l under the second before it is verified on the whole sets. Both orders put rare tokens first, by classes
of a count sketch over all documents, and break ties by different hashes; a passage that thousands of documents share thus
stays out of prefixes, while two orders rarely let the same chance meeting through.

Hot groups. Documents with the same set are one node. The nodes that share a token are first compared with one of them
only, the hub, which has the fewest tokens of its own; links make components. Where BUCKET nodes or fewer share a token,
those of different components are compared as they are. For larger ones, the hubs of a component give way to one of them,
the chief. Two nodes of a chief that lie in different components are compared by their differences from it: sets
differ as much as their differences from a third set do, so of two similar nodes, at least one of them not linked with the
chief, the differences must share tokens among the first of an order, too. Copies that were changed in different places
share few of these, and the many nodes of the chief's own component only meet the others. A group of thousands of near
copies thus costs about one verification each, not one for each pair, and no link between different texts is lost.

Sets are kept as 64-bit hashes of tokens, nodes as 128-bit hashes of sets; texts are read three times (sketch, prefixes,
sets of candidates only) instead of storing all sets.

Defined results: A-Z are lower-cased; words are separated by ASCII white space; a text with fewer words than n is one
token; a null, empty or blank text has an empty set and is linked with nothing. Rows that repeat an id are documents of
their own that share the id. A null id never is a component's id unless all its ids are null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, map_arrow, slices, stage, store, table, unstage

SLICE_BYTES = 3 << 20
#: Counters of the sketch, and the rows in which a partition's counts are sent.
COUNTERS, CHUNKS = 1 << 20, 64
#: Bytes of words that a worker keeps, about.
KEPT_BYTES, ENTRY_BYTES = 40 << 20, 200
#: Nodes that share a token, up to which their pairs are compared as they are: so many rows for a node and token at most.
BUCKET = 16
U = np.uint64


class WordHashes(dict):
    held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += ENTRY_BYTES + len(word)
        if self.held > KEPT_BYTES:
            self.clear()
            self.held = 0
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def word_hashes() -> WordHashes:
    return store("word hashes", WordHashes)


def _mix(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ U(by)) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out + h[i : len(words) - k + 1 + i], 0x2545F4914F6CDD1D)
    return np.unique(out)


def required(n: int, percent: int) -> int:
    """The least intersection that a set of n tokens can have with a similar one."""
    return -(-percent * n // 100)


def least_shared(n: int, percent: int) -> int:
    """l of a set of n tokens: half of the tokens that it can lack, and one."""
    return 1 + n * (100 - percent) // 200


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U(40)).astype(np.int64) & (COUNTERS - 1)


def _order(tokens: np.ndarray, classes: np.ndarray, seed: int) -> np.ndarray:
    return (classes[_counter(tokens)].astype(np.uint64) << U(56)) | (_mix(tokens, seed) >> U(8))


def prefix(tokens: np.ndarray, classes: np.ndarray, percent: int, seed: int) -> np.ndarray:
    """The first tokens under the order (class, seeded hash)."""
    most = len(tokens) - required(len(tokens), percent) + least_shared(len(tokens), percent)
    return tokens if most >= len(tokens) else tokens[np.argpartition(_order(tokens, classes, seed), most - 1)[:most]]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _sketch(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]]) -> np.ndarray:
    """How often each counter occurs among the hashes that batches of ``rows`` hold."""

    def count(batches):
        word_hashes()
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for found in hashes(batch):
                total += np.bincount(_counter(found), minlength=COUNTERS)
        parts = total.astype("<u4").reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "n"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, n in zip(batch.column("chunk").to_pylist(), batch.column("n").to_pylist(), strict=True):
                x = np.frombuffer(n, "<u4" if len(n) == 4 * COUNTERS // CHUNKS else "<i8").astype("<i8")
                total[chunk] = total[chunk] + x if chunk in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "n"])

    schema = "chunk int, n binary"
    sums = map_arrow(map_arrow(rows, count, schema).repartition(CHUNKS, "chunk"), add, schema)
    counts = np.zeros((CHUNKS, COUNTERS // CHUNKS), np.int64)
    for row in sums.collect():  # CHUNKS rows
        counts[row.chunk] += np.frombuffer(row.n, "<i8")
    return counts.ravel()


def rarity_classes(texts: DataFrame, n: int) -> np.ndarray:
    """A class for each counter: 128 at the mean count, 16 for each doubling.

    A counter holds its token's frequency and the noise of those that share it; a prefix takes the lowest counters, so
    tokens whose frequency stands out of the noise (its deviation is the root of the mean) don't get into prefixes.
    """

    def hashes(batch):
        for part in slices(batch, "text", SLICE_BYTES):
            yield np.concatenate([np.zeros(0, np.uint64), *(shingles(t, n) for t in part.column("text").to_pylist())])

    counts = _sketch(texts.select("text"), hashes)
    return np.clip(np.rint(16 * np.log2(np.maximum(counts, 1) / max(1.0, counts.mean()))) + 128, 0, 255).astype(np.uint8)


def _signatures(texts: DataFrame, classes: np.ndarray, n: int, percent: int) -> DataFrame:
    """(id, n, s, tokens): the set's size and hash, and its prefix under the first order."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sizes, hashes, first = [], [], []
                for t in part.column("text").to_pylist():
                    x = shingles(t, n)
                    sizes.append(len(x))
                    hashes.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                    first.append(prefix(x, classes, percent, 1) if len(x) else x)
                ends = np.append(0, np.cumsum([len(x) for x in first])).astype(np.int32)
                flat = np.concatenate(first).view(np.int64) if first else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.ListArray.from_arrays(ends, flat)], names=["id", "n", "s", "tokens"])

    return map_arrow(texts, run, "id long, n long, s binary, tokens array<long>")


def _sets(texts: DataFrame, classes: np.ndarray, n: int, percent: int) -> DataFrame:
    """(s, tokens, first, second): whole sets and their prefixes under either order."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 2):
                sets = [x for t in part.column("text").to_pylist() if len(x := shingles(t, n))]
                lists = []
                for of in (sets, *([prefix(x, classes, percent, seed) for x in sets] for seed in (1, 2))):
                    ends = np.append(0, np.cumsum([len(x) for x in of])).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(ends, np.concatenate(of).view(np.int64) if of else np.zeros(0, np.int64)))
                hashes = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), *lists], names=["s", "tokens", "first", "second"])

    return map_arrow(texts, run, "s binary, tokens array<long>, first array<long>, second array<long>")


def _least_shared(n, percent: int) -> F.Column:
    return 1 + F.floor(n * (100 - percent) / 200)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) those that are similar: both orders' prefixes first, then the whole sets."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("first", "second"))), side)
    least = _least_shared(F.least("n_a", "n_b"), percent)
    passed = [F.size(F.array_intersect(f"{c}_a", f"{c}_b")) >= least for c in ("first", "second")]
    pairs = pairs.filter(passed[0] & passed[1]).select("a", "b", "n_a", "n_b")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("tokens").alias(f"set_{side}")), side)
    common = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.filter(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each node's component, by repeated minima over neighbours and pointer jumping."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = stage(both, "join-edges")
    labels = stage(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "join-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("component")), "other").groupBy("node").agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        low = stage(low, "join-low")
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = low.join(jump, "low", "left").select("node", "old", F.coalesce("lower", "low").alias("component"))
        new = stage(new, "join-labels")
        changed = new.agg(F.max(F.col("component") != F.col("old"))).first()[0]
        unstage(labels)
        unstage(low)
        labels = new.select("node", "component")
        if not changed:
            unstage(both)
            return labels


def _by_hub(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of about SLICE_BYTES of differences: rows, ends of their tokens, these, and these hashed together with the hub."""
    starts = np.asarray(batch.column("differ").offsets)[:-1]
    cuts = np.flatnonzero(np.diff(starts // (SLICE_BYTES // 8))) + 1
    for i, j in itertools.pairwise([0, *cuts.tolist(), len(starts)]):
        part = batch.slice(i, j - i)
        lists = part.column("differ")
        ends = np.asarray(lists.offsets)
        flat = np.asarray(lists.values).view(np.uint64)[ends[0] : ends[-1]]
        hubs = np.repeat(np.asarray(part.column("hub")).view(np.uint64), np.diff(ends))
        yield part, ends - ends[0], flat, _mix(flat + _mix(hubs, 0x2545F4914F6CDD1D), 3)


def _differences(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A row for each token of the prefix of the difference between a node's set and its chief's, of d tokens.

    Let k = (1 - t) / (1 + t), so that sets of x and y tokens are similar if they differ in k * (x + y) tokens at most,
    and let s = d - k * (n + hub_n), above 0 for a node that isn't linked with its chief. The differences of two similar
    nodes x (not linked) and y share at least max(1, s_x / (1 + k), (1 - k) * d_y / 2) tokens, and if y isn't linked
    either, also (1 - k) * d_x / 2. Tokens have their ``rank`` in the order. So a linked node has one prefix, always
    ``core``; one that isn't linked has a longer prefix to meet linked nodes, of which the ``core`` meets the others.

    The order puts tokens first that few differences from the chief hold, as a sketch counts them. That isn't the order of
    rare tokens: one that only the chief has is rare, but lies in all differences, and so does nearly one that all but the
    chief have. Last in the order, they are past the prefixes and let no two differences meet.
    """
    for side, key in (("x", "node"), ("h", "hub")):
        met = met.join(sets.select(F.col("node").alias(key), F.col("tokens").alias(f"set_{side}")), key)
    differ = met.select("hub", "hub_n", "node", "n", "part", "main", F.concat(F.array_except("set_x", "set_h"), F.array_except("set_h", "set_x")).alias("differ"))
    differ = stage(differ, "join-differ")
    counts = _sketch(differ.select("hub", "differ"), lambda batch: (of_hub for *_, of_hub in _by_hub(batch)))
    classes = np.minimum(np.rint(8 * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8)
    k = (100 - percent) / (100 + percent)

    def run(batches):
        claim()
        for part, ends, flat, of_hub in itertools.chain.from_iterable(map(_by_hub, batches)):
            d = np.diff(ends)
            both = np.asarray(part.column("n")) + np.asarray(part.column("hub_n"))
            s = d - k * both
            linked = d * (100 + percent) <= (100 - percent) * both
            half = (1 - k) * d / 2
            core = d + 1 - np.maximum(1, np.ceil(np.maximum(half, s / (1 + k)) - 1e-6)).astype(np.int64)
            most = np.where(linked, core, d + 1 - np.maximum(1, np.ceil(s / (1 + k) - 1e-6)).astype(np.int64))
            order = _order(of_hub, classes, 1)
            first = []
            for i, j, m in zip(ends[:-1].tolist(), ends[1:].tolist(), most.tolist(), strict=True):
                first.append(flat[i:j][np.argsort(order[i:j])[:m]])
            upto = np.append(0, np.cumsum([len(x) for x in first])).astype(np.int32)
            columns = {c: part.column(c) for c in ("hub", "node", "n", "part", "main")}
            columns |= {"d": pa.array(d.astype(np.int64)), "linked": pa.array(linked), "core": pa.array(core)}
            columns["tokens"] = pa.ListArray.from_arrays(upto, np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64))
            yield pa.RecordBatch.from_pydict(columns)

    first = stage(map_arrow(differ, run, "hub long, node long, n long, part long, main boolean, d long, linked boolean, core long, tokens array<long>"), "join-differences")
    unstage(differ)
    return first


def _by_token(differ: DataFrame) -> DataFrame:
    rows = differ.select("*", F.posexplode("tokens").alias("rank", "token")).drop("tokens")
    return rows.withColumn("core", F.col("rank") < F.col("core"))


def ngram_components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_shingles, component_id (the smallest id reachable by links of similarity percent / 100)."""
    texts = _texts(docs, id_col, text_col)
    classes = rarity_classes(texts, n)
    signed = stage(_signatures(texts, classes, n, percent), "join-signed")

    nodes = signed.filter(F.col("s").isNotNull()).groupBy("s").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    wide = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "join-nodes-wide")
    thin = stage(signed.select("id", "n", "s"), "join-rows")
    unstage(signed)
    signed, nodes = thin, stage(wide.select("node", "s", "id", "n"), "join-nodes")

    meets = wide.select("node", "n", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    common = meets.groupBy("token").count().filter(F.col("count") > 1).select("token")
    shared = stage(meets.join(common, "token"), "join-shared")
    smallest = F.ceil(F.col("n") * percent / 100)  # the least size of a similar set
    alive = shared.groupBy("node", "n", "size").count().filter(F.col("count") >= _least_shared(smallest, percent)).select("node", (F.col("size") - F.col("count")).alias("lonely"))
    shared_alive = stage(shared.drop("size").join(alive, "node"), "join-alive")
    # An original that others were made from has few tokens of its own, so it becomes the hub of its tokens.
    hubs = shared_alive.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("lonely", "n", "node")).alias("hub")).filter(F.col("k") > 1)
    buckets = shared_alive.select("token", "node", "n").join(hubs.select("token", "k", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "token")
    buckets = stage(buckets.filter(F.col("node") != F.col("hub")), "join-buckets")
    met = stage(buckets.select("hub", "hub_n", "node", "n").distinct(), "join-met")
    unstage(shared)
    unstage(shared_alive)
    unstage(wide)

    def long_enough(short, long):
        return 100 * F.least(short, long) >= percent * F.greatest(short, long)

    active = nodes.join(met.select("node").union(met.select("hub")).distinct(), "node", "left_semi").select("node", "s", "n", "id")
    active = stage(active, "join-active")
    chosen = texts.join(active.select("id").distinct(), texts["id"].eqNullSafe(active["id"]), "left_semi")
    sets = _sets(chosen, classes, n, percent).groupBy("s").agg(*(F.first(c).alias(c) for c in ("tokens", "first", "second")))
    sets = stage(active.select("node", "s", "n").join(sets, "s").drop("s"), "join-sets")

    hubs = met.filter(long_enough(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    links = stage(_verified(hubs, sets, percent), "join-links")
    parts = components(links)

    # Pairs of small buckets, one node of each component against the others', are compared as they are.
    labelled = buckets.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    few = labelled.filter(F.col("k") <= BUCKET).select("token", "node", "n", "part")
    mixed = few.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("token")
    few = few.join(mixed, "token")
    x, y = (few.select("token", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "part"))) for side in "xy")
    apart = (F.col("x_node") < F.col("y_node")) & (F.col("x_part") != F.col("y_part")) & long_enough(F.col("x_n"), F.col("y_n"))
    small = stage(x.join(y, "token").filter(apart).select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct(), "join-small")

    # In larger ones, the hubs of a component give way to the one that most nodes meet.
    large = buckets.filter(F.col("k") > BUCKET).select("hub", "hub_n", "node", "n").distinct()
    led = large.groupBy("hub", "hub_n").count().join(parts.withColumnRenamed("node", "hub"), "hub", "left")
    led = stage(led.select("hub", "hub_n", "count", F.coalesce("component", "hub").alias("hub_part")), "join-led")
    chief = led.groupBy("hub_part").agg(F.max(F.struct("count", "hub", "hub_n")).alias("chief")).select("hub_part", "chief.hub", "chief.hub_n")
    follow = led.select(F.col("hub").alias("old"), "hub_part").join(chief, "hub_part")
    placed = large.select(F.col("hub").alias("old"), "node", "n").join(follow, "old").drop("old").filter(F.col("node") != F.col("hub")).distinct()
    placed = placed.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    placed = stage(placed.withColumn("main", F.col("part") == F.col("hub_part")), "join-placed")
    # Only nodes outside their chief's component can still have a link to find: with the chief, or with another of its nodes.
    others = placed.filter(~F.col("main"))
    direct = others.filter(long_enough(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    differ = _differences(placed.join(others.select("hub").distinct(), "hub", "left_semi"), sets, percent)
    rows = _by_token(differ)
    x, y = (rows.select("hub", "token", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "part", "main", "d", "linked", "core", "rank"))) for side in "xy")
    near = (100 + percent) * F.abs(F.col("x_d") - F.col("y_d")) <= (100 - percent) * (F.col("x_n") + F.col("y_n"))
    meet = (F.col("x_core") | F.col("y_linked")) & (F.col("y_core") | F.col("x_linked"))
    # If a token is the first that two differences share, they share no more than what follows in each.
    most = F.least(F.col("x_d") - F.col("x_rank"), F.col("y_d") - F.col("y_rank"))
    enough = 2 * (100 + percent) * most >= (100 + percent) * (F.col("x_d") + F.col("y_d")) - (100 - percent) * (F.col("x_n") + F.col("y_n"))
    once = (F.col("y_main") | (F.col("x_node") < F.col("y_node"))) & (F.col("x_part") != F.col("y_part"))
    rest = x.filter("not x_main").join(y, ["hub", "token"]).filter(meet & enough & once & near & long_enough(F.col("x_n"), F.col("y_n")))
    rest = rest.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).unionByName(direct).unionByName(small)
    rest = stage(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "join-rest")
    more = stage(_verified(rest, sets, percent), "join-links")
    if not more.isEmpty():
        parts = components(links.unionByName(more))
    for done in (buckets, met, active, small, led, placed, differ, rest, sets):
        unstage(done)

    ids = nodes.select("node", "s", "id").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    least = ids.groupBy("part").agg(F.min("id").alias("component_id"))
    named = ids.select("s", "part").join(least, "part").select("s", "component_id")
    out = signed.select("id", "n", "s").join(named, "s", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("s").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component, with their columns; rows that share an id go together."""
    found = ngram_components(docs, n, percent, id_col, text_col)
    kept = found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept"]), "left_semi")


def query(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"))


SQL = None
