"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full sets, and union of what is linked.

Signature: every shingle has a random permutation of the slots and, for step j, a value in [j, j + 1) that it offers to the
slot at place j of its permutation; a slot keeps the least offer. A text's steps end as soon as every slot has an offer below
the next step's. With BANDS bands of BAND_SLOTS slots, two sets of similarity 0.8 share no band with probability 3e-6 if slots are
independent. Those of very small sets are not: sets of 4 and 5 shared none in 13 of 123,500 trials (1e-4).

Texts with the same set form one node. Within a bucket (equal band) no pairs are made: every node is compared with one head,
the node that shares the most places with others, which is close to what copies were made from; what is linked becomes one
component. In buckets that still hold several components, up to SMALL nodes, the pairs of different components are compared.
The larger ones are put together by their head: there the nodes outside the largest component are the queries, compared with
all nodes in blocks. So each candidate pair is either compared or already in one component, and a large group of copies costs
about one comparison for each member. Before texts of pairs are fetched, they must agree in size and in the lowest two bits of most slots: of 256 slots a pair
of similarity 0.8 agrees in 218 on average, with a deviation of 6 at most, and ALIKE_SLOTS is more than six deviations below.
Then the full sets of 64-bit shingle hashes decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import discard, stored
from llm.graph import components

WORDS = 5
PERCENT = 80
SLOTS = 256
BAND_SLOTS = 6
BANDS = SLOTS // BAND_SLOTS
#: Pairs exactly at the limit that share no band, if slots were independent, at most.
MISSED = 3e-6
#: Slots whose lowest two bits agree, at least; for a similarity of PERCENT in a hundred.
ALIKE_SLOTS = 180
SMALL = 50
BLOCK = 1000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed random-looking permutation of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def words_lower(text: str) -> list[bytes]:
    """Words with A-Z as a-z, in UTF-8; bytes split at just the six white-space characters."""
    return text.encode().lower().split()


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of `words` words; all of a shorter text is one run; no words, none."""
    hashes = word_hashes().of(words_lower(text))
    size = min(words, len(hashes))
    if not size:
        return hashes
    runs = np.full(len(hashes) - size + 1, size, np.uint64)
    for k in range(size):
        runs = mixed(runs * _GOLDEN + hashes[k : len(hashes) - size + 1 + k])
    return np.unique(runs)


def signature(members: np.ndarray) -> np.ndarray:
    """The SuperMinHash signature of a set that isn't empty. The permutations are x -> a x + b of the slots, a odd, with a and
    b from the member's hash, so that each slot is equally likely at each place."""
    slots = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    seeds = mixed(members + _GOLDEN)
    a, b = (seeds >> np.uint64(20)) | np.uint64(1), seeds >> np.uint64(40)
    together = min(SLOTS, max(1, 2048 // len(members)))
    for first in range(0, SLOTS, together):
        step = np.arange(first, min(first + together, SLOTS), dtype=np.uint64)[:, None]
        place = (a * step + b) & np.uint64(SLOTS - 1)
        offer = (step << np.uint64(32)) | (mixed(seeds + (step + np.uint64(1)) * _GOLDEN) >> np.uint64(32))
        np.minimum.at(slots, place.ravel().astype(np.intp), offer.ravel())
        if int(slots.max()) < (int(step[-1, 0]) + 1) << 32:
            break
    return slots


def band_slots(percent: int) -> int:
    """Slots of a band, BAND_SLOTS at most, so that pairs of a similarity of percent in a hundred share one."""
    for size in range(BAND_SLOTS, 0, -1):
        if (1 - (percent / 100) ** size) ** (SLOTS // size) <= MISSED:
            return size
    raise ValueError(f"signatures of {SLOTS} slots do not find pairs of {percent} %")


def bands_of(signatures: np.ndarray, size: int = BAND_SLOTS) -> np.ndarray:
    """One 64-bit key for each band of `size` slots of each row."""
    bands = SLOTS // size
    parts = signatures[:, : bands * size].reshape(len(signatures), bands, size)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for k in range(size):
        keys = mixed(keys * _GOLDEN + parts[:, :, k])
    return keys.view(np.int64)


def low_bits(signatures: np.ndarray) -> np.ndarray:
    """The lowest bit of each slot in four numbers, then the next bit in four more."""
    bits = np.stack([(signatures >> np.uint64(k)) & np.uint64(1) for k in (0, 1)], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=2).view(np.int64).reshape(len(signatures), -1)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, words: int, size: int = BAND_SLOTS) -> DataFrame:
    """doc_id, text_key, n (size of the set), set_a and set_b (hash of the set; null for an empty one), bands, bits, of each
    row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", F.md5(text).alias("text_key"), text.alias("text"))
    kind = dict(own.dtypes)["doc_id"]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, words) for text in batch.column(2).to_pylist()]
            full = [k for k, members in enumerate(sets) if len(members)]
            keys, empty = np.zeros((len(sets), 2), np.int64), np.ones(len(sets), bool)
            bands, bits = np.zeros((len(sets), SLOTS // size), np.int64), np.zeros((len(sets), SLOTS // 32), np.int64)
            for k in full:
                keys[k] = np.frombuffer(xxhash.xxh3_128_digest(sets[k].tobytes()), np.int64)
            if full:
                signatures = np.stack([signature(sets[k]) for k in full])
                bands[full], bits[full], empty[full] = bands_of(signatures, size), low_bits(signatures), False
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (bands, bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(members) for members in sets], pa.int64()), pa.array(keys[:, 0], mask=empty), pa.array(keys[:, 1], mask=empty), *lists],
                                             ["doc_id", "text_key", "n", "set_a", "set_b", "bands", "bits"])

    return own.mapInArrow(sketched, f"doc_id {kind}, text_key string, n bigint, set_a bigint, set_b bigint, bands array<bigint>, bits array<bigint>")


def _possible(percent: int) -> Column:
    """Whether a pair with n, bits and other_n, other_bits may be alike."""
    half = SLOTS // 64
    differing = " + ".join(f"bit_count((bits[{k}] ^ other_bits[{k}]) | (bits[{half + k}] ^ other_bits[{half + k}]))" for k in range(half))
    least = ALIKE_SLOTS if percent >= PERCENT else 0  # signatures say less of lower similarities
    return F.expr(f"100 * least(n, other_n) >= {percent} * greatest(n, other_n) and {SLOTS} - ({differing}) >= {least}")


def _other(table: DataFrame, *kept: str) -> DataFrame:
    return table.select(*kept, *(F.col(c).alias(f"other_{c}") for c in table.columns if c not in kept))


def _linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs a, b whose sets are alike. texts: node, n, bits, text."""
    with_a = pairs.join(texts.withColumnRenamed("node", "a"), "a")
    others = _other(texts)
    with_b = with_a.join(others, (with_a["b"] == others["other_node"]) & _possible(percent)).select("a", "b", "text", "other_text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members = None, None
        for batch in batches:
            linked = []
            for b, text, other in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != at:
                    at, members = b, shingle_set(other.as_py(), words)
                linked.append(alike(shingle_set(text.as_py(), words), members, percent))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(linked, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return with_b.mapInArrow(compared, "a bigint, b bigint")


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs: doc_id, text; other columns are left aside. Returns a row for each row of docs: doc_id, text_key, n_shingles,
    node (null without words), component_id (the smallest doc_id of its component).

    Lower case of A-Z; words are runs of other than the six ASCII white-space characters. A null text is an empty one: no
    shingles, linked with nothing. Repeated rows have one set and so one component. Rows without doc_id link like others; if a
    component has no other rows its component_id is null. An empty table gives no rows. A percent too low for signatures (under
    5) is a ValueError."""
    rows = stored(sketches(docs, words, band_slots(percent)), "sketches")
    same_set = ["set_a", "set_b"]
    of_set = F.min_by(F.struct("text_key", "n", "bands", "bits"), "text_key").alias("of")
    nodes = rows.where("set_a is not null").groupBy(*same_set).agg(F.min("doc_id").alias("first_id"), of_set)
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), *same_set, "first_id", "of.*"), "nodes")
    each = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1")
    placed = stored(each.join(shared, "bucket").select("bucket", "node", "rows"), "placed")
    places = placed.groupBy("node").agg(F.sum("rows").alias("places"))
    heads = placed.join(places, "node").groupBy("bucket").agg(F.max_by("node", "places").alias("head"))
    members = stored(placed.join(heads, "bucket").select("bucket", "node", "rows", "head"), "members")
    discard(placed)

    # the texts of nodes that share a bucket, one row for each
    needed = nodes.join(members.select("node").distinct(), "node").select("node", "text_key", "n", "bits")
    row = F.xxhash64("doc_id").alias("row")
    one = rows.select("text_key", row).groupBy("text_key").agg(F.min("row").alias("row"))  # of equal texts; chosen before any text moves
    needed = stored(needed.join(one, "text_key"), "needed")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # joined and made single by the same columns, so that texts move once
    texts = docs.select(row, text.alias("text"), F.md5(text).alias("text_key")).join(needed, ["text_key", "row"]).dropDuplicates(["text_key", "row"])
    texts = stored(texts.select("node", "n", "bits", "text"), "texts")

    pairs = members.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    links = stored(_linked(pairs, texts, words, percent), "links")
    roots = components(links)
    split = _split_buckets(members, nodes, roots)
    if split.head(1):
        more = _linked(_all_pairs(split.where(f"rows <= {SMALL}"), percent), texts, words, percent)
        more = stored(more.union(_linked_in_blocks(split.where(f"rows > {SMALL}"), texts, words, percent)), "links")
        if more.head(1):
            roots = components(more.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    discard(split)
    discard(members)
    discard(texts)
    discard(needed)

    root = nodes.join(roots, "node", "left").select("node", *same_set, "first_id", F.coalesce("root", "node").alias("root"))
    least = root.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = root.join(least, "root").select("node", *same_set, "component_id")
    found = rows.select("doc_id", "text_key", F.col("n").alias("n_shingles"), *same_set).join(known, same_set, "left")
    return found.select("doc_id", "text_key", "n_shingles", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _split_buckets(members: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """bucket, node, rows, head, root, n, bits of the buckets whose nodes are of several components."""
    with_root = members.join(roots, "node", "left").select("bucket", "node", "rows", "head", F.coalesce("root", "node").alias("root"))
    several = with_root.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    return stored(with_root.join(several, "bucket").join(nodes.select("node", "n", "bits"), "node"), "split")


def _all_pairs(split: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that share a bucket."""
    split = split.select("bucket", "node", "root", "n", "bits")
    others = _other(split, "bucket")
    pairs = split.join(others, (split["bucket"] == others["bucket"]) & (F.col("node") > F.col("other_node")) & (F.col("root") != F.col("other_root")) & _possible(percent))
    return pairs.select(F.col("node").alias("a"), F.col("other_node").alias("b")).distinct()


def _linked_in_blocks(split: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links a, b of different components among the nodes of each head: of the nodes outside its largest component, the
    queries, with all of its nodes. Blocks of queries meet blocks of nodes; each query gives one link for each other component."""
    own = split.select("head", "node", "root").distinct()
    sizes = own.groupBy("head", "root").agg(F.count("*").alias("rows"))
    sizes = sizes.groupBy("head").agg(F.max_by("root", "rows").alias("main"), F.sum("rows").alias("all"), F.max("rows").alias("most"))
    own = own.join(sizes, "head").where("most < all")
    blocks, query_blocks = F.ceil(F.col("all") / BLOCK).cast("int"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")
    place = F.xxhash64("node")
    block, query_block = F.pmod(place, blocks).cast("int"), F.pmod(place, query_blocks).cast("int")
    nodes = own.select("head", "node", "root", F.lit(False).alias("query"), block.alias("block"), F.explode(F.sequence(F.lit(0), query_blocks - 1)).alias("query_block"))
    queries = own.where("root <> main").select("head", "node", "root", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), query_block.alias("query_block"))
    key = ["head", "block", "query_block"]
    rows = nodes.unionByName(queries).join(texts.select("node", "text"), "node").select(*key, "query", "node", "root", "text")
    rows = rows.repartition(*key).sortWithinPartitions(*key, "query")

    def links(own_nodes: list, queries: list) -> pa.RecordBatch:
        found: list[tuple[int, int]] = []
        if own_nodes and queries:
            sizes = np.array([len(members) for _, _, members in own_nodes])
            members = np.concatenate([members for _, _, members in own_nodes])
            order = np.argsort(members, kind="stable")
            members, owner = members[order], np.repeat(np.arange(len(sizes)), sizes)[order]
            roots = np.array([root for _, root, _ in own_nodes])
            for node, root, query in queries:
                low, high = np.searchsorted(members, query), np.searchsorted(members, query, side="right")
                times = high - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                both = np.bincount(owner[at], minlength=len(sizes))
                linked = np.flatnonzero((100 * both >= percent * (sizes + len(query) - both)) & (roots != root))
                found += [(node, own_nodes[k][0]) for k in linked[np.unique(roots[linked], return_index=True)[1]].tolist()]
        return pa.RecordBatch.from_arrays([pa.array([pair[k] for pair in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own_nodes, queries = None, [], []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for k, text in enumerate(batch.column(6)):
                here = tuple(column[k] for column in columns[:3])
                if here != at:
                    yield links(own_nodes, queries)
                    at, own_nodes, queries = here, [], []
                (queries if columns[3][k] else own_nodes).append((columns[4][k], columns[5][k], shingle_set(text.as_py(), words)))
        yield links(own_nodes, queries)

    return rows.mapInArrow(run, "a bigint, b bigint")


def deduplicate(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, the one of the smallest doc_id (of rows that agree in it, one), all columns as
    they are. Rows without words all stay. Rows without doc_id come last."""
    found = groups(docs, words, percent)
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_key")
    rooted = found.where("node is not null").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("node")).alias("alone")).agg(F.min(order).alias("of"))
    winners = rooted.select(F.col("of.doc_id").alias("id"), F.col("of.text_key").alias("key"))
    wordless = found.where("node is null").select("text_key").distinct()
    as_text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.md5(as_text).alias("key"))
    one = keyed.join(winners.distinct(), keyed["id"].eqNullSafe(winners["id"]) & (keyed["key"] == winners["key"])).select("row", keyed["id"], keyed["key"]).dropDuplicates(["id", "key"])
    empty = keyed.join(wordless, keyed["key"] == wordless["text_key"], "left_semi")
    return one.select("row.*").union(empty.select("row.*"))
