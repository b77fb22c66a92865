"""Near-duplicate classes by ProbMinHash.

Texts are sketched as weighted shingles (weight 1 + ln of how often a text has
one), and once more with all weights 1, as pairs may be alike by either similarity;
signatures are cut into bands. Texts with a band in common meet in its
bucket. There each is compared only with one leader: the member with the
most company in all its buckets, near to which a group of copies lies. Pairs are
verified by their exact probability Jaccard similarity, or the plain one where
that is higher, links joined into components. Nobody ever forms all
pairs of a bucket, and no bucket is gathered in one task.

Leaders alone could miss a link between two other members. So what buckets with
several classes hold is joined once more, exactly, by prefix filtering. If the
shares a and b of two texts' weights are not in common, their similarity is at most
(1 - a)(1 - b) / (1 - ab), by Jensen's inequality, and for plain sets just that.
Shingles are ordered from rare to frequent, so before the first common one only what
is not in common lies. Only texts of different classes are compared that have a
shingle in common where the shares before it still allow for the threshold; a passage that many texts
share is not rare, and does not bring them together. Texts do not meet one by one but in blocks
of some hundred: those of a large class are cut into blocks, all others go with the texts that
have their least common shingle, as like texts mostly do. A text meets a block by the least shares
that any of its texts has.

Joins on keys that many rows may share are salted: the grouped side says which
salts its rows have, and is copied to these only, never to more than there are rows.

Texts are known by a 128-bit digest, so exact copies are one text from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from papyra.llm.common import checkpointed, map_batches, out
from papyra.llm.shingles import Block, _odd, jaccard, mixed, probability_jaccard, probminhash, weighted_shingles


@dataclass(frozen=True)
class Settings:
    """A pair as similar as threshold shares a band but for a chance of (1 - threshold ** rows) ** bands: 7 in 100,000."""

    shingle: int = 5
    threshold: float = 0.8
    bands: int = 24
    rows: int = 5


#: Bits for each text of the filter that keeps texts without company out of the verification, and what it has at least and at most (128 MB, by which some 100 million texts with company are told from others).
FILTER_PER_TEXT, LEAST_FILTER, MOST_FILTER = 10, 1 << 15, 1 << 30
#: Places that the pairs of one leader are dealt to; each that has some gets a copy of its text.
LEADER_PLACES = 256
#: Slots that shingles are counted in, for their order from rare to frequent; a fixed size, whatever the corpus.
SLOTS = 1 << 22
#: Texts and bytes of texts that a block has about; and places that the texts to compare with one are dealt to.
BLOCK_TEXTS, BLOCK_BYTES, BLOCK_PLACES = 512, 2 << 20, 16
#: Texts with a shingle in common above which its rows are dealt to several places.
SHINGLE_TEXTS = 1000
#: Places that the rows of one key are dealt to in salted joins, a bit of a long for each.
SALTS = 64
#: For rounding, in bounds of similarities.
SLACK = 1e-6


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def digest_of(text: Column) -> Column:
    """digest() of a text column; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _salts(column: str) -> Column:
    """Of a group: the salts that its rows have, by the column that sets them apart."""
    return F.expr(f"bit_or(shiftleft(1L, CAST(pmod(xxhash64(`{column}`), {SALTS}) AS INT)))").alias("salts")


def _salted_join(rows: DataFrame, groups: DataFrame, by: str, apart: str, how: str = "inner") -> DataFrame:
    """rows joined with groups, one row for each value of by with its _salts(apart); no task has all rows of a value."""
    places = F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1))
    return rows.withColumn("salt", _salt(apart)).join(groups.withColumn("salt", places).drop("salts"), [by, "salt"], how).drop("salt")


def _weighted(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    of, hashes, counts = weighted_shingles(texts, size)
    return of, hashes, 1 + np.log(counts)


def sketch(df: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """key, node (digest of the text), buckets (one for each band of the weighted and of the plain signature; none for a text without words)."""
    bands, rows = settings.bands, settings.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, numbers = _odd(3, rows), np.arange(bands, dtype=np.uint64)
        for batch in batches:
            texts = [(v.as_py() or "").encode("utf-8", "surrogatepass") for v in batch.column(1)]
            of, hashes, weights = _weighted(texts, settings.shingle)
            found = []
            for first, by in ((0, weights), (bands, np.ones(len(weights)))):
                signature = probminhash(of, hashes, by, len(texts), bands * rows).reshape(-1, bands, rows)
                found.append(mixed((signature * factors).sum(axis=2, dtype=np.uint64) + numbers + np.uint64(first)).astype(np.int64))
            buckets = np.concatenate(found, axis=1)
            full = np.zeros(len(texts), dtype=bool)
            full[of] = True
            offsets = np.concatenate([[0], np.cumsum(full * buckets.shape[1])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(buckets[full].ravel()))
            yield out([key, "node", "buckets"], [batch.column(0), pa.array([digest(t) for t in texts], pa.binary()), lists])

    return map_batches(df.select(key, text), run, f"`{key}` {df.schema[key].dataType.simpleString()}, node binary, buckets array<long>")


def filter_bits(nodes: int) -> int:
    """How many bits a filter of so many nodes has: a power of two."""
    return min(MOST_FILTER, max(LEAST_FILTER, 1 << (FILTER_PER_TEXT * nodes).bit_length()))


def _may_have(bits: np.ndarray, node: bytes) -> bool:
    """Whether the filter may have the node."""
    places = [int.from_bytes(node[i : i + 4], "big") % (8 * len(bits)) for i in (0, 4, 8)]
    return all(bits[p >> 3] >> (p & 7) & 1 for p in places)


def _filter(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of the nodes, in bytes; what comes to the driver is a bitmap for each 32,768 bits."""
    size = filter_bits(nodes.count())
    places = nodes.select(F.explode(F.array(*[F.expr(f"conv(hex(substring(node, {1 + 4 * i}, 4)), 16, 10)").cast("long") % size + 1 for i in range(3)])).alias("place"))
    table = places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).toArrow()
    found = np.zeros((size >> 15, 4096), dtype=np.uint8)
    for bucket, bits in zip(table["bucket"].to_pylist(), table["bits"], strict=True):
        found[bucket - 1] = np.frombuffer(bits.as_py(), dtype=np.uint8)
    return found.ravel()


def _texts_of(df: DataFrame, text: str, nodes: DataFrame) -> DataFrame:
    """node and text of the nodes, and of few others."""
    shared = df.sparkSession.sparkContext.broadcast(_filter(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            keys, texts = [], []
            for v in batch.column(0):
                data = (v.as_py() or "").encode("utf-8", "surrogatepass")
                node = digest(data)
                if node not in seen and _may_have(bits, node):
                    seen.add(node)
                    keys.append(node)
                    texts.append(data)
            if keys:
                yield out(["node", "data"], [pa.array(keys, pa.binary()), pa.array(texts, pa.binary())])

    return map_batches(df.select(text), run, "node binary, data binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Those of the pairs (node, leader) whose texts are similar enough. A leader of many is copied to several places."""
    spread = pairs.withColumn("place", F.pmod(F.xxhash64("node"), F.lit(LEADER_PLACES)).cast("int"))
    members = spread.join(texts, "node").withColumnRenamed("data", "data_a")
    leaders = spread.select("leader", "place").distinct().join(texts.select(F.col("node").alias("leader"), F.col("data").alias("data_b")), "leader")
    both = members.join(leaders, ["leader", "place"]).select("node", "leader", "data_a", "data_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, known = None, None
        for batch in batches:
            nodes, heads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own = [v.as_py() for v in batch.column(2)]
            of, hashes, weights = _weighted(own, settings.shingle)
            cuts = np.searchsorted(of, np.arange(len(own) + 1))
            a, b = [], []
            for i, (node, head) in enumerate(zip(nodes, heads, strict=True)):
                if head != leader:
                    leader, known = head, _weighted([batch.column(3)[i].as_py()], settings.shingle)[1:]
                part = slice(cuts[i], cuts[i + 1])
                if probability_jaccard(hashes[part], weights[part], *known) >= settings.threshold or jaccard(hashes[part], known[0]) >= settings.threshold:
                    a.append(node)
                    b.append(head)
            if a:
                yield out(["a", "b"], [pa.array(a, pa.binary()), pa.array(b, pa.binary())])

    return map_batches(both, run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node of its component, for all nodes of the edges (a, b); labels spread to neighbours and then along themselves.

    The neighbours of one node are dealt to many tasks. Members of one label meet its next one in a plain
    join, straight before a checkpoint, where Spark splits partitions that are too large.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label"), _salts("b")))
    while True:
        near = _salted_join(both, labels.withColumnRenamed("node", "b"), "b", "a").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), "label", "salts")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = checkpointed(step.join(jump, "next").select("node", F.least("next", "far").alias("label"), "salts", (F.least("next", "far") != F.col("label")).alias("moved")))
        labels = step.drop("moved")
        if step.where("moved").isEmpty():
            return labels.drop("salts")


def _labelled(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members with the label of their component, or themselves as label."""
    return checkpointed(members.join(components(edges), "node", "left").select("node", F.coalesce("label", "node").alias("label")))


def _with_leaders(rows: DataFrame) -> DataFrame:
    """Pairs (node, leader) of the buckets."""
    leaders = rows.groupBy("bucket").agg(F.max_by("node", F.struct("score", "node")).alias("leader"), _salts("node"))
    return _salted_join(rows, leaders, "bucket", "node").where(F.col("node") != F.col("leader")).select("node", "leader").distinct()


def _frequencies(texts: DataFrame, settings: Settings) -> np.ndarray:
    """How frequent the shingles of each slot are, as a byte: 0 for those of one text, else 8 times the binary logarithm of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            counts += np.bincount((_weighted([v.as_py() for v in batch.column(0)], settings.shingle)[1] % SLOTS).astype(np.int64), minlength=SLOTS)
        for slots in np.array_split(np.flatnonzero(counts), 16):
            if len(slots):
                yield out(["slot", "n"], [pa.array(slots), pa.array(counts[slots])])

    counts = map_batches(texts.select("data"), run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    levels = counts.selectExpr("slot DIV 8 AS word", "shiftleft(CAST(least(round(8 * log2(n)), 255) AS BIGINT), CAST(8 * (slot % 8) AS INT)) AS bits")
    table = levels.groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    found = np.zeros(SLOTS // 8, dtype="<i8")
    found[table["word"].to_numpy()] = table["bits"].to_numpy()
    return found.view(np.uint8)


def prefixes(of: np.ndarray, hashes: np.ndarray, weights: np.ndarray, frequency: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the shingles, from rare to frequent, before which no more lies than the threshold leaves: with these shares of their text's weight and of its number of shingles."""
    order = np.lexsort((hashes, frequency, of))
    first = np.flatnonzero(np.diff(of[order], prepend=-1))
    sizes, shares = np.diff(np.append(first, len(order))), []
    for values in (weights[order], np.ones(len(order))):
        before = np.cumsum(values) - values
        total = np.add.reduceat(values, first) if len(first) else values
        shares.append((before - np.repeat(before[first], sizes)) / np.repeat(total, sizes))
    kept = np.minimum(*shares) <= 1 - threshold + SLACK
    return order[kept], shares[0][kept], shares[1][kept]


def _blocks(texts: DataFrame, frequencies, settings: Settings) -> DataFrame:
    """texts (node, label, data) that have a shingle in common with others, with the block of each and the number of texts that its blocks have.

    A label of several blocks has its own ones; texts of other labels go with those that have their least common shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = frequencies.value
        for batch in batches:
            texts = [v.as_py() for v in batch.column(1)]
            of, hashes, _ = _weighted(texts, settings.shingle)
            common = levels[(hashes % SLOTS).astype(np.int64)] > 0
            of, least = of[common], mixed(hashes[common])
            first = np.flatnonzero(np.diff(of, prepend=-1))
            if len(first):
                rows = pa.array(of[first])
                size = pa.array([len(t) for t in texts], pa.int64())
                yield out(["node", "size", "least"], [batch.column(0).take(rows), size.take(rows), pa.array(np.minimum.reduceat(least, first).astype(np.int64))])

    parts = F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("size") / BLOCK_BYTES)).alias("parts")
    homes = map_batches(texts.select("node", "data"), run, "node binary, size long, least long")
    homes = checkpointed(homes.join(texts.select("node", "label"), "node"))
    large = homes.groupBy("label").agg(parts, _salts("node")).where("parts > 1").select("label", F.lit(True).alias("large"), "salts")
    homes = _salted_join(homes, large, "label", "node", "left").withColumn("home", F.expr("CASE WHEN large THEN xxhash64(label) ELSE least END")).select("node", "size", "home")
    groups = homes.groupBy("home").agg(parts, F.count("*").alias("n"), _salts("node"))
    homes = _salted_join(homes, groups, "home", "node").select("node", F.expr("xxhash64(home, pmod(xxhash64(node, 1), parts))").alias("block"), F.expr("n DIV parts").alias("held"))
    return texts.join(homes, "node")


def _rest(rows: DataFrame, texts: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) between different labels, among texts of buckets with several; no such link is left out.

    A text is compared with a block if one of its shingles lets some text of the block be similar enough.
    """
    known = rows.join(labels, "node")
    several = known.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("several"), _salts("node")).where("several").select("bucket", "salts")
    open_nodes = _salted_join(known, several, "bucket", "node").select("node", "label").distinct()
    open_texts = checkpointed(texts.join(open_nodes, "node").select("node", "label", "data"))
    shared = rows.sparkSession.sparkContext.broadcast(_frequencies(open_texts, settings))
    open_texts = checkpointed(_blocks(open_texts, shared, settings))
    asked = checkpointed(_asked(open_texts, shared, settings))
    return _compared(asked, open_texts, settings)


def _asked(texts: DataFrame, frequencies, settings: Settings) -> DataFrame:
    """node, label and block: which blocks the texts (node, label, data, block, held) are to be compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = frequencies.value
        for batch in batches:
            of, hashes, weights = _weighted([v.as_py() for v in batch.column("data")], settings.shingle)
            frequency = levels[(hashes % SLOTS).astype(np.int64)]
            at, by_weight, by_count = prefixes(of, hashes, weights, frequency, settings.threshold)
            places = np.maximum(1, (2.0 ** (frequency[at] / 8) / SHINGLE_TEXTS).astype(np.int64))
            for part in np.array_split(np.flatnonzero(frequency[at] > 0), -(-len(at) // 100_000) or 1):
                row = pa.array(of[at[part]])
                own = ["node", "label", "block", "held"]
                yield out(["shingle", "places", *own, "by_weight", "by_count"], [pa.array(hashes[at[part]].astype(np.int64)), pa.array(places[part]), *(batch.column(c).take(row) for c in own), pa.array(by_weight[part]), pa.array(by_count[part])])

    postings = checkpointed(map_batches(texts, run, "shingle long, places long, node binary, label binary, block long, held long, by_weight double, by_count double"))
    of_blocks = postings.groupBy("shingle", "places", "block", "held").agg(F.min("by_weight").alias("by_weight"), F.min("by_count").alias("by_count"), F.min("label").alias("least"), F.max("label").alias("most"))
    x = postings.withColumn("place", F.expr("pmod(xxhash64(node), places)")).alias("x")
    y = of_blocks.withColumn("place", F.explode(F.expr("sequence(0L, places - 1)"))).alias("y")
    allowed = " OR ".join(f"(1 - x.{c}) * (1 - y.{c}) >= {settings.threshold - SLACK} * (1 - x.{c} * y.{c})" for c in ("by_weight", "by_count"))
    # Of two blocks the texts of the smaller one ask; a block of one label is of no use to it.
    turn = "(x.held < y.held OR x.held = y.held AND x.block <= y.block) AND (y.least != x.label OR y.most != x.label)"
    return x.join(y, F.expr(f"x.shingle = y.shingle AND x.place = y.place AND {turn} AND ({allowed})")).select("x.node", "x.label", "y.block").distinct()


def _compared(asked: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) of the nodes asked (node, label, block) with texts of that block that have another label.

    A task holds one block at a time; the texts to compare with it stream past, dealt to several places.
    """
    asked = asked.withColumn("place", F.expr(f"pmod(xxhash64(node), {BLOCK_PLACES})"))
    asking = asked.join(texts.select("node", "data"), "node").withColumn("asks", F.lit(True))
    held = asked.select("block", "place").distinct().join(texts.select("block", "node", "label", "data"), "block").withColumn("asks", F.lit(False))
    columns = ["block", "place", "asks", "node", "label", "data"]
    both = held.select(columns).unionByName(asking.select(columns)).repartition("block", "place").sortWithinPartitions("block", "place", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, members, block = None, [], None
        for batch in batches:
            texts = [v.as_py() for v in batch.column("data")]
            of, hashes, weights = _weighted(texts, settings.shingle)
            cuts = np.searchsorted(of, np.arange(len(texts) + 1))
            a, b = [], []
            for i, (*key, asks, node, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in columns[:5]), strict=True)):
                if key != current:
                    current, members, block = key, [], None
                own = hashes[cuts[i] : cuts[i + 1]], weights[cuts[i] : cuts[i + 1]]
                if not asks:
                    members.append((node, label, *own))
                    continue
                block = block or Block(*([m[k] for m in members] for k in (2, 3)))
                for j in block.alike(*own, settings.threshold):
                    if members[j][1] != label:
                        a.append(node)
                        b.append(members[j][0])
            if a:
                yield out(["a", "b"], [pa.array(a, pa.binary()), pa.array(b, pa.binary())])

    return map_batches(both, run, "a binary, b binary")


def _classified(df: DataFrame, key: str, text: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """key, node and place (a number of its task) of all rows; and node, label of its class, copies, least (key of its rows) and salts (by place) of all texts."""
    sketched = checkpointed(sketch(df, key, text, settings).withColumn("place", F.spark_partition_id()))
    nodes = sketched.groupBy("node").agg(F.min(key).alias("least"), F.count("*").alias("copies"), F.max("buckets").alias("buckets"), _salts("place"))
    rows = nodes.select("node", F.explode("buckets").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), _salts("node")).where("n > 1")
    rows = checkpointed(_salted_join(rows, sizes, "bucket", "node"))
    rows = checkpointed(rows.join(rows.groupBy("node").agg(F.sum("n").alias("score")), "node").select("bucket", "node", "score"))
    members = checkpointed(rows.select("node").distinct())
    texts = checkpointed(_texts_of(df, text, members))
    edges = checkpointed(_verified(checkpointed(_with_leaders(rows)), texts, settings))
    labels = _labelled(members, edges)
    found = checkpointed(_rest(rows, texts, labels, settings))
    if not found.isEmpty():
        labels = _labelled(members, edges.unionByName(found))
    return sketched, checkpointed(nodes.drop("buckets").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of df: key, class_id, class_size (rows in the class).

    class_id is the least key of the class. Where keys are repeated or null, so
    that classes would have one name, the first of them by digest keeps it and
    the others get a negative number made of theirs. Null texts count as empty.
    Texts without words are alike only if equal; a text of fewer than five words
    has one shingle, itself. Equal texts are always of one class, whatever their
    keys, and repeated rows stay. An empty table gives an empty one; further
    columns are not read.
    """
    sketched, named = _classified(df, key, text, settings)
    classes = named.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), _salts("node"))
    classes = classes.withColumn("name", F.xxhash64("class_id"))
    owners = classes.groupBy("name").agg(F.min("label").alias("owner"), F.count("*").alias("n"), _salts("label")).where("n > 1").drop("n")
    kind = df.schema[key].dataType
    if isinstance(kind, IntegralType):
        classes, other = classes.withColumn("class_id", F.col("class_id").cast("long")), F.expr("-1 - abs(shiftright(xxhash64(label), 1))")
    else:
        other = F.hex("label") if isinstance(kind, StringType) else F.col("class_id")
    classes = _salted_join(classes, owners, "name", "label", "left").withColumn("class_id", F.when(F.col("owner") != F.col("label"), other).otherwise(F.col("class_id")))
    of = _salted_join(named.select("node", "label", F.col("salts").alias("places")), classes.select("label", "class_id", "class_size", "salts"), "label", "node")
    of = of.select("node", "class_id", "class_size", F.col("places").alias("salts"))
    return _salted_join(sketched.select(key, "node", "place"), of, "node", "place").select(key, "class_id", "class_size")


def _first_rows(df: DataFrame, key: str, text: str, nodes: DataFrame) -> DataFrame:
    """Rows of df with texts of the nodes, and few others; of rows with equal key and text, one for each task but for some."""
    shared = df.sparkSession.sparkContext.broadcast(_filter(nodes))
    names = df.columns
    at, of = names.index(text), names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            rows = []
            for i, (k, v) in enumerate(zip(batch.column(of), batch.column(at), strict=True)):
                node = digest((v.as_py() or "").encode("utf-8", "surrogatepass"))
                if _may_have(shared.value, node) and (row := (node, str(k.as_py()))) not in seen:
                    seen.add(row)
                    rows.append(i)
            if len(seen) > 200_000:
                seen.clear()
            if rows:
                yield batch.take(pa.array(rows))

    return map_batches(df, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


def first_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row of df for each class, all its columns: that with the least key (null after all others), of equal keys that with the least digest, of rows that repeat both any one."""
    sketched, named = _classified(df, key, text, settings)
    first = F.min(F.struct(F.col("least").isNull().alias("no"), "least", "node")).alias("first")
    kept = checkpointed(named.groupBy("label").agg(first).select(F.col("first.node").alias("node"), F.xxhash64("first.least").alias("of")))
    repeated = sketched.select("node", F.xxhash64(key).alias("of")).groupBy("node", "of").count().where("count > 1").drop("count")
    repeated = checkpointed(repeated.join(kept, ["node", "of"]))
    node, of = (next(n for n in (f"{name}{'_' * i}" for i in range(len(df.columns) + 1)) if n not in df.columns) for name in ("node", "of"))
    known = lambda rows: rows.withColumns({node: digest_of(F.col(text)), of: F.xxhash64(key)})
    only = lambda names: names.select(F.col("node").alias(node), F.col("of").alias(of))
    rows = known(df).join(only(kept.join(repeated, ["node", "of"], "left_anti")), [node, of], "left_semi")
    if not repeated.isEmpty():
        again = known(_first_rows(df, key, text, repeated.select("node"))).join(only(repeated), [node, of], "left_semi")
        rows = rows.unionByName(again.dropDuplicates([node, of]))
    return rows.select(df.columns)
