"""Hard negatives by one-dimensional distance keys, exactly.

Vectors get one more component, so that all have one length; then a larger inner
product is a smaller distance to a query. Each row belongs to its nearest pivot, and rows
are stored sorted by pivot and distance to it, in blocks. A block whose keys lie
between low and high has, by the triangle inequality, no row nearer to a query
than the distance of its own key from that interval. So a query looks first at the
blocks around its own keys, then at wider and wider intervals of keys, until what
is left cannot hold a score among its best: the bound certifies the result.

Where a query wants only scores up to a cap, rows nearer than that are of no
use, and it searches the annulus outside of them.

Queries go in groups, a group meets a block once, and of each block only its best
rows leave the task, so neither copies nor labels of many rows gather anywhere.

Defined cases: a row takes no part if its key, label or vector is null or a component is
null or not finite. Shorter vectors count as if zeros followed. Rows of one key are
rows of their own: each is an anchor if its key makes it one, no positive of itself
but one of the others; they are ties in all that is sorted. Scores are whole numbers; beyond 64 bits they count as the largest or smallest long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm.common import checkpointed, map_batches, out

#: Inner products below this are exact in doubles.
EXACT = float(1 << 53)
LONG = (-(1 << 63), (1 << 63) - 1)


@dataclass(frozen=True)
class Settings:
    """Every anchor_every-th key is an anchor; keys divisible by noisy_every have the next label. Negatives score between low and high hundredths of their positive.

    Up to pivots are chosen from a sample of rows, as many as have eight full blocks on average. A block has block_rows rows at least, more where there
    would be over most_blocks. first: blocks that a query looks at to begin with, widening: times as many in each round.
    """

    anchor_every: int = 100
    noisy_every: int = 7
    labels: int = 10
    scale: int = 256
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    pivots: int = 32
    sample: int = 4096
    block_rows: int = 1024
    most_blocks: int = 16_384
    first: int = 4
    widening: int = 8


def prepared(df: DataFrame, settings: Settings) -> DataFrame:
    """row (a number of its own), vec_id, label and vector, whole numbers in doubles, of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % settings.noisy_every == 0, (F.col("label") + 1) % settings.labels).otherwise(F.col("label"))
    rows = df.select("vec_id", "label", "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite)
    scaled = F.transform("embedding", lambda x: x.cast("double") * settings.scale)
    # Doubles beyond 53 bits are whole already.
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    return checkpointed(rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("vector")))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """A row for each vector, filled up with zeros."""
    sizes = vectors.value_lengths().to_numpy()
    found = np.zeros((len(vectors), int(sizes.max(initial=0))))
    found[np.arange(found.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy()
    return found


def _fitted(matrix: np.ndarray, width: int) -> np.ndarray:
    """With so many columns: cut or filled up with zeros."""
    return matrix[:, :width] if matrix.shape[1] >= width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


@dataclass(frozen=True)
class Index:
    """Blocks of rows by pivot and key, and what queries need to know of them: pivots (one a row, the added component last), the squared length of all vectors, and of each block its number, pivot and interval of keys."""

    blocks: DataFrame
    pivots: np.ndarray
    square: float
    directory: dict[str, np.ndarray]

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query and block: scores below which and above which none of the block lies."""
        own = (queries**2).sum(axis=1)
        places = _fitted(self.pivots[:, :-1], queries.shape[1])
        from_pivots = np.sqrt(np.maximum(own[:, None] + (self.pivots**2).sum(axis=1) - 2 * queries @ places.T, 0))[:, self.directory["pivot"]]
        low, high = self.directory["low"], self.directory["high"]
        nearest = np.maximum(np.maximum(low - from_pivots, from_pivots - high), 0)
        slack = 1 + 1e-6 * (own[:, None] + self.square)
        return (own[:, None] + self.square - (from_pivots + high) ** 2) / 2 - slack, (own[:, None] + self.square - nearest**2) / 2 + slack


def _lengthened(matrix: np.ndarray, square: float) -> np.ndarray:
    return np.hstack([matrix, np.sqrt(np.maximum(square - (matrix**2).sum(axis=1), 0))[:, None]])


def _pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Centres of the sample's different rows, by a few rounds of k-means from some of them."""
    sample = np.unique(sample, axis=0)
    found = sample[np.linspace(0, len(sample) - 1, min(most, len(sample))).astype(int)]
    for _ in range(5):
        near = np.argmin((found**2).sum(axis=1) - 2 * sample @ found.T, axis=1)
        found = np.stack([sample[near == i].mean(axis=0) if (near == i).any() else found[i] for i in range(len(found))])
    return found


def indexed(rows: DataFrame, settings: Settings) -> Index:
    """The index of prepared() rows; none may be empty."""
    facts = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("square"), F.max(F.size("vector")).alias("width")).first()
    share = int(min(1.0, settings.sample / facts["n"]) * (1 << 32))
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 32)) <= share).select("vector").toArrow()["vector"].combine_chunks()
    sample = _matrix(sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample) if len(sample) else np.zeros((1, 1))
    square, width = float(facts["square"]), int(facts["width"])
    size = max(settings.block_rows, -(-facts["n"] // settings.most_blocks))
    pivots = _pivots(_lengthened(_fitted(sample, width), square), min(settings.pivots, max(1, facts["n"] // (8 * size))))
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, matrix = shared.value, _lengthened(_fitted(_matrix(batch["vector"]), width), square)
            squares = (matrix**2).sum(axis=1)[:, None] + (places**2).sum(axis=1) - 2 * matrix @ places.T
            near = np.argmin(squares, axis=1)
            yield out([*batch.schema.names, "pivot", "key"], [*batch.columns, pa.array(near.astype(np.int32)), pa.array(np.sqrt(np.maximum(squares[np.arange(len(near)), near], 0)))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            pivot = batch["pivot"].to_numpy()
            for part in np.split(np.arange(len(pivot)), np.flatnonzero(np.diff(pivot)) + 1):
                first, end = int(part[0]), int(part[-1]) + 1
                while first < end:
                    if held and (held[0]["pivot"][0].as_py() != pivot[first] or sum(map(len, held)) >= size):
                        yield block(held)
                        held = []
                    most = min(end - first, size - sum(map(len, held)))
                    held.append(batch.slice(first, most))
                    first += most
        if held:
            yield block(held)

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).sort_by([("vec_id", "ascending"), ("row", "ascending")]).combine_chunks()
        matrix, keys, rows = _matrix(table["vector"].chunk(0)), table["key"].to_numpy(), table["row"].to_numpy()
        lists = [pa.array([table[c].to_numpy()], pa.list_(pa.int64())) for c in ("row", "vec_id", "label")]
        return out(["block", "pivot", "low", "high", "width", "rows", "ids", "labels", "data"], [pa.array([rows.min()]), table["pivot"].chunk(0)[:1], pa.array([keys.min()]), pa.array([keys.max()]), pa.array([matrix.shape[1]], pa.int32()), *lists, pa.array([matrix.tobytes()], pa.binary())])

    with_keys = map_batches(rows, keyed, "row long, vec_id long, label long, vector array<double>, pivot int, key double")
    order = ("pivot", "key", "row")
    blocks = map_batches(with_keys.repartitionByRange(*order).sortWithinPartitions(*order), cut, "block long, pivot int, low double, high double, width int, rows array<long>, ids array<long>, labels array<long>, data binary")
    blocks = checkpointed(blocks)
    known = blocks.select("block", "pivot", "low", "high").toArrow().sort_by("block")
    return Index(blocks, pivots, square, {c: known[c].to_numpy() for c in known.column_names})


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products as longs."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if np.sqrt((a**2).sum(axis=1).max(initial=0) * (b**2).sum(axis=1).max(initial=0)) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.array([[min(max(sum(x * y for x, y in zip(r, c, strict=True)), LONG[0]), LONG[1]) for c in whole(b)] for r in whole(a)], dtype=np.int64).reshape(len(a), len(b))


def _best(scores: np.ndarray, sound: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the most highest sound scores of each row, of equal ones the first columns."""
    most = min(most, scores.shape[1])
    held = np.where(sound, scores, LONG[0])
    least = np.partition(held, held.shape[1] - most, axis=1)[:, held.shape[1] - most]
    at, column = np.nonzero(sound & (held >= least[:, None]))
    order = np.lexsort((column, ~scores[at, column], at))
    at, column = at[order], column[order]
    first = np.searchsorted(at, at)
    kept = np.arange(len(at)) - first < most
    return at[kept], column[kept]


_QUERY = "query long, self long, label long, same boolean, cap long, least long, vector array<double>"
_HIT = "struct<less:long,id:long,row:long>"


def nearest(index: Index, queries: DataFrame, most: int, settings: Settings) -> DataFrame:
    """query and best, at most so many hits in order, of queries (query, self, label, same, cap, least, vector).

    A hit is a row of the same label as the query, or another where same is false, but not self, with a score of least to cap: less (a complement of
    the score), id (its key), row. Rounds go on until no unseen block can have a better one.
    """
    spark: SparkSession = queries.sparkSession
    shared: Broadcast = spark.sparkContext.broadcast((index.pivots, index.square, index.directory))
    state = checkpointed(queries.withColumns({"seen": F.lit(0), "best": F.array().cast(f"array<{_HIT}>")}))
    found = None

    def wanted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The queries, each one's blocks from the most promising on, how many may matter, and the least score that does."""
        known = Index(None, *shared.value)
        matrix = _matrix(batch["vector"])
        below, above = known.bounds(matrix)
        last = [hits[-1]["less"] if len(hits) == most else None for hits in batch["best"].to_pylist()]
        least = np.maximum(batch["least"].to_numpy(), np.array([LONG[0] if x is None else ~x for x in last], dtype=np.int64))
        useful = (above >= batch["least"].to_numpy()[:, None]) & (below <= batch["cap"].to_numpy()[:, None])
        above = np.where(useful, np.minimum(above, batch["cap"].to_numpy()[:, None].astype(float)), -np.inf)
        order = np.argsort(-above, axis=1, kind="stable")
        return matrix, order, ((above >= least[:, None]) & useful).sum(axis=1), least

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix, order, needed, least = wanted(batch)
            seen = batch["seen"].to_numpy()
            upto = np.minimum(needed, np.maximum(settings.first, seen * settings.widening))
            asked: dict[int, list[int]] = {}
            for i in range(len(batch)):
                for j in order[i, seen[i] : upto[i]].tolist():
                    asked.setdefault(j, []).append(i)
            numbers = shared.value[2]["block"]
            for j, some in asked.items():
                own = batch.take(pa.array(some))
                lists = [pa.array([own[c].to_numpy()], pa.list_(pa.int64())) for c in ("query", "self", "label", "cap")]
                yield out(["block", "query", "self", "label", "cap", "least", "same", "query_width", "queries"], [pa.array([numbers[j]]), *lists, pa.array([least[some]], pa.list_(pa.int64())), pa.array([own["same"].to_pylist()]), pa.array([matrix.shape[1]], pa.int32()), pa.array([matrix[some].tobytes()], pa.binary())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                get = lambda c: batch[c].slice(i, 1).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
                a, b = (np.frombuffer(batch[c][i].as_py()).reshape(n, batch[w][i].as_py()) for c, w, n in (("queries", "query_width", len(get("query"))), ("data", "width", len(get("rows")))))
                scores = _scores(a, b)
                sound = (get("label")[:, None] == get("labels")) == get("same")[:, None]
                sound &= (scores <= get("cap")[:, None]) & (scores >= get("least")[:, None]) & (get("self")[:, None] != get("rows"))
                at, column = _best(scores, sound, most)
                if len(at):
                    yield out(["query", "less", "id", "row"], [pa.array(get("query")[at]), pa.array(~scores[at, column]), pa.array(get("ids")[column]), pa.array(get("rows")[column])])

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, needed, _ = wanted(batch)
            yield out([*batch.schema.names, "open"], [*batch.columns, pa.array(batch["seen"].to_numpy() < needed)])

    while True:
        asked = map_batches(state, ask, "block long, query array<long>, self array<long>, label array<long>, cap array<long>, least array<long>, same array<boolean>, query_width int, queries binary")
        met = map_batches(asked.join(index.blocks.drop("pivot", "low", "high"), "block"), meet, "query long, less long, id long, row long")
        hits = met.unionByName(state.select("query", F.inline("best")))
        place = F.row_number().over(Window.partitionBy("query").orderBy("less", "id", "row"))
        best = hits.withColumn("place", place).where(F.col("place") <= most).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("less", "id", "row"))).alias("best"))
        seen = F.greatest(F.lit(settings.first), F.col("seen") * settings.widening)
        state = state.drop("best").withColumn("seen", seen).join(best, "query", "left").withColumn("best", F.coalesce("best", F.array().cast(f"array<{_HIT}>")))
        state = checkpointed(map_batches(state, advance, f"{_QUERY}, seen int, best array<{_HIT}>, open boolean"))
        done = state.where("NOT open").select("query", "best")
        found = done if found is None else found.unionByName(done)
        state = state.where("open").drop("open")
        if state.isEmpty():
            return found


def mine(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor and each of its positives, its foremost rows of the same label, the foremost rows of other labels with scores in the band."""
    rows = prepared(df, settings)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([], schema)
    index = indexed(rows, settings)
    anchors = rows.where(F.col("vec_id") % settings.anchor_every == 0)
    plain = anchors.select(F.col("row").alias("query"), F.col("row").alias("self"), "label", F.lit(True).alias("same"), F.lit(LONG[1]).alias("cap"), F.lit(LONG[0]).alias("least"), "vector")
    positives = nearest(index, plain, settings.positives, settings).select("query", F.posexplode("best").alias("at", "hit"))
    positives = positives.select(F.col("query").alias("row"), (F.col("query") * settings.positives + F.col("at")).alias("query"), F.col("hit.id").alias("positive_id"), F.bitwise_not("hit.less").alias("positive_score"))
    pairs = checkpointed(positives.join(anchors, "row").withColumnRenamed("vec_id", "anchor_id"))
    # Of a positive with a score under 0 the band is empty. Whole hundreds apart, so that nothing overflows.
    part = lambda share, more: F.expr(f"(positive_score DIV 100) * {share} + ((positive_score % 100) * {share} + {more}) DIV 100")
    banded = pairs.where("positive_score >= 0").select("query", F.col("row").alias("self"), "label", F.lit(False).alias("same"), part(settings.high, 0).alias("cap"), part(settings.low, 99).alias("least"), "vector")
    negatives = nearest(index, banded, settings.negatives, settings).select("query", F.posexplode("best").alias("at", "hit"))
    shown = pairs.select("query", "anchor_id", "positive_id", "positive_score").join(negatives, "query")
    return shown.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("negative_id"), "positive_score", F.bitwise_not("hit.less").alias("negative_score"))


def sql(settings: Settings = Settings()) -> str:
    """The same for DuckDB, by comparing every anchor with every row."""
    return f"""
WITH sound AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % {settings.noisy_every} = 0 THEN (label + 1) % {settings.labels} ELSE label END AS label,
    list_transform(embedding, lambda x: floor({settings.scale} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS id, b.r AS r, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM sound a JOIN sound b ON a.vec_id % {settings.anchor_every} = 0 AND a.r <> b.r
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id, r) AS place FROM scored WHERE same
), negatives AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.place ORDER BY n.score DESC, n.id, n.r) AS rank
  FROM positives p JOIN scored n ON p.a = n.a AND NOT n.same AND p.place <= {settings.positives} AND {settings.low} * p.score <= 100 * n.score AND 100 * n.score <= {settings.high} * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= {settings.negatives}
"""
