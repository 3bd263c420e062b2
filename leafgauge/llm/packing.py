"""Documents packed into containers of a fixed number of tokens.

Sizes are tokens of a public subword tokenizer (whole texts).  A text that exceeds one
container is cut at token positions into full containers and a rest; no other text is split.

What remains is a bin packing, solved by a grouping genetic algorithm: an individual is a set
of bins; crossover injects whole well-filled bins of one parent into the other, bins that
hold an injected item dissolve, and the items set free go by best fit.  Items are dealt to shards of bounded size by
a hash; each shard is bred on several islands, and between epochs each island's elite moves
to the next island of its shard.  The best island of a shard gives its bins.  Bins that stay
badly filled are dissolved and their items dealt to new shards for another round, so waste at
shard borders doesn't grow with the number of shards.

A task holds one shard's sizes and ids (SHARD_ITEMS), never a text or a hot source's rows.
Shards are formed by hash buckets of the id, so their size is bounded in expectation whatever
the sources or sizes of the documents.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgauge.session import cut

CAPACITY = 2048
SHARD_ITEMS = 1500
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 6
POPULATION = 6
WELL_FILLED = 0.97
SEED = 5
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer's file; a parameter of every operator here."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.cache
def _encoding(path: str):
    """A function from text to tokens, for the three kinds of files."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: model.encode(t, num_threads=1)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def count_tokens(text: str, path: str) -> int:
    """Tokens of the whole text, encoded in one pass."""
    return len(_encoding(path)(text))


def token_sizes(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens) of every document row; null and empty texts have 0 tokens.

    Repeated rows of one id with the same text count once; of differing texts the longest counts.
    """
    file = path or tokenizer_path()

    @F.pandas_udf("long")
    def sizes(texts: pd.Series) -> pd.Series:
        seen: dict[str, int] = {}
        for t in texts:
            if t and t not in seen:
                seen[t] = count_tokens(t, file)
        return pd.Series([seen.get(t, 0) if t else 0 for t in texts], dtype="int64")

    return documents.where("doc_id is not null").select("doc_id", sizes("text").alias("tokens")).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def items_of(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, token_start, size): one item a document, or the cuts of one that exceeds a container.

    Documents without tokens are items of size 0: they take no space in some container.
    """
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    start = (F.col("piece") * capacity).cast("long")
    return sizes.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece")).select("doc_id", "piece", start.alias("token_start"), F.least(F.lit(capacity), F.col("tokens") - start).cast("int").alias("size"))


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, bins: list[list[int]], loads: list[int]) -> None:
    """Place the items in this order, each into the fullest bin that takes it; bins are changed in place.

    Free space is kept by amount in buckets, so a search is over distinct amounts, not bins.
    """
    by_free: dict[int, list[int]] = {}
    has = np.zeros(capacity + 1, bool)
    for b, load in enumerate(loads):
        by_free.setdefault(capacity - load, []).append(b)
        has[capacity - load] = True
    for i in order.tolist():
        s = int(sizes[i])
        at = s + int(np.argmax(has[s:])) if s <= capacity else capacity + 1
        if at <= capacity and has[at]:
            b = by_free[at].pop()
            if not by_free[at]:
                has[at] = False
            bins[b].append(i)
            loads[b] += s
        else:
            b = len(bins)
            bins.append([i])
            loads.append(s)
        free = capacity - loads[b]
        by_free.setdefault(free, []).append(b)
        has[free] = True


def fitness(loads: list[int], capacity: int) -> float:
    """Mean square fill of the bins: fewer and fuller bins score higher."""
    f = np.array(loads) / capacity
    return float(np.mean(f * f)) if len(f) else 1.0


def _bins_of(assign: np.ndarray, sizes: np.ndarray) -> tuple[list[list[int]], list[int]]:
    order = np.argsort(assign, kind="stable")
    edges = np.flatnonzero(np.diff(assign[order])) + 1
    groups = np.split(order, edges) if len(order) else []
    return [g.tolist() for g in groups], [int(sizes[g].sum()) for g in groups]


def _assign(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for b, items in enumerate(bins):
        out[items] = b
    return out


def crossover(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject well-filled bins of ``two`` into ``one``; dissolve what they touch and best-fit what is displaced."""
    load_two = np.bincount(two, weights=sizes)
    order = np.argsort(-load_two, kind="stable")
    full = order[: max(1, int(np.sum(load_two >= WELL_FILLED * capacity)))]
    chosen = full[rng.random(len(full)) < rng.uniform(0.2, 0.6)]
    taken = np.isin(two, chosen)
    touched = np.zeros(one.max() + 1, bool)
    touched[one[taken]] = True
    load_one = np.bincount(one, weights=sizes, minlength=len(touched))
    weak = np.flatnonzero(~touched & (load_one < WELL_FILLED * capacity))
    touched[weak[rng.random(len(weak)) < 0.5]] = True  # mutation: some weak bins dissolve too
    kept = ~taken & ~touched[one]
    free = np.flatnonzero(~taken & touched[one])
    assign = np.full(len(sizes), -1, np.int64)
    assign[taken] = two[taken]
    assign[kept] = one[kept] + two.max() + 1
    placed = np.flatnonzero(assign >= 0)
    bins, loads = _bins_of(assign[placed], sizes[placed])
    bins = [[int(placed[i]) for i in b] for b in bins]
    key = sizes[free] * rng.uniform(0.85, 1.15, len(free)) if rng.random() < 0.5 else sizes[free]
    best_fit(sizes, free[np.argsort(-key, kind="stable")], capacity, bins, loads)
    return _assign(bins, len(sizes))


def breed(sizes: np.ndarray, capacity: int, seed: int, elite: list[np.ndarray], generations: int = GENERATIONS) -> np.ndarray:
    """One epoch on an island: the best individual after ``generations``."""
    rng = np.random.default_rng(seed)
    people = [np.asarray(e, np.int32) for e in elite]
    while len(people) < POPULATION:
        # Best fit of decreasing sizes, of disturbed orders after the first.
        key = sizes * (rng.uniform(0.7, 1.3, len(sizes)) if people else 1.0)
        bins: list[list[int]] = []
        best_fit(sizes, np.argsort(-key, kind="stable"), capacity, bins, [])
        people.append(_assign(bins, len(sizes)))
    score = lambda a: fitness(np.bincount(a, weights=sizes).tolist(), capacity)
    scored = sorted(((score(a), k, a) for k, a in enumerate(people)), key=lambda x: (-x[0], x[1]))
    floor = int(np.ceil(sizes.sum() / capacity))
    serial = len(scored)
    for _ in range(generations):
        if scored[0][2].max() + 1 <= floor:
            break  # no packing has fewer bins
        children = []
        for _ in range(POPULATION // 2):
            a, b = rng.choice(len(scored), 2, replace=False)
            child = crossover(scored[a][2], scored[b][2], sizes, capacity, rng)
            children.append((score(child), serial, child))
            serial += 1
        scored = sorted(scored + children, key=lambda x: (-x[0], x[1]))[:POPULATION]
    return scored[0][2]


_ISLAND = "shard long, island int, ids array<string>, sizes array<int>, bins array<int>, fit double"


def _islands(capacity: int, epoch: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                sizes = np.asarray(row.sizes, np.int64)
                elite = [np.asarray(e, np.int32) for e in row.elite if e is not None and len(e)]
                assign = breed(sizes, capacity, SEED + 1009 * epoch + 31 * int(row.island) + int(row.shard) % 100_003, elite)
                out.append((row.shard, row.island, row.ids, row.sizes, assign.astype(np.int32), fitness(np.bincount(assign, weights=sizes).tolist(), capacity)))
            yield pd.DataFrame(out, columns=["shard", "island", "ids", "sizes", "bins", "fit"])

    return run


def _pack_round(items: DataFrame, capacity: int, round_no: int, total: int) -> DataFrame:
    """(shard, item, size, bin) of one round over (item, size)."""
    shards = max(1, -(-total // SHARD_ITEMS))
    h = F.xxhash64(F.lit(round_no), "item")
    dealt = items.select(F.pmod(h, F.lit(shards)).alias("shard"), F.struct("item", "size").alias("x"))
    # A shard is bounded in expectation: about SHARD_ITEMS ids and sizes, no texts.
    rows = cut(dealt.groupBy("shard").agg(F.sort_array(F.collect_list("x")).alias("xs")).select("shard", F.col("xs.item").alias("ids"), F.col("xs.size").alias("sizes")))
    start = rows.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))).withColumn("elite", F.array().cast("array<array<int>>"))
    tasks = max(1, min(shards * ISLANDS, 4 * items.sparkSession.sparkContext.defaultParallelism))
    state = cut(start.repartition(tasks, "shard", "island").select("shard", "island", "ids", "sizes", "elite").mapInPandas(_islands(capacity, 0), _ISLAND))
    for epoch in range(1, EPOCHS):
        # The elite of island i goes to island i + 1 of its shard and competes there with that island's own.
        sent = state.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("bins").alias("came"))
        met = state.join(sent, ["shard", "island"]).select("shard", "island", "ids", "sizes", F.array("bins", "came").alias("elite"))
        state = cut(met.repartition(tasks, "shard", "island").mapInPandas(_islands(capacity, epoch), _ISLAND))
    best = state.groupBy("shard").agg(F.max_by(F.struct("ids", "sizes", "bins"), F.struct("fit", "island")).alias("b"))
    return best.select("shard", F.explode(F.arrays_zip(F.col("b.ids").alias("ids"), F.col("b.sizes").alias("sizes"), F.col("b.bins").alias("bins"))).alias("e")).select("shard", F.col("e.ids").alias("item"), F.col("e.sizes").alias("size"), F.col("e.bins").alias("bin"))


def pack(items: DataFrame, capacity: int = CAPACITY, rounds: int = 2) -> DataFrame:
    """Containers of all items: doc_id, piece, token_start, size, container_id, container_load.

    Every item of ``items_of`` comes out exactly once; no container's load exceeds the
    capacity; an empty table gives no rows.
    """
    full = items.where(F.col("size") == capacity).select("doc_id", "piece", "token_start", "size", F.concat_ws("-", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece").cast("string")).alias("container_id"))
    rest = items.where(F.col("size") < capacity)
    todo = cut(rest.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("piece").cast("string")).alias("item"), "size"))
    done: DataFrame | None = None
    for r in range(rounds):
        total = todo.count()
        if not total:
            break
        packed = _pack_round(todo, capacity, r, total)
        loads = packed.groupBy("shard", "bin").agg(F.sum("size").alias("load"))
        named = cut(packed.join(loads, ["shard", "bin"]).select("item", "size", F.concat_ws("-", F.lit(f"r{r}"), F.col("shard").cast("string"), F.col("bin").cast("string")).alias("container_id"), "load"))
        last = r == rounds - 1
        keep = named if last else named.where(F.col("load") >= WELL_FILLED * capacity)
        done = keep.select("item", "container_id") if done is None else done.unionByName(keep.select("item", "container_id"))
        todo = named.where(F.col("load") < WELL_FILLED * capacity).select("item", "size")
    columns = ["doc_id", "piece", "token_start", "size", "container_id"]
    if done is not None:
        key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("piece").cast("string"))
        full = full.unionByName(rest.withColumn("item", key).join(done, "item").select(*columns))
    load = full.groupBy("container_id").agg(F.sum("size").cast("long").alias("container_load"))
    return full.join(load, "container_id").select(*columns, "container_load")


def over_capacity(packed: DataFrame) -> DataFrame:
    """(doc_id): documents that had to be cut, being larger than one container."""
    return packed.where("piece > 0").select("doc_id").distinct()
