"""Mixing sources to target shares of tokens.

Documents are aggregated by membership pattern (the set of sources they may
count for). A min-cost flow routes the patterns' tokens to the sources'
quotas, where using a document again costs more each time; then seeded
documents fill each part of the flow. Only sums by pattern reach the driver.
"""

from __future__ import annotations

import base64
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import checkpoint, share

SEPARATOR = "\x1f"
MOST_PATTERNS = 5_000
#: Documents of a pattern are ordered within buckets of about so many, never in one task.
BUCKET_ROWS = 20_000


def default_tokenizer() -> str:
    """The installed public byte-level BPE vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def token_counts(documents: DataFrame, keep: list[str], text: str, tokenizer: str | None = None, pattern: str | None = None) -> DataFrame:
    """The `keep` columns and `tokens`, the text's length in tokens; 0 for a null text. Whole texts are counted, in one pass.

    tokenizer: the path of a tiktoken rank file, which only the driver reads;
    pattern: how it splits texts (by default as the installed vocabulary does).
    The ranks are broadcast, so executors need neither file nor package.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(tokenizer or default_tokenizer(), "rb") as f:
        shared = share(documents.sparkSession, (pattern, {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        pattern, ranks = shared.value
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return documents.select(*keep, count(F.col(text)).alias("tokens"))


class Flow:
    """Min-cost flow by successive shortest paths, for the few nodes of patterns and sources."""

    def __init__(self) -> None:
        self.edges: list[list[int]] = []  # to, capacity left, cost
        self.of: dict[object, list[int]] = defaultdict(list)

    def add(self, a: object, b: object, capacity: int, cost: int) -> int:
        self.of[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.of[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def run(self, start: object, goal: object) -> int:
        total = 0
        while True:
            cost, came, queue, waiting = {start: 0}, {}, deque([start]), {start}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for e in self.of[a]:
                    b, capacity, price = self.edges[e]
                    if capacity > 0 and (b not in cost or cost[a] + price < cost[b]):
                        cost[b], came[b] = cost[a] + price, (a, e)
                        if b not in waiting:
                            waiting.add(b)
                            queue.append(b)
            if goal not in came:
                return total
            path, at = [], goal
            while at != start:
                at, e = came[at]
                path.append(e)
            push = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= push
                self.edges[e ^ 1][1] += push
            total += push


def route(tokens: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> tuple[int, dict[tuple[tuple[str, ...], int, str], int]]:
    """The tokens of each (pattern, use, source) in the cheapest flow, and their sum. Use r of a pattern's documents costs r - 1."""
    flow, arcs = Flow(), {}
    for pattern, size in tokens.items():
        able = [s for s in pattern if s in quotas]
        for use in range(1, max((repeats[s] for s in able), default=0) + 1):
            flow.add("start", (pattern, use), size, use - 1)
            for s in able:
                if use <= repeats[s]:
                    arcs[pattern, use, s] = flow.add((pattern, use), ("source", s), size, 0)
    for s, quota in quotas.items():
        flow.add(("source", s), "goal", quota, 0)
    total = flow.run("start", "goal")
    return total, {k: used for k, e in arcs.items() if (used := flow.edges[e ^ 1][1])}


def plan(tokens: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None) -> tuple[int, dict[str, int], dict]:
    """The mixture's size, the sources' quotas and the flow.

    Without a given total it is the largest at which every source with
    documents reaches its share: the targets of sources without documents,
    which nothing can fill, are spread over the others in proportion.
    """
    able = {s for p, n in tokens.items() if n for s in p}
    live = {s: share for s, (share, cap) in targets.items() if s in able and cap > 0 and share > 0}
    whole = sum(live.values())
    repeats = {s: targets[s][1] for s in live}
    if not live:
        return 0, {}, {}

    def quotas(size: int) -> dict[str, int]:
        return {s: int(size * share / whole) for s, share in live.items()}

    if total is None:
        low, high = 0, sum(tokens.values()) * max(repeats.values())
        while low < high:
            middle = (low + high + 1) // 2
            q = quotas(middle)
            if route(tokens, q, repeats)[0] == sum(q.values()):
                low = middle
            else:
                high = middle - 1
        total = low
    q = quotas(total)
    return total, q, route(tokens, q, repeats)[1]


def mix(documents: DataFrame, targets: DataFrame, *, doc_id: str, members: str, tokens: str = "tokens", seed: int = 42, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source_name, repeats, tokens) and the shares reached.

    documents: one row each with an array of the sources it may count for
    (`members`; a null or empty one is never used) and its tokens. targets:
    source_name, target_share, max_repeats. A document is used at most
    max_repeats times of the source that it counts for; sources are repeated
    only after all their documents are used once. The same seed gives the
    same mixture. Shares miss their quota by less than one document for each
    part of the flow. Shares: source_name, target_share, max_repeats,
    available_tokens, used_tokens, used_documents, reached_share; sources
    without target, and targets without documents, are reported with 0 used.
    """
    spark = documents.sparkSession
    pattern = F.array_join(F.array_sort(F.array_distinct(F.array_compact(members))), SEPARATOR)
    sized = checkpoint(documents.select(doc_id, pattern.alias("pattern"), F.col(tokens).cast("long").alias("tokens"), F.xxhash64(F.lit(seed), doc_id).alias("draw")))
    sums = sized.where("pattern is not null and pattern <> ''").groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    wanted = targets.select("source_name", "target_share", "max_repeats").limit(MOST_PATTERNS + 1).collect()
    if len(wanted) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} targets")
    goals = {r.source_name: (r.target_share or 0.0, r.max_repeats or 0) for r in wanted}
    _, _, flow = plan({tuple(r.pattern.split(SEPARATOR)): r.tokens for r in sums}, goals, total)
    # Each use of a pattern's documents is cut into stretches of their seeded order, one for each source it serves.
    stretches, reached = [], defaultdict(int)
    for (p, use, source), size in sorted(flow.items(), key=lambda x: (x[0][0], x[0][1], x[0][2])):
        stretches.append((SEPARATOR.join(p), use, source, reached[p, use], reached[p, use] + size))
        reached[p, use] += size
    parts = F.broadcast(spark.createDataFrame(stretches, "pattern string, use int, source_name string, low long, high long"))
    buckets = max([1, *(r.n // BUCKET_ROWS + 1 for r in sums)])
    drawn = sized.withColumn("bucket", F.pmod("draw", F.lit(buckets)))
    in_order = Window.partitionBy("pattern", "bucket").orderBy("draw", doc_id).rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = drawn.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("size"))
    ahead = by_bucket.withColumn("ahead", F.coalesce(F.sum("size").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    placed = drawn.withColumn("within", F.coalesce(F.sum("tokens").over(in_order), F.lit(0))).join(ahead, ["pattern", "bucket"])
    middle = F.col("ahead") + F.col("within") + F.col("tokens") / 2
    mixture = (
        placed.where("tokens > 0")
        .withColumn("middle", middle)
        .join(parts, "pattern")
        .where((F.col("middle") >= F.col("low")) & (F.col("middle") < F.col("high")))
        .groupBy(doc_id, "source_name", "tokens")
        .agg(F.count(F.lit(1)).cast("int").alias("repeats"))
        .select(doc_id, "source_name", "repeats", "tokens")
    )
    used = mixture.groupBy("source_name").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.count(F.lit(1)).alias("used_documents"))
    available = sized.select(F.explode(F.split("pattern", SEPARATOR)).alias("source_name"), "tokens").where("source_name <> ''").groupBy("source_name").agg(F.sum("tokens").alias("available_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shares = (
        targets.select("source_name", "target_share", "max_repeats")
        .join(available, "source_name", "full")
        .join(used, "source_name", "left")
        .select("source_name", "target_share", "max_repeats", zero("available_tokens"), zero("used_tokens"), zero("used_documents"))
        .crossJoin(F.broadcast(used.agg(F.sum("used_tokens").alias("__all"))))
        .withColumn("reached_share", F.coalesce(F.col("used_tokens") / F.col("__all"), F.lit(0.0)))
        .drop("__all")
    )
    return mixture, shares
