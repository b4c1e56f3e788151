"""Mixing sources to target weights along a curriculum.

Every source has a weight schedule over training time t in [0, 1], given as points
(t, weight) with straight lines between them; its integral is the cumulative token
demand of the source. Documents of a source stand in a
random but fixed order, pass after pass, and the demand curve is inverted at
each document's place in its source's token stream: that is its training
position. The mix is range-sorted by position.

Prefix sums of tokens run in hash buckets inside a source and over one row a
bucket, so a source that holds a third of all documents is never one task.
"""

from __future__ import annotations

import base64
import math
import os
from dataclasses import dataclass

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quirelake.plans.lineage import cut
from quirelake.plans.order import bucketed_prefix_sum
from quirelake.sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The splitting pattern published with byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of a source that are ordered together.
BUCKET_DOCS = 20_000
TILT = 0.5
#: (t, weight) points; before the first and behind the last one the weight stays.
Schedule = tuple[tuple[float, float], ...]

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a rank file, built once a process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(path: str):
    """UDF: number of tokens of a text; 0 for null and empty."""

    def count(texts: pd.Series) -> pd.Series:
        sent = SparkFiles.get(os.path.basename(path))
        enc = encoding(sent if os.path.exists(sent) else path)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return F.pandas_udf(count, LongType())


@dataclass(frozen=True)
class SourcePlan:
    source: str
    target: float
    repeats: int
    available: int
    demand: int
    schedule: Schedule

    def _lines(self) -> list[tuple[float, float, float, float]]:
        """(t, weight, end, weight there) of each piece of some length."""
        points = [(0.0, self.schedule[0][1]), *self.schedule, (1.0, self.schedule[-1][1])]
        return [(t0, w0, t1, w1) for (t0, w0), (t1, w1) in zip(points, points[1:]) if t1 > t0]

    def pieces(self) -> list[tuple[float, float, float, float]]:
        """(mass before, t, weight, slope) of each piece of some mass, scaled so that the whole mass is 1."""
        raw, mass = [], 0.0
        for t0, w0, t1, w1 in self._lines():
            if w0 + w1 > 0:
                raw.append((mass, t0, w0, (w1 - w0) / (t1 - t0)))
                mass += (w0 + w1) / 2 * (t1 - t0)
        return [(m / mass, t, w / mass, k / mass) for m, t, w, k in raw]

    def share_before(self, t: float) -> float:
        """The integral of the schedule up to `t`, of that of the whole."""
        mass = lambda end: sum((w0 + w0 + (w1 - w0) * (min(end, t1) - t0) / (t1 - t0)) / 2 * (min(end, t1) - t0) for t0, w0, t1, w1 in self._lines() if t0 < end)
        return mass(t) / mass(1.0)


def checked_schedule(points: Schedule) -> Schedule:
    """`points` in order of time; raises if a weight or a time is out of range or no weight is above 0."""
    points = tuple(sorted(((float(t), float(w)) for t, w in points), key=lambda p: p[0]))
    if not points or any(not 0 <= t <= 1 or not w >= 0 for t, w in points) or not any(w > 0 for _, w in points):
        raise ValueError(f"no schedule: {points}")
    return points


def plan_mix(available: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None, schedules: dict[str, Schedule] | None = None) -> list[SourcePlan]:
    """Token demand and schedule of each source that has both documents and a share.

    Shares of sources without documents are spread over the rest in proportion.
    Without `total` the mix is the largest one that meets every share within the
    repeat caps. With `total`, a source that cannot fill its share gives all it
    has, and what is missing is spread over the others as far as they reach.
    Without a schedule of their own, sources used once lean to the start and
    repeated ones to the end, centred so that the weights of all sources sum to one
    at any time. With `schedules`, t is the time of the schedules: at any t the
    sources stand in the ratio of their demands times their weights.
    """
    live = [(s, w, r, available[s]) for s, w, r in sorted(targets) if w and w > 0 and r and r > 0 and available.get(s, 0) > 0]
    if not live:
        return []
    whole = sum(w for _, w, _, _ in live)
    caps = {s: n * r for s, _, r, n in live}
    share = {s: w / whole for s, w, _, _ in live}
    if total is None:
        size = min(caps[s] / share[s] for s in share)
        demand = {s: share[s] * size for s in share}
    else:
        demand, open_ = {}, dict(share)
        left = float(total)
        while open_:
            scale = left / sum(open_.values())
            full = [s for s in open_ if open_[s] * scale >= caps[s]]
            if not full:
                demand |= {s: w * scale for s, w in open_.items()}
                break
            for s in full:
                demand[s] = float(caps[s])
                left -= caps[s]
                del open_[s]
    used = sum(demand.values())
    raw = {s: TILT if r == 1 else -TILT for s, _, r, _ in live}
    mean = sum(raw[s] * demand[s] for s in raw) / used
    scale = max(1.0, max(abs(a - mean) for a in raw.values()))
    lean = {s: (a - mean) / scale for s, a in raw.items()}
    own = {s: checked_schedule((schedules or {}).get(s) or ((0.0, 1 + a), (1.0, 1 - a))) for s, a in lean.items()}
    return [SourcePlan(s, w, r, n, max(1, math.floor(demand[s])), own[s]) for s, w, r, n in live]


def sized_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, tokens), each document once, kept in the checkpoint folder.

    Documents without id, source or text, and texts of no tokens, have no size to
    mix and are left out.
    """
    docs.sparkSession.sparkContext.addFile(tokenizer)  # executors get it from the driver
    some = docs.filter("doc_id is not null and source is not null and text is not null and text <> ''").select("doc_id", "source", "text")
    sized = some.select("doc_id", "source", token_counts(tokenizer)("text").alias("tokens")).filter("tokens > 0")
    return cut(sized.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("d")).select("doc_id", "d.source", "d.tokens"))


def place_documents(sized: DataFrame, plan: list[SourcePlan], seed: int = 7) -> DataFrame:
    """(doc_id, source, copy, tokens, position), unsorted; copy counts from 0.

    A document is used if its middle lies before the end of its source's demand, so
    a source misses its demand by at most half a document. Equal hashes are
    ordered by doc_id.
    """
    spark = sized.sparkSession
    p = spark.createDataFrame([(x.source, x.available, x.demand, x.pieces()) for x in plan], "source string, available long, demand long, pieces array<struct<m: double, t: double, w: double, k: double>>")
    rows = sized.count()
    buckets = max(1, rows // BUCKET_DOCS)
    h = sized.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).join(F.broadcast(p), "source")
    bucket = F.floor((F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63))) * buckets)
    h = h.withColumn("_o", F.shiftrightunsigned("h", 1))
    at = bucketed_prefix_sum(h, ["source"], bucket, ["_o", "doc_id"], "tokens", "before")
    passes = F.sequence(F.lit(0), F.ceil(F.col("demand") / F.col("available")).cast("int") - 1)
    uses = at.withColumn("copy", F.explode(passes)).withColumn("start", F.col("before") + F.col("copy") * F.col("available")).filter("start + tokens / 2.0 < demand")
    y = F.least((F.col("start") + F.col("tokens") / 2.0) / F.col("demand"), F.lit(1.0))
    # the piece that the place falls in, and the time at which its integral reaches it
    piece = F.element_at(F.filter("pieces", lambda x: x["m"] <= F.col("y")), -1)
    uses = uses.withColumn("y", y).withColumn("x", piece)
    m, w, k = F.col("y") - F.col("x.m"), F.col("x.w"), F.col("x.k")
    root = w + F.sqrt(F.greatest(w * w + 2 * k * m, F.lit(0.0)))
    t = F.least(F.col("x.t") + F.when(root > 0, 2 * m / root).otherwise(0.0), F.lit(1.0))
    return uses.select("doc_id", "source", "copy", "tokens", t.alias("position"))


def mix_plan(spark, sf_dir: str, tokenizer: str, total: int | None, schedules: dict[str, Schedule] | None) -> tuple[DataFrame, list[SourcePlan], dict[str, tuple[int, int]]]:
    sized = sized_documents(table(spark, sf_dir, "documents"), tokenizer)
    targets = [(r.source, r.target_share, r.max_repeats) for r in table(spark, sf_dir, "mix_targets").filter("source is not null").collect()]  # fixed size
    wanted = sized.join(F.broadcast(spark.createDataFrame([(s,) for s, _, _ in targets] or [("",)], "source string").distinct()), "source", "left_semi")
    have = {r.source: (r.n, r.t) for r in wanted.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).collect()}
    return sized, plan_mix({s: t for s, (_, t) in have.items()}, targets, total, schedules), have


def p8_mix(spark, sf_dir: str, tokenizer: str = TOKENIZER, total: int | None = None, schedules: dict[str, Schedule] | None = None) -> DataFrame:
    """(doc_id, source, copy, tokens, position) in training order."""
    sized, plan, _ = mix_plan(spark, sf_dir, tokenizer, total, schedules)
    return place_documents(sized, plan).orderBy("position", "source", "doc_id", "copy")


def p8_shares(spark, sf_dir: str, tokenizer: str = TOKENIZER, total: int | None = None, schedules: dict[str, Schedule] | None = None) -> DataFrame:
    """One row a target: wanted and actual share, documents, uses and repeats.

    Targets without documents and sources without a target appear with share 0.
    """
    sized, plan, _ = mix_plan(spark, sf_dir, tokenizer, total, schedules)
    used = place_documents(sized, plan).groupBy("source").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("doc_id").alias("documents_used"), F.sum("tokens").alias("tokens_used"), (F.max("copy") + 1).cast("long").alias("most_repeats"))
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens_available"))
    goals = table(spark, sf_dir, "mix_targets").filter("source is not null")
    out = have.join(goals, "source", "full_outer").join(used, "source", "left")
    total_used = used.agg(F.sum("tokens_used").alias("_all"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens_available", "uses", "documents_used", "tokens_used", "most_repeats")]
    share = F.round(F.coalesce(F.col("tokens_used") / F.col("_all"), F.lit(0.0)), 6).alias("actual_share")
    return out.join(F.broadcast(total_used), F.lit(True), "left").select("source", "target_share", "max_repeats", *zero, share)
