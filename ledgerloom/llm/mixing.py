"""Interleaving of sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import itertools
import math
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from ledgerloom.llm.common import checkpoint_dir, number_within, without

BLOCK_ROWS = 32
PERIOD = 1024
LOCAL_SLOTS = 1 << 20
FEW_SOURCES = 1 << 16
ADDED = ["mix_source", "mix_block", "mix_slot", "mix_position"]


def schedule(blocks: dict, weights: dict) -> Iterator:
    """The source of each slot, from 0, until every source has given its blocks.

    Pfair windows from the exact weights (floats are fractions): within a phase, block i of weight w out of a total t is
    released at slot floor(i * t / w) and due by ceil((i + 1) * t / w). Each slot goes to the released block that is due
    first; ties prefer the overlapping window (the next block's release falls before this deadline), then the heavier
    source, then its name. So at every slot of a phase a source is less than one block from its target weight, however
    long the phase is. A phase ends when some source gives its last block; the rest begin anew with the total that is
    left, so no block is dropped or repeated.

    Of the sources without a block in this phase the heaviest is due first, so they wait in one list by weight and cost
    nothing: the work is one heap step a slot, whatever the number of sources and phases.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    ratios = {s: Fraction(weights[s]) for s in left}
    scale = math.lcm(*(r.denominator for r in ratios.values()))
    whole = {s: int(r * scale) for s, r in ratios.items()}
    total = sum(whole.values())
    line = sorted(left, key=lambda s: (-whole[s], str(s)))
    following, previous = dict(zip([_HEAD, *line], [*line, None], strict=True)), dict(zip(line, [_HEAD, *line], strict=False))

    def window(s, i: int) -> tuple:
        after, odd = divmod((i + 1) * total, whole[s])
        return (after + (odd > 0), not odd, -whole[s], str(s), i, s, after)

    while left:
        waiting: list = []
        ready: list = []
        fresh = following[_HEAD]
        asks = window(fresh, 0)
        for slot in itertools.count():
            while waiting and waiting[0][0] <= slot:
                _, _, i, s = heapq.heappop(waiting)
                heapq.heappush(ready, window(s, i))
            if asks is not None and (not ready or asks[:4] < ready[0][:4]):
                due, _, _, name, i, s, after = asks
                fresh = following[fresh]
                asks = None if fresh is None else window(fresh, 0)
            else:
                due, _, _, name, i, s, after = heapq.heappop(ready)
            if due <= slot:
                raise AssertionError("a block missed its deadline")
            yield s
            left[s] -= 1
            if not left[s]:
                break
            heapq.heappush(waiting, (max(slot + 1, after), name, i + 1, s))
        del left[s]
        total -= whole[s]
        before, then = previous.pop(s), following.pop(s)
        following[before] = then
        if then is not None:
            previous[then] = before


_HEAD = object()


def stored_schedule(spark: SparkSession, blocks: dict, weights: dict, period: int = PERIOD, local_slots: int = LOCAL_SLOTS) -> tuple[DataFrame, bool]:
    """The schedule as rows (_ps, _chunk, _slots: the slots of `period` blocks of a source), and whether it is small.

    Up to local_slots slots it is a local table (8 bytes a slot); a longer one is appended to a table in the shared folder
    as it is made, so the driver holds one run of each source and no more.
    """
    runs: dict = {}
    chunks: Counter = Counter()
    out: list[tuple] = []
    columns, path, held = "_ps string, _chunk long, _slots array<long>", f"{checkpoint_dir(spark)}/schedule-{uuid.uuid4().hex}", 0

    def close(s) -> None:
        out.append((s, chunks[s], runs.pop(s).tolist()))
        chunks[s] += 1

    def flush() -> None:
        spark.createDataFrame(out, columns).repartition(max(1, len(out) * period // local_slots)).write.mode("append").parquet(path)
        out.clear()

    stored = False
    for slot, s in enumerate(schedule(blocks, weights)):
        run = runs.setdefault(s, array("q"))
        run.append(slot)
        held += 1
        if len(run) == period:
            close(s)
        if held > local_slots:  # short runs stay open, full ones go
            flush()
            stored, held = True, sum(map(len, runs.values()))
    for s in list(runs):
        close(s)
    if not stored:
        return spark.createDataFrame(out, columns), True
    flush()
    return spark.read.schema(columns).parquet(path), False


def mix(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD, max_sources: int | None = None, max_blocks: int | None = None, local_slots: int = LOCAL_SLOTS) -> DataFrame:
    """Give every document its place in one sequence that mixes the sources to their target weights.

    docs: doc_id, source and any other columns. weights: source -> positive weight; a source without one, and every
    source if weights is None, gets the square root of its number of documents. Added: mix_source (source; null and
    empty are two sources), mix_block (long, within the source), mix_slot (long, the block's place in the schedule),
    mix_position (long, the document's place, from 0, without gaps within a block). Documents are put into blocks of
    block_rows in a pseudo-random, reproducible order; only a source's last block may be shorter. All rows stay,
    repeated rows too. Rows of a hot source are numbered by salted sub-groups, dealt by their doc_id or,
    without one, by a hash of all plain columns, so that many rows without a doc_id spread too. An empty table stays empty.

    The driver sees one row per source and makes the schedule, one heap step a block. A schedule of up to local_slots
    blocks is broadcast (8 MB); a longer one is a table, written in runs of `period` blocks as it is made and joined on
    (source, run), so that neither the driver nor a task holds it. The bound of less than one block holds for every
    source and any size. Making it takes about 3 s per million blocks on the driver; who would rather have larger blocks
    or fewer sources than that sets max_blocks (blocks grow until there are no more than that) or max_sources (smaller
    sources beyond it share pools by a hash of their name, scheduled like a source with the sum of their weights, so that
    a pooled source keeps its weight on average only). Both are off by default.
    """
    docs = without(docs, ADDED)
    keyed = docs.withColumn("mix_source", F.concat(F.when(F.col("source").isNull(), "null").otherwise("source:"), F.coalesce(F.col("source").cast("string"), F.lit(""))))
    spark = docs.sparkSession
    given = {f"source:{s}" if s is not None else "null": float(w) for s, w in (weights or {}).items()}
    if any(w <= 0 for w in given.values()):
        raise ValueError("weights must be positive")
    by_source = keyed.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n"))
    own_weight = F.sqrt(F.col("n").cast("double"))
    if given:
        named = spark.createDataFrame(list(given.items()), "_source string, _weight double")
        by_source = by_source.join(named, F.col("mix_source") == F.col("_source"), "left").select("mix_source", "n", F.coalesce("_weight", own_weight).alias("weight"))
    else:
        by_source = by_source.withColumn("weight", own_weight)
    largest = (by_source if max_sources is None else by_source.orderBy(F.desc("n"), "mix_source").limit(max_sources + 1)).collect()
    keyed = keyed.withColumn("_lane", F.col("mix_source"))
    if max_sources is not None and len(largest) > max_sources:
        alone = max_sources // 2
        kept = [r["mix_source"] for r in largest[:alone]]
        lane = F.when(F.array_contains(F.lit(kept), F.col("mix_source")), F.col("mix_source")).otherwise(F.concat(F.lit("pool:"), F.pmod(F.xxhash64("mix_source"), F.lit(max_sources - alone)).cast("string")))
        keyed = keyed.withColumn("_lane", lane)
        largest = by_source.withColumn("mix_source", lane).groupBy("mix_source").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).collect()
    sizes = {r["mix_source"]: r["n"] for r in largest}
    if max_blocks is not None:
        block_rows = max(block_rows, -(-sum(sizes.values()) // max_blocks))
    plan, small = stored_schedule(spark, {s: -(-n // block_rows) for s, n in sizes.items()}, {r["mix_source"]: r["weight"] for r in largest}, period, local_slots)
    table = spark.createDataFrame(list(sizes.items()), "_lane string, rows long")
    plain = [f"`{f.name}`" for f in docs.schema if isinstance(f.dataType, AtomicType)]
    keyed = keyed.withColumn("_tie", F.xxhash64(*plain))
    deal = F.when(F.col("doc_id").isNull(), F.col("_tie")).otherwise(F.xxhash64("doc_id"))
    numbered = number_within(keyed, "_lane", ["doc_id", "_tie"], table, "_nth", deal=deal, few=len(sizes) <= FEW_SOURCES).withColumn("mix_block", F.floor(F.col("_nth") / block_rows))
    placed = numbered.join(F.broadcast(plan) if small else plan, (F.col("_lane") == F.col("_ps")) & (F.floor(F.col("mix_block") / period) == F.col("_chunk")))
    slot = F.element_at("_slots", (F.col("mix_block") % period + 1).cast("int"))
    placed = placed.withColumn("mix_slot", slot).withColumn("mix_position", F.col("mix_slot") * block_rows + F.col("_nth") % block_rows)
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("source").alias("mix_source"), "mix_block", "mix_slot", "mix_position")


def in_mixed_order(docs: DataFrame, rows_per_file: int = 16_384, **options) -> DataFrame:
    """The documents themselves, range-partitioned and sorted by their place in the mix: files in name order hold it."""
    rows = docs.count()
    mixed = mix(docs, **options)
    parts = max(1, -(-rows // rows_per_file))
    return mixed.repartitionByRange(parts, "mix_position").sortWithinPartitions("mix_position").select(*[F.col(f"`{c}`") for c in docs.columns])


def place_in_files() -> Column:
    """Place of a row in Spark's part files that hold in_mixed_order's rows: part, file of the part, row of the file.

    Only for a table read from such files; a name that is not Spark's is an error.
    """
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).cast("long")
    return F.shiftleft(number(r"^part-(\d+)"), 44) + F.shiftleft(number(r"-c(\d+)\."), 32) + F.col("_metadata.row_index")
