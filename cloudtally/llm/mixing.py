"""Mixing sources to target weights: fair block schedules by release times and deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows that share a slice of a source's order; slices are ranked apart and put in line by their totals.
SLICE_ROWS = 20_000
REST = "(rest)"


def _literal(numbers: list[int]) -> Column:
    return F.array(*[F.lit(n).cast("long") for n in numbers])


def round_shapes(blocks: list[int], parts: list[int]) -> list[tuple[int, list[int]]]:
    """(first round, blocks of each stream per round): where the make-up of the rounds changes.

    A round takes up to its part of each stream. A stream that runs out gives
    what it has left, then nothing; the others go on in their proportions. Each
    stream changes the rounds twice at most, so the list is short however many
    blocks there are.
    """
    starts = {0}
    for n, q in zip(blocks, parts):
        starts |= {n // q, n // q + 1}
    shapes: list[tuple[int, list[int]]] = []
    for first in sorted(starts):
        shape = [min(q, max(0, n - first * q)) for n, q in zip(blocks, parts)]
        if any(shape) and (not shapes or shapes[-1][1] != shape):
            shapes.append((first, shape))
    return shapes


def deadline_order(spark: SparkSession, shapes: list[tuple[int, list[int]]]) -> DataFrame:
    """(shape, stream, nth, slot): earliest deadline first within a round of each shape.

    In a round of C blocks, c of them from a stream, its block k is released
    at floor(kC/c) and due at ceil((k+1)C/c). Of the released blocks the one
    due first goes next, the earlier stream on a tie. Every block then lies in
    its window, so at any slot a stream is less than one block off its share.
    """
    rows = [(i, shape) for i, (_, shape) in enumerate(shapes)]
    df = spark.createDataFrame(rows, "shape int, c array<bigint>")
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(F.transform("c", lambda x: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("picks"))

    def step(acc: Column, slot: Column) -> Column:
        def due(done: Column, i: Column) -> Column:
            c = F.element_at("c", i + 1)
            released = F.floor(done * F.col("total") / c) <= slot
            # ceil((done + 1) * total / c) in whole numbers
            deadline = F.floor(((done + 1) * F.col("total") + c - 1) / c)
            return F.when((done < c) & released, F.struct(deadline.alias("d"), i.alias("i")))

        pick = F.array_min(F.transform(acc["done"], due))["i"]
        return F.struct(
            F.transform(acc["done"], lambda d, i: d + (i == pick).cast("long")).alias("done"),
            F.concat(acc["picks"], F.array(pick)).alias("picks"),
        )

    slots = F.sequence(F.lit(0).cast("long"), F.col("total") - 1)
    picked = df.withColumn("total", total).select("shape", F.posexplode(F.aggregate(slots, start, step, lambda a: a["picks"])).alias("slot", "stream"))
    return picked.withColumn("nth", F.row_number().over(W.partitionBy("shape", "stream").orderBy("slot")).cast("long") - 1)


def mix_sources(
    docs: DataFrame, weights: dict[str, int], rest: int = 1, block: int = 1, size: str | None = None,
    id_col: str = "doc_id", source_col: str = "source", seed: int = 17,
) -> DataFrame:
    """``docs`` with a place in the mix: mix_source, mix_block, mix_slot and mix_rank; order by mix_slot, mix_rank.

    ``weights`` gives listed sources their target parts (whole numbers of at
    least one); all others, null included, are one stream of ``rest`` parts.
    A stream's documents are put in a shuffled order that only depends on
    their id, size and ``seed``, and cut into blocks of ``block`` units of the
    ``size`` column (rows, without one). A document belongs to the block in
    which it starts; one longer than a block leaves the next ones empty, so
    its stream waits its turn. Blocks get their slots from
    :func:`deadline_order`; slots are numbered from 0 over all blocks.

    While every stream lasts, each is less than one block away from its target
    share after any slot; when one is used up, the rest keep their proportions.
    No row is dropped or repeated. Null or negative sizes count as 0. Repeated
    rows stay. An empty table gives no rows. Columns of the same names are
    replaced; all others pass through.

    A stream of any size is ranked in slices, and slices are put in line by
    their totals. What reaches the driver is one total per stream.
    """
    spark = docs.sparkSession
    if min([rest, block, *weights.values()]) < 1:
        raise ValueError("weights, rest and block are whole numbers of at least one")
    names = [*sorted(weights), REST]
    parts = [weights[n] for n in names[:-1]] + [rest]
    mine = ("mix_source", "mix_block", "mix_slot", "mix_rank")
    docs = docs.drop(*mine)
    known = F.array(*[F.lit(n) for n in names[:-1]]) if weights else F.array().cast("array<string>")
    # array_position counts from 1 and gives 0 where there is none: the rest's place is the last
    place = F.coalesce(F.array_position(known, F.col(source_col).cast("string")), F.lit(0))
    units = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)) if size else F.lit(1).cast("long")
    rows = docs.select(
        F.struct("*").alias("row"),
        F.when(place == 0, F.lit(len(names) - 1)).otherwise(place - 1).cast("int").alias("stream"),
        units.alias("units"),
        F.col(id_col).alias("id"),
    ).withColumn("order", F.xxhash64(F.lit(seed), "id", "units"))
    slices = max(1, -(-docs.count() // SLICE_ROWS))
    bits = (slices - 1).bit_length()
    rows = rows.withColumn("slice", F.shiftright(F.col("order"), 64 - bits) if bits else F.lit(0).cast("long"))
    sums = rows.groupBy("stream", "slice").agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("rows"))
    before = W.partitionBy("stream").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        "stream", "slice",
        F.coalesce(F.sum("units").over(before), F.lit(0)).alias("units_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    )
    totals = {r["stream"]: r["units"] for r in sums.groupBy("stream").agg(F.sum("units").alias("units")).collect()}
    # A stream of empty documents only still has one block to stand in.
    blocks = [max(1, -(-totals[i] // block)) if i in totals else 0 for i in range(len(names))]
    shapes = round_shapes(blocks, parts) or [(0, [1] * len(names))]

    in_slice = W.partitionBy("stream", "slice").orderBy("order", "id", "units").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        rows.withColumn("within", F.coalesce(F.sum("units").over(in_slice), F.lit(0)))
        .withColumn("nr", F.count(F.lit(1)).over(in_slice))
        .join(offsets, ["stream", "slice"])
        .withColumn("start", F.col("units_before") + F.col("within"))
        .withColumn("n_blocks", F.element_at(_literal(blocks), F.col("stream") + 1))
        # Empty documents behind the last unit stand in the last block.
        .withColumn("block", F.least(F.floor(F.col("start") / block), F.col("n_blocks") - 1))
        .withColumn("part", F.element_at(_literal(parts), F.col("stream") + 1))
        .withColumn("round", F.floor(F.col("block") / F.col("part")))
        .withColumn("nth", F.col("block") % F.col("part"))
        .withColumn("shape", (F.size(F.filter(_literal([f for f, _ in shapes]), lambda f: f <= F.col("round"))) - 1).cast("int"))
    )
    base = sum((F.least(F.lit(n), F.col("round") * q) for n, q in zip(blocks, parts)), F.lit(0).cast("long"))
    # At most (2 streams + 2) shapes of as many rows as there are parts: bounded by the parameters.
    order = F.broadcast(deadline_order(spark, shapes))
    return placed.join(order, ["shape", "stream", "nth"]).select(
        "row.*",
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("stream") + 1).alias("mix_source"),
        F.col("block").alias("mix_block"),
        (base + F.col("slot")).alias("mix_slot"),
        (F.col("rows_before") + F.col("nr")).alias("mix_rank"),
    )
