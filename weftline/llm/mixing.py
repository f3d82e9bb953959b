"""Mix sources to target weights on a low-discrepancy schedule."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.ordering import positions
from weftline.session import materialize

#: Tokens in a block, the unit in which the schedule takes from a source.
BLOCK_TOKENS = 512
_CHUNK = 1 << 16  # slots ranked in one window group
_GOLDEN = (math.sqrt(5) - 1) / 2
_SPACE_RUN = r"[\x20\x09-\x0D]+"


def word_count(column: str):
    """Words of a text; null has none."""
    words = F.filter(F.split(F.coalesce(column, F.lit("")), _SPACE_RUN), lambda w: w != "")
    return F.size(words).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """Per row of ``sizes`` (source, source_size): ``src`` (rank by code point, null last), ``weight``, ``target``, ``tokens``.

    ``percent`` of all sizes is shared by weight; a share stops at ``most``
    times the source's size, and the excess is shared again until none is
    above. ``tokens`` is the target's whole part, computed in integers.
    """
    ranked = positions(sizes, [F.col("source").asc_nulls_last()]).withColumnRenamed("position", "src")
    pick = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("src"), F.lit(len(weights))).cast("int"))
    ranked = materialize(ranked.withColumn("weight", pick.cast("long")), "sources")
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, held, free = total or 0, 0, all_weights or 1

    def exact(value: int):
        return F.lit(str(value)).cast("decimal(20,0)")

    def above():
        share = F.col("weight").cast("decimal(10,0)") * exact(percent * total - 100 * held)
        return share > F.col("source_size").cast("decimal(18,0)") * exact(100 * most * free)

    while True:  # each turn holds at least one more source, in practice a few turns
        now_held, now_free = ranked.agg(
            F.sum(F.when(above(), F.col("source_size") * most)), F.sum(F.when(~above(), F.col("weight")))
        ).first()
        now = (now_held or 0, now_free or 1)
        if now == (held, free):
            break
        held, free = now
    left = percent * total - 100 * held
    return ranked.withColumns(
        {
            "target": F.when(above(), (F.col("source_size") * most).cast("double")).otherwise(
                F.col("weight") * F.lit(float(left)) / F.lit(100.0 * free)
            ),
            "tokens": F.when(above(), F.col("source_size") * most).otherwise(
                F.floor(F.col("weight").cast("decimal(10,0)") * exact(left) / exact(100 * free)).cast("long")
                if free >= 1 << 30
                else F.expr(f"cast(weight * {left}L div {100 * free}L as long)")
            ),
        }
    )


def schedule(sources: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """Which block of which source each slot takes: slot, src, pass_no, block, tokens.

    ``sources`` has src, source_size and tokens (what to take). Point ``i`` of
    the golden-ratio sequence falls into one source's share of the cumulative
    weights; the slots of a source, in order, take its blocks in order, again
    from the first when they run out, and the last slot takes what is missing.
    Where the sequence has fallen short of a source by its small discrepancy,
    the missing slots follow at the end. A source without tokens has no slot.
    """
    spark = sources.sparkSession
    size, tokens, per = F.col("source_size"), F.col("tokens"), F.expr(f"(source_size + {block - 1}) div {block}")
    asked = sources.filter((tokens > 0) & (size > 0)).select(
        "src",
        "source_size",
        "tokens",
        per.alias("blocks"),
        F.expr(f"tokens div source_size * ((source_size + {block - 1}) div {block}) + (tokens % source_size + {block - 1}) div {block}").alias("slots"),
    )
    asked = materialize(positions(asked, [F.col("src")], ["slots"]).drop("position"), "asked")
    n_slots, n_sources = asked.agg(F.sum("slots"), F.count("*")).first()
    n_slots = n_slots or 0
    cells = 1 << max(10, (n_sources or 1).bit_length() + 1)
    share = asked.withColumns(
        {
            "_from": F.col("before_slots") / F.lit(float(max(1, n_slots))),
            "_to": (F.col("before_slots") + F.col("slots")) / F.lit(float(max(1, n_slots))),
        }
    )
    share = share.withColumn(
        "_cell",
        F.explode(F.sequence(F.floor(F.col("_from") * cells).cast("long"), F.floor(F.col("_to") * cells).cast("long"))),
    ).select("src", "_from", "_to", "_cell")
    high, low = F.expr("slot div 1048576"), F.col("slot") % 1048576
    point = F.lit(math.fmod(_GOLDEN * 1048576, 1.0)) * high + F.lit(_GOLDEN) * low
    points = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("_u", point - F.floor(point))
    points = points.withColumn("_cell", F.floor(F.col("_u") * cells).cast("long"))
    inside = (F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to"))
    # Both sides meet in a cell: many slots, but only the few sources whose shares touch it.
    drawn = points.join(share, "_cell").filter(inside).select("slot", "src", F.expr(f"slot div {_CHUNK}").alias("_chunk"))
    drawn = materialize(drawn, "drawn")
    counts = drawn.groupBy("src", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("src").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy("src", "_chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("_inner", inner).join(offsets, ["src", "_chunk"])
    ranked = ranked.select("src", "slot", (F.col("_offset") + F.col("_inner")).alias("rank"))
    got = drawn.groupBy("src").agg(F.count("*").alias("_got"))
    short = asked.join(got, "src", "left").select("src", "slots", F.coalesce("_got", F.lit(0)).alias("_got"))
    late = short.filter(F.col("_got") < F.col("slots")).select(
        "src", F.explode(F.sequence("_got", F.col("slots") - 1)).alias("rank")
    )
    ranked = ranked.unionByName(late.withColumn("slot", F.lit(n_slots) + F.col("rank"))).join(
        asked.select("src", "source_size", "tokens", "blocks", "slots"), "src"
    )
    return ranked.filter("rank < slots").select(
        "slot",
        "src",
        F.expr("rank div blocks").alias("pass_no"),
        F.expr("rank % blocks").alias("block"),
        F.expr(
            f"least({block}, source_size - rank % blocks * {block}, "
            f"tokens - rank div blocks * source_size - rank % blocks * {block})"
        ).alias("tokens"),
    )


def mixed(documents: DataFrame, seed: str = "mix", block: int = BLOCK_TOKENS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``documents`` (doc_id, text, source): size, source_size, target, taken, first_slot and n_slots.

    ``taken`` are the words the mix takes, ``first_slot`` is the slot of the
    schedule in which it first takes some (null if it never does) and
    ``n_slots`` in how many it does: rows by ``first_slot`` come in the order of the mix.

    Sources keep their documents shuffled by a digest of seed, doc_id and
    size, laid end to end and cut into blocks of ``block`` words; the schedule
    takes blocks. The digest decides alone, so reruns agree. A null text or
    one without words has size 0 and gives nothing; a null source is a source;
    repeated rows are separate documents. No documents give no rows.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    rows = documents.select("doc_id", F.col("source").cast("string").alias("source"), word_count("text").alias("size"), *carry)
    rows = materialize(rows.withColumn("digest", digest), "mix-rows")  # the texts are read once
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialize(targets(sizes), "targets")
    n = rows.count()
    letters = 1 + max(0, math.ceil(math.log(max(1, n) / 20_000, 16)))  # about 20,000 rows in a bucket at most
    rows = rows.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("_bucket", F.substring("digest", 1, letters))
    sums = rows.groupBy("src", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inner = Window.partitionBy("src", "_bucket").orderBy("digest", "doc_id", "size")
    laid = rows.withColumn("_in", F.coalesce(F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    laid = laid.join(offsets, ["src", "_bucket"]).withColumn("_at", F.col("_offset") + F.col("_in"))
    laid = laid.select("doc_id", "size", "source_size", "target", "src", "_at", *carry)
    pieces = laid.filter("size > 0").withColumn(
        "block", F.explode(F.expr(f"sequence(_at div {block}, (_at + size - 1) div {block})"))
    )
    slots = schedule(sources, block).select("src", "block", F.col("tokens").alias("_tokens"), "slot")
    met = pieces.join(slots, ["src", "block"], "left").withColumn(
        "_taken",
        F.expr(f"greatest(0, least(_at + size, block * {block} + coalesce(_tokens, 0)) - greatest(_at, block * {block}))"),
    )
    keys = ["src", "_at", "doc_id", "size", "source_size", "target", *carry]
    used = F.when(F.col("_taken") > 0, F.col("slot"))
    taken = met.groupBy(*keys).agg(
        F.sum("_taken").cast("long").alias("taken"), F.min(used).alias("first_slot"), F.count(used).alias("n_slots")
    )
    none = {"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long"), "n_slots": F.lit(0).cast("long")}
    empty = laid.filter("size = 0").withColumns(none)
    return taken.unionByName(empty.select(*taken.columns)).select(
        "doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots", *carry
    )


def mix(documents: DataFrame) -> DataFrame:
    """``documents`` as the mix has them: each row as often as the mix takes its words, to the nearest whole number.

    Columns stay. Rows that are alike in doc_id, source and text share their
    copies as evenly as can be. Rows without words are left out.
    """
    columns = documents.columns
    text, source = F.coalesce("text", F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), source, text)
    marked = documents.withColumn("_mix_row", row)
    taken = mixed(marked, carry=("_mix_row",)).filter("size > 0")
    copies = taken.groupBy("_mix_row").agg(
        F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).alias("_mix_copies"), F.count("*").alias("_mix_alike")
    )
    met = marked.join(copies.filter("_mix_copies > 0"), "_mix_row")
    place = F.row_number().over(Window.partitionBy("_mix_row").orderBy(F.lit(1)))
    times = F.expr("_mix_copies div _mix_alike") + F.when(place <= F.expr("_mix_copies % _mix_alike"), 1).otherwise(0)
    out = met.withColumn("_mix_times", times.cast("int")).withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), F.col("_mix_times"))))
    return out.select(*columns)


def op10_low_discrepancy_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same in closed form: water-filled targets, each source's shuffled words from the first, twice over at most, and the
#: slots in which the golden-ratio points take their blocks.
_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src
  FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][(src % 3 + 1)::INT]::HUGEINT AS weight, (sum(source_size) OVER ())::HUGEINT AS total FROM s
), o AS (
  SELECT *,
    coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS held,
    (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS free
  FROM w WINDOW o AS (ORDER BY source_size / weight, src)
), c AS (
  SELECT *, weight * (3 * total - 2 * held) > 4 * source_size * free AS above FROM o
), f AS (
  SELECT (3 * any_value(total) - 2 * coalesce(sum(2 * source_size) FILTER (above), 0))::HUGEINT AS rest,
    coalesce(sum(weight) FILTER (NOT above), 1)::HUGEINT AS weights FROM c
), t AS (
  SELECT source, src, source_size, CASE WHEN above THEN 2.0 * source_size ELSE weight * rest / (2.0 * weights) END AS target,
    CASE WHEN above THEN 2 * source_size ELSE weight * rest // (2 * weights) END AS tokens
  FROM c, f
), p AS (
  SELECT d.doc_id, d.size, t.*, coalesce(sum(d.size) OVER (PARTITION BY d.source
    ORDER BY md5('mix|' || coalesce(d.doc_id::VARCHAR, '') || '|' || d.size), d.doc_id, d.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), a AS (
  SELECT src::BIGINT AS src, source_size::BIGINT AS source_size, tokens::BIGINT AS tokens, (source_size::BIGINT + 511) // 512 AS blocks,
    tokens::BIGINT // source_size::BIGINT * ((source_size::BIGINT + 511) // 512) + (tokens::BIGINT % source_size::BIGINT + 511) // 512 AS slots
  FROM t WHERE tokens > 0 AND source_size > 0
), b AS (
  SELECT *, (sum(slots) OVER (ORDER BY src) - slots)::DOUBLE / sum(slots) OVER () AS low,
    (sum(slots) OVER (ORDER BY src))::DOUBLE / sum(slots) OVER () AS high, (sum(slots) OVER ())::BIGINT AS n FROM a
), u AS (
  SELECT slot, point - floor(point) AS at FROM (
    SELECT range AS slot, CAST('GOLDEN_STEP' AS DOUBLE) * (range // 1048576) + CAST('GOLDEN' AS DOUBLE) * (range % 1048576) AS point
    FROM range((SELECT coalesce(any_value(n), 0) FROM b)))
), drawn AS (
  SELECT src, slot, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank FROM u JOIN b ON u.at >= b.low AND u.at < b.high
), got AS (
  SELECT src, count(*) AS got FROM drawn GROUP BY src
), ranked AS (
  SELECT src, slot, rank FROM drawn
  UNION ALL SELECT src, n + rank, rank FROM (
    SELECT b.src, n, unnest(range(coalesce(got, 0), slots)) AS rank FROM b LEFT JOIN got USING (src))
), taking AS (
  SELECT src, slot, rank % blocks AS block,
    least(512, source_size - rank % blocks * 512, tokens - rank // blocks * source_size - rank % blocks * 512) AS slot_tokens
  FROM ranked JOIN b USING (src) WHERE rank < slots
), pieces AS (
  SELECT *, unnest(range((begins // 512)::BIGINT, ((begins + size - 1) // 512 + 1)::BIGINT)) AS block FROM p WHERE size > 0
), met AS (
  SELECT q.doc_id, q.src, q.begins, k.slot,
    least(q.begins + q.size, q.block * 512 + k.slot_tokens) - greatest(q.begins, q.block * 512) AS words
  FROM pieces q JOIN taking k ON k.src = q.src AND k.block = q.block
), spread AS (
  SELECT src, begins, doc_id, min(slot) AS first_slot, count(*) AS n_slots FROM met WHERE words > 0 GROUP BY ALL
)
SELECT p.doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target::DOUBLE AS target,
  (CASE WHEN size = 0 THEN 0 ELSE size * (tokens // source_size)
    + greatest(0, least(size, tokens % source_size - p.begins)) END)::BIGINT AS taken,
  first_slot::BIGINT AS first_slot, coalesce(n_slots, 0)::BIGINT AS n_slots
FROM p LEFT JOIN spread ON size > 0 AND spread.src = p.src AND spread.begins = p.begins AND spread.doc_id IS NOT DISTINCT FROM p.doc_id
""".replace("GOLDEN_STEP", repr(math.fmod(_GOLDEN * 1048576, 1.0))).replace("GOLDEN", repr(_GOLDEN))

QUERIES = {"op10_low_discrepancy_mix": op10_low_discrepancy_mix}
ORACLES = {"op10_low_discrepancy_mix": _MIX_SQL}
