"""Work lists: what still has to be generated, verified or evaluated.

The grids are map-side generators over fixed lists (18 cells, the requested models), not
joins. Where finished work has to be taken out, it is first folded to one small row per
instance or sample, so a sample's text crosses the shuffle once and not once per cell or
model; the grid is unfolded after the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demur import vocab
from demur.functions.columns import col, literal_array, only_value
from demur.functions.keys import perturbation_id
from demur.plans.shared import materialise

_ALL_CELLS = (1 << len(vocab.CELLS)) - 1


def _cells() -> Column:
    return F.array(*[F.struct(F.lit(c).alias("perturbation_class"), F.lit(i).alias("intensity")) for c, i in vocab.CELLS])


def perturbation_grid(instances: DataFrame) -> DataFrame:
    """Every instance with each of the 18 (class, intensity) cells."""
    return instances.select("*", F.inline(_cells()))


def evaluation_grid(samples: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every sample with each requested model."""
    return samples.select("*", F.explode(literal_array(models)).alias("model_id"))


def remaining(samples: DataFrame, done: DataFrame, models: Sequence[str], ident: str = "sample_id") -> DataFrame:
    """The evaluation grid without finished (sample, model) pairs."""
    finished = (
        done.filter(col("model_id").isin(*models)).select(ident, "model_id")
        .groupBy(ident).agg(F.collect_set("model_id").alias("_done"))  # at most len(models) values
    )
    todo = F.array_except(literal_array(models), F.coalesce("_done", F.array().cast("array<string>")))
    return samples.join(finished.hint("merge"), ident, "left").withColumn("model_id", F.explode(todo)).drop("_done")


#: keys that are broadcast, at about 100 bytes each
MAX_KEYS = 500_000


def _with_finished(rewrites: DataFrame, key: Column, finished: DataFrame, every: int) -> DataFrame:
    """Rewrites that miss some of the bits of ``every``, with the bits they have as ``_mask``; no text is shuffled
    while either the unfinished keys or those with anything finished can be broadcast.

    What is unfinished is found on keys alone, in a shuffle (the planner does not know how many
    keys a log has), and written. Only where both kinds of key are
    very many do the rewrites themselves meet them in a shuffle.
    """
    keys = rewrites.select(key.alias("_key")).distinct()
    state = keys.join(finished.hint("merge"), "_key", "left").withColumn("_mask", F.coalesce("_mask", F.lit(0)))
    state = materialise(state, "resume")
    unfinished, touched = state.filter(col("_mask") != every), state.filter(col("_mask") != 0)
    n_unfinished, n_touched = state.agg(F.count_if(col("_mask") != every), F.count_if(col("_mask") != 0)).first()
    keyed = rewrites.withColumn("_key", key)
    if n_touched <= MAX_KEYS and n_touched < n_unfinished:
        joined = keyed.join(F.broadcast(touched), "_key", "left").withColumn("_mask", F.coalesce("_mask", F.lit(0)))
        return joined.filter(col("_mask") != every).drop("_key")
    right = F.broadcast(unfinished) if n_unfinished <= MAX_KEYS else unfinished.hint("merge")
    return keyed.join(right, "_key").drop("_key")


def remaining_verifications(rewrites: DataFrame, done: DataFrame, kind: str = "single", prefix: int | None = None) -> DataFrame:
    """Rewrites whose resume key is not in the verification log (``prefix``: the older, cut key)."""
    key = perturbation_id(kind) if prefix is None else F.md5(perturbation_id(kind, prefix))
    finished = done.select(key.alias("_key")).distinct().withColumn("_mask", F.lit(1))
    return _with_finished(rewrites, key, finished, 1).drop("_mask")


def remaining_by_verifier(rewrites: DataFrame, log: DataFrame, verifiers: Sequence[str], kind: str = "single") -> DataFrame:
    """Rewrites that some verifier has not voted on, with these verifiers as the array ``pending``, in one pass over the log."""
    if len(verifiers) > 30:
        raise ValueError("at most 30 verifiers at a time")
    key = perturbation_id(kind)
    bit = F.lit(0)
    for i, v in enumerate(verifiers):
        bit = F.when(col("verifier_model") == v, 1 << i).otherwise(bit)
    finished = log.filter(col("verifier_model").isin(*verifiers)).select(key.alias("_key"), bit.alias("_bit"))
    finished = finished.groupBy("_key").agg(F.bit_or("_bit").alias("_mask"))
    rows = _with_finished(rewrites, key, finished, (1 << len(verifiers)) - 1)
    names = [F.when(col("_mask").bitwiseAND(F.lit(1 << i)) == 0, F.lit(v)) for i, v in enumerate(verifiers)]
    return rows.withColumn("pending", F.array_compact(F.array(*names))).drop("_mask")


def _cell_mask() -> Column:
    """Bit of the row's cell; one further bit for a cell outside the 18."""
    position = F.array_position(literal_array([f"{c}|{i}" for c, i in vocab.CELLS]), F.concat_ws("|", "perturbation_class", "intensity"))
    bit = F.when(position > 0, position - 1).otherwise(len(vocab.CELLS)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def finished_cells(done: DataFrame) -> DataFrame:
    """Per question: mask and number of successful generations, complete or not."""
    ok = done.filter("generation_successful AND source_qid IS NOT NULL").select("source_qid", _cell_mask().alias("_bit"))
    return (
        ok.groupBy("source_qid").agg(F.bit_or("_bit").alias("mask"), F.count(F.lit(1)).alias("successes"))
        .withColumn("is_complete", (col("mask") == _ALL_CELLS) & (col("successes") == len(vocab.CELLS)))
    )


def missing_cells(instances: DataFrame, done: DataFrame, target: int | None = None, ident: str = "qid") -> DataFrame:
    """Cells still to be generated, for as many unfinished instances (in line order) as
    are needed to reach ``target`` complete ones; all of them without a target.

    An instance that has every cell but not exactly once is not complete and has nothing
    missing; it is passed over.
    """
    finished = finished_cells(done)
    joined = instances.join(finished.withColumnRenamed("source_qid", ident).hint("merge"), ident, "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
    todo = F.filter(
        F.transform(_cells(), lambda c, i: F.struct(c["perturbation_class"], c["intensity"], i.alias("i"))),
        lambda c: F.call_function("shiftright", col("mask"), c["i"]).bitwiseAND(F.lit(1)) == 0,
    )
    open_ones = joined.withColumn("_todo", todo).filter(F.size("_todo") > 0).drop("mask", "successes", "is_complete")
    if target is not None:
        complete = only_value(finished.agg(F.count_if("is_complete")))
        # the constant bound keeps this to ``target`` rows before the exact number is applied
        few = open_ones.orderBy("line_no").limit(target)
        place = F.row_number().over(Window.orderBy("line_no"))
        open_ones = few.withColumn("_place", place).filter(col("_place") <= F.lit(target) - complete).drop("_place")
    cell = F.explode(F.transform("_todo", lambda c: F.struct(c["perturbation_class"], c["intensity"])))
    return open_ones.withColumn("_cell", cell).select(
        *[c for c in open_ones.columns if c != "_todo"], col("_cell.perturbation_class"), col("_cell.intensity")
    )


def attach(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their replies by request_id; without a reply a request is pending.

    Of several replies to one request the last successful one counts, by ``seq`` where the
    replies have it (without it by their text, which at least is repeatable). Replies are as
    many as requests, so both meet in a shuffle.
    """
    error = col("error") if "error" in responses.columns else F.lit(None).cast("string")
    seq = col("seq") if "seq" in responses.columns else F.lit(0)
    reply = F.struct(error.isNull().alias("ok"), seq.alias("seq"), "response", error.alias("error"))
    replies = responses.groupBy("request_id").agg(F.max(reply).alias("_reply"))
    joined = requests.join(replies.hint("merge"), "request_id", "left")
    return joined.withColumns({
        "response": col("_reply.response"), "error": col("_reply.error"), "pending": col("_reply").isNull()
    }).drop("_reply")
