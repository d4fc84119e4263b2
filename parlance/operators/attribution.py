"""Who spoke a line: overlap with turns, votes of names, absorption of small speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.timefmt import word_at
from parlance.operators.joins import interval_join, point_join


def attribute_lines(lines: DataFrame, turns: DataFrame, bin_ms: int = 600_000) -> DataFrame:
    """lines (session_id, pos, start_ms, end_ms, ...) with turn_pos, cluster and overlap_ms of the turn of largest overlap.

    Overlap must be positive; of equal ones the first turn wins; -1 for lines without.
    """
    r = turns.select("session_id", "turn_pos", "cluster", F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms"))
    pairs = interval_join(lines.select("session_id", "pos", "start_ms", "end_ms"), r, ["session_id"], bin_ms)
    best = pairs.groupBy("session_id", "pos").agg(F.max(F.struct("overlap_ms", (-F.col("turn_pos")).alias("_n"), "cluster")).alias("_b"))
    best = best.select("session_id", "pos", (-F.col("_b._n")).alias("turn_pos"), F.col("_b.cluster").alias("cluster"), F.col("_b.overlap_ms").alias("overlap_ms"))
    return lines.join(best, ["session_id", "pos"], "left").fillna(-1, ["turn_pos", "cluster"]).fillna(0, ["overlap_ms"])


def top_name(votes: DataFrame, by: list[str], name: str, weight: str) -> DataFrame:
    """Per group the name of largest weight; ties: the longer, then the first by alphabet. votes has one row per (by, name)."""
    w = Window.partitionBy(*by).orderBy(F.col(weight).desc(), F.length(name).desc(), F.col(name))
    return votes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def words_by_turn(words: DataFrame, turns: DataFrame, fallback: int = -1) -> DataFrame:
    """words (session_id, pos, w_pos, start_ms, end_ms) with the cluster of the shortest turn that holds them.

    Words in no turn take the cluster of the word before in their line, leading ones that of the next, else fallback.
    """
    at = words.withColumn("_at", word_at(F.col("start_ms"), F.col("end_ms")))
    t = turns.select("session_id", "turn_pos", "cluster", F.col("start_ms").alias("t_start"), F.col("end_ms").alias("t_end"))
    hit = point_join(at.select("session_id", "pos", "w_pos", "_at"), t, ["session_id"], "_at", ("t_start", "t_end"))
    best = hit.groupBy("session_id", "pos", "w_pos").agg(F.min(F.struct((F.col("t_end") - F.col("t_start")).alias("_l"), "turn_pos", "cluster")).alias("_b")).select("session_id", "pos", "w_pos", F.col("_b.cluster").alias("_c"))
    x = at.drop("_at").join(best, ["session_id", "pos", "w_pos"], "left")
    w = Window.partitionBy("session_id", "pos").orderBy("w_pos")
    before = F.last("_c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_c", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return x.withColumn("cluster", F.coalesce(before, after, F.lit(fallback))).drop("_c")


def word_runs(words: DataFrame) -> DataFrame:
    """Runs of equal cluster within a line: session_id, pos, run, cluster, n_words, start_ms, end_ms, text."""
    w = Window.partitionBy("session_id", "pos").orderBy("w_pos")
    x = words.withColumn("_new", F.coalesce((F.col("cluster") != F.lag("cluster").over(w)).cast("long"), F.lit(0)))
    x = x.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("w_pos", "word"))), lambda s: s["word"]), " ")
    return x.groupBy("session_id", "pos", "run").agg(F.first("cluster").alias("cluster"), F.count(F.lit(1)).alias("n_words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), text.alias("text"))


def absorb_runs(runs: DataFrame, least_ms: int = 250) -> DataFrame:
    """Runs shorter than least_ms join the run before (a short first run the one after); equal neighbours become one.

    An ordered rule per line, so a fold; a line's runs are few.
    """
    import pandas as pd

    from parlance.operators.sequence import fold

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for row in pdf.to_dict("records"):
            short = row["end_ms"] - row["start_ms"] < least_ms
            if out and (short or out[-1]["cluster"] == row["cluster"]):
                out[-1]["end_ms"] = row["end_ms"]
                out[-1]["n_words"] += row["n_words"]
                out[-1]["text"] += " " + row["text"]
            else:
                out.append(dict(row))
        if len(out) > 1 and out[0]["end_ms"] - out[0]["start_ms"] < least_ms:
            first = out.pop(0)
            out[0] |= {"start_ms": first["start_ms"], "n_words": first["n_words"] + out[0]["n_words"], "text": first["text"] + " " + out[0]["text"]}
        return pd.DataFrame([x | {"run": k} for k, x in enumerate(out)], columns=pdf.columns)

    kinds = dict(runs.dtypes)
    return fold(runs, ["session_id", "pos"], ["run"], step, ", ".join(f"{c} {kinds[c]}" for c in runs.columns))


def absorb_small_speakers(lines: DataFrame, least_words: int, near_ms: int = 2000) -> DataFrame:
    """lines (session_id, pos, speaker, n_words, start_ms, end_ms) with new_speaker.

    A line of a speaker of fewer than least_words takes the speaker of the last line before it of a large speaker if that
    ended less than near_ms ago, else of the next one, else of the previous. Judged on the labels as they were.
    """
    words = F.sum("n_words").over(Window.partitionBy("session_id", "speaker"))
    x = lines.withColumn("_small", words < least_words)
    kept = F.when(~F.col("_small"), F.struct("speaker", "end_ms"))
    w = Window.partitionBy("session_id").orderBy("start_ms", "pos")
    x = x.withColumn("_p", F.last(kept, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_n", F.first(kept, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    near = F.when(F.col("start_ms") - F.col("_p.end_ms") < near_ms, F.col("_p.speaker"))
    new = F.when(F.col("_small"), F.coalesce(near, F.col("_n.speaker"), F.col("_p.speaker"), F.col("speaker"))).otherwise(F.col("speaker"))
    return x.withColumn("new_speaker", new).drop("_small", "_p", "_n")


def decide_names(reads: DataFrame, by: list[str], least_reads: int, share: tuple[int, int]) -> DataFrame:
    """reads (by, name, bucket): per group the name read in most buckets, if in least_reads and in share (a of b) of all."""
    n = reads.groupBy(*by, "name").agg(F.countDistinct("bucket").alias("n"))
    everyone = Window.partitionBy(*by)
    x = n.withColumn("total", F.sum("n").over(everyone)).withColumn("_r", F.row_number().over(everyone.orderBy(F.col("n").desc(), "name")))
    return x.filter((F.col("_r") == 1) & (F.col("n") >= least_reads) & (F.col("n") * share[1] >= F.col("total") * share[0])).drop("_r")


def merged_spans(df: DataFrame, by: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """The union of the spans of each group, as disjoint spans."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = df.withColumn("_new", F.coalesce((F.col(start) > reach).cast("long"), F.lit(1)))
    x = x.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*by, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def frames(ms: Column, step: int = 100) -> Column:
    return F.floor(ms / step).cast("long")


def contingency(ref: DataFrame, hyp: DataFrame, ref_label: str, hyp_label: str, step: int = 100) -> DataFrame:
    """(session_id, hyp, ref, frames): frames of `step` ms in which both labels are active.

    Frames of a span are a range, so counts follow from range overlaps; no row per frame is made.
    """
    a = merged_spans(ref.select("session_id", F.col(ref_label).alias("ref"), frames(F.col("start_ms"), step).alias("start_ms"), frames(F.col("end_ms"), step).alias("end_ms")), ["session_id", "ref"])
    b = merged_spans(hyp.select("session_id", F.col(hyp_label).alias("hyp"), frames(F.col("start_ms"), step).alias("r_start_ms"), frames(F.col("end_ms"), step).alias("r_end_ms")), ["session_id", "hyp"], "r_start_ms", "r_end_ms")
    pairs = interval_join(a, b, ["session_id"], 6000)
    return pairs.groupBy("session_id", "hyp", "ref").agg(F.sum("overlap_ms").alias("frames"))
