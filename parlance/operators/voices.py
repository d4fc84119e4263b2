"""Voice profiles: vector sums of fingerprints per name, matching, likeness, and changes of the profile tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.labels import normalized_name, same_name
from parlance.functions.vectors import dot, normalized, similarity, vector_sum
from parlance.operators.names import alike_pairs
from parlance.runtime import materialize, small_or_shuffled


def centroids(fingerprints: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """(by, centroid, n): the unit vector of each group's sum."""
    return vector_sum(fingerprints, by, vector).select(*by, normalized(F.col("sum")).alias("centroid"), "n")


#: Profiles that one block of a comparison holds.
PROFILES_PER_BLOCK = 20_000


def in_blocks(profiles: DataFrame, key: str) -> tuple[DataFrame, int]:
    """profiles (written first, and counted) with a column _block of a hash of the key, and the number of blocks."""
    written = materialize(profiles, "profiles")
    blocks = 1 + written.count() // PROFILES_PER_BLOCK
    return written.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")), blocks


def ranked(voices: DataFrame, profiles: DataFrame, voice: str, profile: str) -> DataFrame:
    """(voice, profile, similarity, place): the profiles of a voice in order of likeness.

    Each voice is a query against all profiles. These are cut into blocks of bounded size, and a voice joins every block by its
    number; the profiles are broadcast if they are counted to be few.
    """
    cut, blocks = in_blocks(profiles, profile)
    queries = voices.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = queries.join(small_or_shuffled(cut), "_block").withColumn("similarity", dot(F.col("v_centroid"), F.col("p_centroid")))
    w = Window.partitionBy(voice).orderBy(F.col("similarity").desc(), F.col(profile))
    return pairs.withColumn("place", F.row_number().over(w)).select(voice, profile, "similarity", "place")


def top_two(ranking: DataFrame, voice: str, profile: str) -> DataFrame:
    """(voice, profile, similarity, second): best profile, its likeness, and that of the next (null if there is none)."""
    first = F.when(F.col("place") == 1, F.struct(F.col(profile), F.col("similarity")))
    x = ranking.filter("place <= 2").groupBy(voice).agg(F.max(first).alias("_f"), F.max(F.when(F.col("place") == 2, F.col("similarity"))).alias("second"))
    return x.select(voice, F.col(f"_f.{profile}").alias(profile), F.col("_f.similarity").alias("similarity"), "second")


def accepted(best: DataFrame, least: float = 0.70, margin: float = 0.10) -> DataFrame:
    """Matches that are alike enough and far enough ahead of the next."""
    return best.filter((F.col("similarity") >= least) & (F.col("second").isNull() | (F.col("similarity") - F.col("second") >= margin)))


def look_alikes(people: DataFrame, key: str, least: float, apart: DataFrame) -> DataFrame:
    """(a, b, similarity), a < b: pairs of profiles at least so alike, but for those known to be apart (a, b in either order).

    Profiles are compared block by block: the left ones go to every block, the right ones to their own.
    """
    cut, blocks = in_blocks(people.select(F.col(key).alias("b"), F.col("centroid").alias("_cb")), "b")
    left = cut.select(F.col("b").alias("a"), F.col("_cb").alias("_ca"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    pairs = left.join(small_or_shuffled(cut), "_block").filter("a < b").withColumn("similarity", dot(F.col("_ca"), F.col("_cb"))).filter(F.col("similarity") >= least).drop("_ca", "_cb", "_block")
    both = apart.select("a", "b").union(apart.select("b", "a")).distinct()
    return pairs.join(both, ["a", "b"], "left_anti")


def learn(profiles: DataFrame, learned: DataFrame, forgotten: DataFrame, least: int = 8) -> DataFrame:
    """profiles (name, session_id, n, ...) after learning: each meeting's contribution replaces its former one.

    Blank names, names forgotten and contributions of fewer than `least` fingerprints teach nothing.
    """
    fit = learned.filter(F.col("n") >= least).filter("trim(name) <> ''").join(forgotten.select("name"), "name", "left_anti")
    kept = profiles.join(fit.select("name", "session_id"), ["name", "session_id"], "left_anti")
    return kept.unionByName(fit.select(*profiles.columns))


def forget(profiles: DataFrame, names: DataFrame) -> DataFrame:
    return profiles.join(names.select("name"), "name", "left_anti")


def move(profiles: DataFrame, moved: DataFrame) -> DataFrame:
    """Contributions (name, session_id) of `moved` go to the profile to_name; sums of one session are added up there."""
    x = profiles.join(moved, ["name", "session_id"], "left")
    x = x.withColumn("name", F.coalesce("to_name", "name")).drop("to_name")
    return x.groupBy("name", "session_id").agg(F.sum("n").alias("n"))


def rename(profiles: DataFrame, names: DataFrame) -> DataFrame:
    """Renames (name to new_name), keeping the old name as an alias."""
    x = profiles.join(names, "name", "left")
    return x.withColumn("alias", F.when(F.col("new_name").isNotNull(), F.col("name"))).withColumn("name", F.coalesce("new_name", "name")).drop("new_name")


def last_heard(profiles: DataFrame) -> DataFrame:
    """(name, at): when each profile of profiles (name, at, ...) was heard last."""
    return profiles.groupBy("name").agg(F.max("at").alias("at"))


def forget_meetings(profiles: DataFrame, excluded: DataFrame, meetings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """profiles (name, session_id, ...) without what `meetings` (name, session_id) taught, and excluded (name, session_id) with these,
    each once: they are never learnt from again."""
    kept = profiles.join(meetings.select("name", "session_id"), ["name", "session_id"], "left_anti")
    return kept, excluded.select("name", "session_id").union(meetings.select("name", "session_id")).distinct()


def start_over(profiles: DataFrame, excluded: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As forget_meetings, of all meetings of the profiles named; the names stay known through excluded."""
    return forget_meetings(profiles, excluded, profiles.join(names.select("name"), "name", "left_semi"))


def remove(profiles: DataFrame, apart: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """profiles without those named, and apart (a, b) without any mention of them."""
    gone = names.select("name")
    left = apart.join(gone.withColumnRenamed("name", "a"), "a", "left_anti").join(gone.withColumnRenamed("name", "b"), "b", "left_anti")
    return profiles.join(gone, "name", "left_anti"), left.select("a", "b")


def find(names: DataFrame, profiles: DataFrame) -> DataFrame:
    """names (name) with `profile` and `how`: the first profile (by number, of profiles (profile, number, alias)) with that name or
    alias exactly, else the first that it is alike; null if there is none. A profile has a row for its name and for each alias."""
    exact = names.join(profiles, F.col("name") == F.col("alias")).groupBy("name").agg(F.min(F.struct("number", "profile")).alias("_e"))
    open_ = names.join(exact, "name", "left_anti").select(F.col("name").alias("a")).distinct()
    near = alike_pairs(open_.select("a", normalized_name(F.col("a")).alias("a_key")), profiles.select(F.col("alias").alias("b"), normalized_name(F.col("alias")).alias("b_key"), "number", "profile"))
    fuzzy = near.groupBy(F.col("a").alias("name")).agg(F.min(F.struct("number", "profile")).alias("_f"))
    x = names.join(exact, "name", "left").join(fuzzy, "name", "left")
    how = F.when(F.col("_e").isNotNull(), "exact").when(F.col("_f").isNotNull(), "alike")
    return x.select("name", F.coalesce("_e.profile", "_f.profile").alias("profile"), how.alias("how"))


def unrejected(matches: DataFrame, rejected: DataFrame) -> DataFrame:
    """matches (voice, v_centroid, profile, similarity) but those whose voice is at least as like a voice once rejected for the
    profile, of rejected (profile, r_centroid)."""
    as_like = similarity(F.col("v_centroid"), F.col("r_centroid")) >= F.col("similarity")
    found = matches.join(rejected, "profile").filter(as_like).select("voice", "profile").distinct()
    return matches.join(found, ["voice", "profile"], "left_anti")


def called(speakers: DataFrame, matched: DataFrame, likest: DataFrame, known: DataFrame, doubt_above: float) -> DataFrame:
    """speakers (session_id, speaker, window, by_window) with verdict and name: what voices make of what the window calls them.

    matched: (session_id, speaker, name, similarity), one profile that a voice surely is; likest: the same, the most alike one at any
    likeness; known: (name) with a profile. Of a speaker that the window names, a match of another name overrules the window
    ('voice') only if the window's person has a profile, and is a doubt otherwise; so is a profile that is likest and alike enough
    when that person has one. Others take the matched name unless a speaker of the session has it already.
    """
    keys = ["session_id", "speaker"]
    m = matched.select(*keys, F.col("name").alias("_m"))
    l = likest.select(*keys, F.col("name").alias("_l"), F.col("similarity").alias("_ls"))
    k = known.select(F.col("name").alias("window"), F.lit(True).alias("_known"))
    x = speakers.join(m, keys, "left").join(l, keys, "left").join(k, "window", "left")
    same = lambda a, b: same_name(normalized_name(a), normalized_name(b))
    w, knows = F.col("window"), F.coalesce("_known", F.lit(False))
    other = F.col("_m").isNotNull() & ~same(w, F.col("_m"))
    unlike = F.col("_l").isNotNull() & ~same(w, F.col("_l")) & (F.col("_ls") >= doubt_above) & knows
    x = x.withColumn("verdict", F.when(F.col("by_window") & other & knows, "voice").when(F.col("by_window") & (other | unlike), "doubt").when(F.col("by_window"), "window"))
    x = x.withColumn("name", F.when(F.col("verdict") == "voice", F.col("_m")).when(F.col("verdict") == "doubt", F.coalesce(F.when(other, F.col("_m")), F.col("_l"))).when(F.col("by_window"), w))
    taken = x.filter("by_window").select("session_id", F.when(F.col("verdict") == "doubt", w).otherwise(F.col("name")).alias("_t"))
    free = x.filter("NOT by_window AND _m IS NOT NULL").select(*keys, "_m")
    used = free.join(taken, "session_id").filter(same(F.col("_t"), F.col("_m"))).select(*keys).distinct().withColumn("_used", F.lit(True))
    x = x.join(used, keys, "left")
    gives = ~F.col("by_window") & F.col("_m").isNotNull() & F.col("_used").isNull()
    return x.select(*keys, "window", F.when(gives, "voice").otherwise(F.coalesce("verdict", F.lit("open"))).alias("verdict"), F.when(gives, F.col("_m")).otherwise(F.col("name")).alias("name"))
