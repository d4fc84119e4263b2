"""Queries on business tables: the general relational operators, and rules that need no time line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import labels
from parlance.operators import names
from parlance.operators.sequence import evenly_thinned, every_nth, nearest_ranks
from parlance.plans.views import duckdb, load
from parlance.runtime import read_table


def join_inner_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per customer and nation, customers without orders included."""
    c, o, n = (read_table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("largest"))
    x = c.join(per, c["c_custkey"] == per["o_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"])
    return x.select("c_custkey", "n_name", F.coalesce("orders", F.lit(0)).cast("long").alias("orders"), "largest")


def join_full_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of open and of finished orders compared: added, removed, both."""
    o = read_table(spark, sf_dir, "orders")
    a = o.filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n_open"))
    b = o.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n_done"))
    x = a.join(b, "k", "full")
    return x.withColumn("change", F.when(F.col("n_open").isNull(), "removed").when(F.col("n_done").isNull(), "added").otherwise("both"))


def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with large orders (semi) and without any (anti), by segment."""
    c, o = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    big = c.join(o.filter("o_totalprice > 300000"), c["c_custkey"] == o["o_custkey"], "left_semi").withColumn("which", F.lit("large"))
    none = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").withColumn("which", F.lit("none"))
    return big.unionByName(none).groupBy("which", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def range_join_price_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line prices of a unit in bands around part prices, on bins of a hundred; equal keys bound what meets."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * 0.98).alias("low"), (F.col("p_retailprice") * 1.02).alias("high"))
    line = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    x = line.join(p, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("unit") >= F.col("low")) & (F.col("unit") < F.col("high")))
    return x.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))


def rollup_bucket_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read_table(spark, sf_dir, "lineitem")
    return line.rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 4).alias("discount"))


def cube_kind_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("largest"))


def grouping_sets_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and words by role, by speaker, and in all."""
    load(spark, sf_dir, "segments").createOrReplaceTempView("parlance_segments")
    return spark.sql("SELECT role, speaker, grouping_id(role, speaker) AS level, count(*) AS n, sum(n_words) AS words FROM parlance_segments GROUP BY GROUPING SETS ((role), (speaker), ())")


def rank_topk_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest parts of each brand, and the twenty of all."""
    p = read_table(spark, sf_dir, "part")
    w = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    best = p.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 3").select(F.lit("brand").alias("scope"), "p_brand", "p_partkey", "p_retailprice", "place")
    top = p.orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(20).select(F.lit("all").alias("scope"), "p_brand", "p_partkey", "p_retailprice", F.lit(0).cast("long").alias("place"))
    return best.unionByName(top)


def frame_rows_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order of a customer: sum of the last three, orders within thirty days, price before and after, rank."""
    o = read_table(spark, sf_dir, "orders").withColumn("day", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long"))
    w = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    near = Window.partitionBy("o_custkey").orderBy("day").rangeBetween(-30, 0)
    return o.select(
        "o_orderkey",
        F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"),
        F.count(F.lit(1)).over(near).alias("n30"),
        F.lag("o_totalprice").over(w).alias("before"),
        F.lead("o_totalprice").over(w).alias("after"),
        F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("day")).cast("long").alias("place"),
        F.ntile(4).over(w).cast("long").alias("quarter"),
    )


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with customers and with suppliers: union, intersection, difference; and all with multiplicity."""
    c = read_table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    s = read_table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    named = lambda df, op: df.select(F.lit(op).alias("op"), F.col("k").cast("long").alias("k"))
    parts = [named(c.union(s).distinct(), "union"), named(c.intersect(s), "intersect"), named(c.subtract(s), "except"), named(c.exceptAll(s), "except all"), named(c.intersectAll(s), "intersect all")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("op", "k").agg(F.count(F.lit(1)).alias("n"))


def approx_distinct_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of suppliers by return flag, and whether the approximate count is within five hundredths of the exact one."""
    x = read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_suppkey", 0.01).alias("about"), F.countDistinct("l_suppkey").alias("exact"))
    return x.select("l_returnflag", "exact", (F.abs(F.col("about") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


def nearest_rank_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and ninth decile by nearest rank, per event type and hour of the day."""
    e = load(spark, sf_dir, "event_ms").withColumn("hour", F.floor(F.col("t") / 3_600_000) % 24)
    return nearest_ranks(e, ["event_type", "hour"], "value", {"median": 0.5, "p90": 0.9})


def stream_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen in one day's snapshot and not the day before (added), or the reverse (removed)."""
    days = load(spark, sf_dir, "event_ms").select(F.floor(F.col("t") / 86_400_000).alias("day"), "user_id").distinct()
    seen = days.select("day").distinct()
    before = days.select((F.col("day") + 1).alias("day"), "user_id")
    added = days.join(before, ["day", "user_id"], "left_anti").join(seen.select((F.col("day") + 1).alias("day")), "day", "left_semi").withColumn("change", F.lit("added"))
    removed = before.join(days, ["day", "user_id"], "left_anti").join(seen, "day", "left_semi").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def grid_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of thresholds and shares scored on event values: right less twice wrong."""
    grid = spark.range(1, 10).select((F.col("id") * 10).alias("threshold")).crossJoin(spark.range(1, 4).select(F.col("id").alias("factor")))
    types = load(spark, sf_dir, "event_ms").groupBy("event_type", F.floor(F.col("value")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    x = grid.join(F.broadcast(types), F.col("v") * F.col("factor") >= F.col("threshold"))
    s = x.groupBy("threshold", "factor").agg(F.sum(F.when(F.col("event_type") == "purchase", F.col("n")).otherwise(0)).alias("right"), F.sum(F.when(F.col("event_type") == "error", F.col("n")).otherwise(0)).alias("wrong"))
    s = s.withColumn("score", F.col("right") - 2 * F.col("wrong"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "threshold", "factor")).cast("long"))


def worst_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each setting of grid_sweep with the least score one step away on either axis."""
    g = grid_sweep(spark, sf_dir).select("threshold", "factor", "score")
    n = g.select(F.col("threshold").alias("t2"), F.col("factor").alias("f2"), F.col("score").alias("s2"))
    near = (F.abs(F.col("threshold") - F.col("t2")) / 10 + F.abs(F.col("factor") - F.col("f2"))) == 1
    return g.join(F.broadcast(n), near, "left").groupBy("threshold", "factor").agg(F.first("score").alias("score"), F.min("s2").alias("worst"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the JSON properties, and a message built as JSON."""
    e = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    x = e.select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("with_k"), F.sum("k").alias("total"), F.max("k").alias("most"))
    return x.withColumn("message", F.to_json(F.struct("event_type", "with_k")))


def thin_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh event of a user, and twelve spread evenly."""
    e = load(spark, sf_dir, "event_ms").select("user_id", "event_id", "t")
    a = every_nth(e, ["user_id"], ["t", "event_id"], 7).withColumn("how", F.lit("nth"))
    return a.unionByName(evenly_thinned(e, ["user_id"], ["t", "event_id"], 12).withColumn("how", F.lit("even")))


def classify_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The platform that a url names, as from a window title."""
    p = read_table(spark, sf_dir, "pages").select("page_id", F.concat(F.element_at(F.array(F.lit("Zoom "), F.lit("Meet - "), F.lit("Slack | "), F.lit("WEBEX "), F.lit("Chat | Microsoft Teams "), F.lit("")), (F.col("page_id") % 6 + 1).cast("int")), "url").alias("title"))
    return p.select("page_id", labels.platform(F.col("title")).alias("platform"))


_LABELS = "CASE event_id % 12 WHEN 0 THEN 'You' WHEN 1 THEN 'Person ' || CAST(user_id AS STRING) WHEN 2 THEN 'Person 3 (Ann Lee)' WHEN 3 THEN 'Person 4 (Board Room)' WHEN 4 THEN 'Ann Lee' WHEN 5 THEN 'New speaker' WHEN 6 THEN 'Ann?' WHEN 7 THEN 'Room 7 (8)' WHEN 8 THEN 'Person 2 (Bo?)' WHEN 9 THEN '  ' WHEN 10 THEN 'ann' ELSE 'Harbour Zoom Room' END"


def classify_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = load(spark, sf_dir, "events").select("event_id", F.expr(_LABELS).alias("label"))
    c = F.col("label")
    return x.select("event_id", "label", labels.label_kind(c).alias("kind"), labels.label_person(c).alias("person"), labels.is_unnamed(c).alias("unnamed"), labels.without_headcount(c).alias("bare"))


def outcome_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of proposing a name for each label, counted."""
    x = classify_label(spark, sf_dir).withColumn("proposed", F.element_at(F.array(F.lit("Ann Lee"), F.lit("Ann Leee"), F.lit("Board Room"), F.lit("Cy Roe")), (F.floor(F.col("event_id") / 12) % 4 + 1).cast("int")))
    o = labels.outcome(F.col("kind"), F.col("person"), F.col("proposed"))
    return x.withColumn("outcome", o).groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("n"), F.max(labels.changes(F.col("outcome"))).alias("renames"))


def backup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old files with a session (semi), their copies' sizes (left), and what to do, counted."""
    o, line = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    old = o.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    copies = line.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size"))
    known = line.select("l_orderkey").distinct()
    with_session = old.join(known, old["o_orderkey"] == known["l_orderkey"], "left_semi").withColumn("has", F.lit(True))
    without = old.join(known, old["o_orderkey"] == known["l_orderkey"], "left_anti").withColumn("has", F.lit(False))
    x = with_session.unionByName(without).join(copies, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    outcome = F.when(~F.col("has"), "no_session").when(F.col("size").isNull(), "missing").when(F.col("size") != F.col("o_orderkey") % 7 + 1, "size_mismatch").otherwise("prune")
    return x.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of each name regardless of case, in order."""
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.initcap("c_mktsegment")).alias("name"))
    first = c.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("pos", "name")).alias("_f")).select("_f.pos", "_f.name")
    return first.withColumn("place", F.row_number().over(Window.orderBy("pos")).cast("long"))


def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names (with a letter lost) and the unique nearest name of another list within the edit limit; a tie snaps nothing."""
    p = read_table(spark, sf_dir, "part").select("p_name").distinct()
    read = p.select(F.concat(F.substring("p_name", 1, 3), F.expr("substring(p_name, 5)")).alias("name")).distinct()
    pairs = names.snapped_pairs(read, p.withColumnRenamed("p_name", "invitee"))
    d = pairs.withColumn("d", F.levenshtein("name", "invitee").cast("long"))
    best = d.withColumn("_m", F.min("d").over(Window.partitionBy("name"))).filter("d = _m").groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min("invitee").alias("invitee"), F.min("d").alias("d"))
    return read.join(best, "name", "left").select("name", F.when(F.col("_n") == 1, F.col("invitee")).otherwise(F.col("name")).alias("snapped"), F.coalesce("_n", F.lit(0)).cast("long").alias("candidates"))


QUERIES = [join_inner_left, join_full_diff, semi_anti, range_join_price_band, rollup_bucket_totals, cube_kind_outcome, grouping_sets_totals, rank_topk_settings, frame_rows_range, set_ops, approx_distinct_speakers, nearest_rank_quantiles, stream_set_diff, grid_sweep, worst_neighbour, json_props, thin_samples, classify_platform, classify_label, outcome_table, backup_plan, ordered_dedupe, fuzzy_names]

_ROOM = "regexp_matches(lower({x}), '(^|[^\\p{{L}}])rooms?([^\\p{{L}}]|$)')"
_GRID = """(SELECT *, "right" - 2 * wrong AS score FROM (SELECT threshold, factor, CAST(count(CASE WHEN event_type = 'purchase' THEN 1 END) AS BIGINT) AS "right", CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS BIGINT) AS wrong
    FROM (SELECT CAST(i * 10 AS BIGINT) AS threshold FROM range(1, 10) r(i)) a, (SELECT CAST(j AS BIGINT) AS factor FROM range(1, 4) r(j)) b, {events} e WHERE floor(e.value) * factor >= threshold GROUP BY threshold, factor) g)"""
_room = lambda x: _ROOM.format(x=x)
_LABELLED = f"""(SELECT event_id, label, CASE WHEN trim(label) = 'You' THEN 'mic' WHEN given <> '' THEN 'given' WHEN person AND inside <> '' AND NOT suffix(inside, '?') THEN 'named' WHEN person THEN 'placeholder' WHEN {_room("label")} THEN 'room' ELSE 'placeholder' END AS kind, inside, given, person FROM
    (SELECT *, CASE WHEN trim(label) IN ('', 'You') OR prefix(trim(label), 'Person ') OR prefix(trim(label), 'New speaker') OR suffix(trim(label), '?') OR suffix(trim(label), '?)') OR {_room("label")} THEN '' ELSE trim(label) END AS given,
      regexp_matches(trim(label), '^Person [0-9]+( \\(.*\\))?$') AS person, trim(regexp_extract(trim(label), '^Person [0-9]+ \\((.*)\\)$', 1)) AS inside FROM (SELECT event_id, {_LABELS} AS label FROM {{events}}) l) m)"""

_LOOSE = lambda a, b: f"(lower(trim({a})) = lower(trim({b})) OR least(strlen({a}), strlen({b})) >= 4 AND (starts_with(lower({a}), lower({b})) OR starts_with(lower({b}), lower({a}))) OR least(strlen({a}), strlen({b})) >= 5 AND levenshtein(lower({a}), lower({b})) <= greatest(1, greatest(strlen({a}), strlen({b})) // 8) OR (NOT contains({a}, ' ') OR NOT contains({b}, ' ')) AND {a} <> '' AND string_split(lower({a}), ' ')[1] = string_split(lower({b}), ' ')[1])"
_SQL = {
    "approx_distinct_speakers": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS exact, true AS close FROM {lineitem} GROUP BY 1",
    "outcome_table": f"""WITH x AS (SELECT c.*, ['Ann Lee', 'Ann Leee', 'Board Room', 'Cy Roe'][event_id // 12 % 4 + 1] AS p FROM (@CLASSIFIED) c),
        o AS (SELECT kind, CASE WHEN kind IN ('mic', 'room') THEN 'kept-' || kind WHEN kind = 'given' THEN CASE WHEN {_LOOSE('person', 'p')} THEN 'agree' ELSE 'kept-given' END
          WHEN kind = 'named' THEN CASE WHEN lower(person) = lower(p) THEN 'agree' WHEN {_LOOSE('person', 'p')} THEN 'spelling' WHEN {_room('p')} AND NOT {_room('person')} THEN 'kept-room' ELSE 'replace' END ELSE 'fill' END AS outcome FROM x)
        SELECT kind, outcome, CAST(count(*) AS BIGINT) AS n, outcome IN ('fill', 'spelling', 'replace') AS renames FROM o GROUP BY 1, 2""",
    "join_inner_left": "SELECT c_custkey, n_name, CAST(count(o_orderkey) AS BIGINT) AS orders, max(o_totalprice) AS largest FROM {customer} c JOIN {nation} n ON c_nationkey = n_nationkey LEFT JOIN {orders} o ON o_custkey = c_custkey GROUP BY c_custkey, n_name",
    "join_full_diff": "SELECT coalesce(a.k, b.k) AS k, n_open, n_done, CASE WHEN n_open IS NULL THEN 'removed' WHEN n_done IS NULL THEN 'added' ELSE 'both' END AS change FROM (SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS n_open FROM {orders} WHERE o_orderstatus = 'O' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS n_done FROM {orders} WHERE o_orderstatus = 'F' GROUP BY 1) b ON a.k = b.k",
    "semi_anti": "SELECT 'large' AS which, c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000) GROUP BY 2 UNION ALL SELECT 'none', c_mktsegment, CAST(count(*) AS BIGINT) FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders}) GROUP BY 2",
    "range_join_price_band": "SELECT l_partkey, CAST(count(*) AS BIGINT) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM {lineitem} JOIN {part} ON l_partkey = p_partkey AND l_extendedprice / l_quantity >= p_retailprice * 0.98 AND l_extendedprice / l_quantity < p_retailprice * 1.02 GROUP BY l_partkey",
    "rollup_bucket_totals": "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n, round(SUM(l_quantity), 2) AS quantity, round(avg(l_discount), 4) AS discount FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube_kind_outcome": "SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n, max(o_totalprice) AS largest FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets_totals": "SELECT role, speaker, CAST(grouping_id(role, speaker) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n, CAST(SUM(n_words) AS BIGINT) AS words FROM {segments} s GROUP BY GROUPING SETS ((role), (speaker), ())",
    "rank_topk_settings": "SELECT * FROM (SELECT 'brand' AS scope, p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM {part}) x WHERE place <= 3 UNION ALL SELECT * FROM (SELECT 'all', p_brand, p_partkey, p_retailprice, 0 FROM {part} ORDER BY p_retailprice DESC, p_partkey LIMIT 20) y",
    "frame_rows_range": """SELECT o_orderkey, round(SUM(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN 30 PRECEDING AND CURRENT ROW) AS BIGINT) AS n30,
        lag(o_totalprice) OVER w AS "before", lead(o_totalprice) OVER w AS "after", dense_rank() OVER (PARTITION BY o_custkey ORDER BY day) AS place, ntile(4) OVER w AS quarter FROM (SELECT *, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day FROM {orders}) o WINDOW w AS (PARTITION BY o_custkey ORDER BY day, o_orderkey)""",
    "set_ops": """WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS k FROM {customer} WHERE c_acctbal > 9000), s AS (SELECT CAST(s_nationkey AS BIGINT) AS k FROM {supplier} WHERE s_acctbal > 5000)
        SELECT op, k, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'union' AS op, k FROM (SELECT * FROM c UNION SELECT * FROM s) a UNION ALL SELECT 'intersect', k FROM (SELECT * FROM c INTERSECT SELECT * FROM s) b UNION ALL SELECT 'except', k FROM (SELECT * FROM c EXCEPT SELECT * FROM s) d
        UNION ALL SELECT 'except all', k FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM s) e UNION ALL SELECT 'intersect all', k FROM (SELECT * FROM c INTERSECT ALL SELECT * FROM s) f) g GROUP BY op, k""",
    "nearest_rank_quantiles": "SELECT event_type, hour, v[least(len(v) - 1, CAST(floor(len(v) * 0.5) AS BIGINT)) + 1] AS median, v[least(len(v) - 1, CAST(floor(len(v) * 0.9) AS BIGINT)) + 1] AS p90, CAST(len(v) AS BIGINT) AS n FROM (SELECT event_type, CAST(floor(t / 3600000) AS BIGINT) % 24 AS hour, list(value ORDER BY value) AS v FROM {event_ms} e GROUP BY 1, 2) x",
    "stream_set_diff": """WITH d AS (SELECT DISTINCT CAST(floor(t / 86400000) AS BIGINT) AS day, user_id FROM {event_ms} e)
        SELECT day, user_id, 'added' AS change FROM d WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.day = d.day - 1 AND b.user_id = d.user_id) AND EXISTS (SELECT 1 FROM d b WHERE b.day = d.day - 1)
        UNION ALL SELECT day + 1, user_id, 'removed' FROM d WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.day = d.day + 1 AND b.user_id = d.user_id) AND EXISTS (SELECT 1 FROM d b WHERE b.day = d.day + 1)""",
    "grid_sweep": f'SELECT *, row_number() OVER (ORDER BY score DESC, threshold, factor) AS place FROM {_GRID} g',
    "worst_neighbour": f"WITH g AS (SELECT threshold, factor, score FROM {_GRID} g) SELECT g.threshold, g.factor, g.score, min(n.score) AS worst FROM g LEFT JOIN g n ON abs(g.threshold - n.threshold) + 10 * abs(g.factor - n.factor) = 10 GROUP BY ALL",
    "json_props": """SELECT *, '{{"event_type":"' || event_type || '","with_k":' || with_k || '}}' AS message FROM (SELECT event_type, CAST(count(k) AS BIGINT) AS with_k, CAST(SUM(k) AS BIGINT) AS total, max(k) AS most FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {events}) e GROUP BY event_type) x""".replace("{{", "\x01").replace("}}", "\x02"),
    "thin_samples": """WITH e AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM {event_ms} x)
        SELECT user_id, event_id, t, 'nth' AS how FROM e WHERE r % 7 = 0 UNION ALL SELECT user_id, event_id, t, 'even' FROM e WHERE n <= 12 OR EXISTS (SELECT 1 FROM range(0, 12) i(i) WHERE i * n // 12 = r)""",
    "classify_platform": """SELECT page_id, CASE WHEN low LIKE '%microsoft teams%' THEN 'teams' WHEN low LIKE '%meet -%' OR low LIKE '%meet.google.com%' THEN 'meet' WHEN low LIKE '%zoom%' THEN 'zoom' WHEN low LIKE '%webex%' THEN 'webex' WHEN low LIKE '%slack%' THEN 'slack' ELSE 'unknown' END AS platform
        FROM (SELECT page_id, lower(['Zoom ', 'Meet - ', 'Slack | ', 'WEBEX ', 'Chat | Microsoft Teams ', ''][page_id % 6 + 1] || url) AS low FROM {pages}) p""",
    "classify_label": f"SELECT event_id, label, kind, CASE kind WHEN 'given' THEN given WHEN 'room' THEN trim(label) WHEN 'named' THEN inside ELSE '' END AS person, regexp_matches(label, '^Person [0-9]+$') OR (regexp_matches(label, '^Person [0-9]+ \\(.+\\)$') AND {_room('inside')}) AS unnamed, CASE WHEN {_room('label')} THEN regexp_replace(label, '\\s*\\([0-9]+\\)$', '') ELSE label END AS bare FROM {_LABELLED} x",
    "backup_plan": """SELECT CASE WHEN c.size IS NULL THEN 'no_session' WHEN c.size <> o_orderkey % 7 + 1 THEN 'size_mismatch' ELSE 'prune' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM {orders} o LEFT JOIN (SELECT l_orderkey, count(*) AS size FROM {lineitem} GROUP BY 1) c ON o_orderkey = l_orderkey WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1""",
    "ordered_dedupe": "SELECT pos, name, row_number() OVER (ORDER BY pos) AS place FROM (SELECT min(pos) AS pos, arg_min(name, pos) AS name FROM (SELECT c_custkey AS pos, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS name FROM {customer}) c GROUP BY lower(name)) x",
    "fuzzy_names": """WITH p AS (SELECT DISTINCT p_name FROM {part}), r AS (SELECT DISTINCT substring(p_name, 1, 3) || substring(p_name, 5) AS name FROM p), d AS (SELECT r.name, p.p_name, levenshtein(r.name, p.p_name) AS d FROM r, p WHERE levenshtein(r.name, p.p_name) <= least(2, greatest(length(r.name), length(p.p_name)) // 5)),
        b AS (SELECT name, count(*) AS n, min(p_name) AS invitee FROM (SELECT *, min(d) OVER (PARTITION BY name) AS m FROM d) x WHERE d = m GROUP BY name) SELECT r.name, CASE WHEN n = 1 THEN invitee ELSE r.name END AS snapped, CAST(coalesce(n, 0) AS BIGINT) AS candidates FROM r LEFT JOIN b ON r.name = b.name""",
}
_SQL["outcome_table"] = _SQL["outcome_table"].replace("@CLASSIFIED", _SQL["classify_label"])
ORACLES = {k: duckdb(v).replace("\x01", "{").replace("\x02", "}") for k, v in _SQL.items()}
