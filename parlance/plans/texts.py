"""Queries on words: tokens, trigrams, alignments, differences, terms; exports and session lists; signal arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import signal, text, timefmt
from parlance.operators.sequence import fold
from parlance.plans import timeline
from parlance.plans.views import duckdb, load
from parlance.runtime import materialize, read_table, ship, small_or_shuffled
from parlance.sources import transcripts


def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of all documents with their counts, for words of three letters and more."""
    d = read_table(spark, sf_dir, "documents").select(F.explode(text.text_words_column(F.col("text"))).alias("word"))
    return d.filter(F.length("word") >= 3).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def text_shift_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word sequences said once in a conversation and once in its external copy, and the time between them."""

    def unique(df: DataFrame, at: str) -> DataFrame:
        w = Window.partitionBy("session_id").orderBy("pos", "w_pos")
        x = df.withColumn("gram", F.concat_ws(" ", F.lower("word"), F.lower(F.lead("word", 1).over(w)), F.lower(F.lead("word", 2).over(w)))).withColumn("_full", F.lead("word", 2).over(w).isNotNull())
        return x.filter("_full").groupBy("session_id", "gram").agg(F.count(F.lit(1)).alias("_n"), F.min("start_ms").alias(at)).filter("_n = 1").drop("_n")

    words = load(spark, sf_dir, "words")
    other = words.withColumn("start_ms", F.col("start_ms") + 37_000 + F.col("w_pos") % 3 * 400)
    pairs = unique(words, "a").join(unique(other, "b"), ["session_id", "gram"]).withColumn("d", F.col("b") - F.col("a"))
    near = pairs.withColumn("_in", F.count(F.lit(1)).over(Window.partitionBy("session_id").orderBy("d").rangeBetween(0, 5000)))
    first = near.groupBy("session_id").agg(F.count(F.lit(1)).alias("anchors"), F.max("_in").alias("densest"))
    low = near.join(first, "session_id").filter("_in = densest").groupBy("session_id").agg(F.max("anchors").alias("anchors"), F.max("densest").alias("densest"), F.min("d").alias("_low"))
    inside = pairs.join(low, "session_id").filter("d BETWEEN _low AND _low + 5000")
    return inside.groupBy("session_id").agg(F.max("anchors").alias("anchors"), F.max("densest").alias("densest"), F.percentile("d", F.lit(0.5)).alias("shift"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation lines beside the next line of the same session, as arrays of all their words."""
    w = Window.partitionBy("session_id").orderBy("pos")
    x = load(spark, sf_dir, "segments").withColumn("ref", F.split("text", " "))
    return x.withColumn("hyp", F.coalesce(F.lead("ref").over(w), F.array())).select("session_id", "pos", "ref", "hyp")


def _document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents (ref) beside the document of the next doc_id (hyp) where it is of the same language."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("ref"))
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), "lang", F.col("ref").alias("hyp")), ["doc_id", "lang"])


def word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least word edits from each document to the next of its language, by kind, over all their normalized words."""
    ship(spark)
    x = _document_pairs(spark, sf_dir)
    return x.select("doc_id", text.text_error_counts_udf("ref", "hyp").alias("c")).select("doc_id", "c.*")


def word_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least word edits between each line and the next."""
    ship(spark)
    c = text.error_counts_udf("ref", "hyp")
    return _pairs(spark, sf_dir).select("session_id", "pos", c.alias("c")).select("session_id", "pos", (F.col("c.substitutions") + F.col("c.deletions") + F.col("c.insertions")).alias("edits"))


_DISTANCE = """
    WITH RECURSIVE l AS (SELECT session_id, pos, string_split(text, ' ') AS ref, coalesce(lead(string_split(text, ' ')) OVER (PARTITION BY session_id ORDER BY pos), []) AS hyp FROM {segments} s),
    d AS (SELECT session_id, pos, ref, hyp, 0 AS i, range(0, len(hyp) + 1) AS dist FROM l
      UNION ALL SELECT session_id, pos, ref, hyp, i + 1, list_reduce(list_transform(range(1, len(hyp) + 1), lambda j: [CAST(least(dist[j] + CASE WHEN hyp[j] = ref[i + 1] THEN 0 ELSE 1 END, dist[j + 1] + 1) AS BIGINT)]), lambda acc, x: list_append(acc, least(acc[len(acc)] + 1, x[1])), [CAST(i + 1 AS BIGINT)]) FROM d WHERE i < len(ref))
    SELECT session_id, pos, dist[len(dist)] AS edits FROM d WHERE i = len(ref)"""


def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of differing words between each document and the next of its language, counted by kind."""
    ship(spark)
    x = _document_pairs(spark, sf_dir).select("lang", F.explode(text.text_diff_hunks_udf("ref", "hyp")).alias("h"))
    return x.groupBy("lang", "h.kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h.ref_to") - F.col("h.ref_from")).alias("ref_words"), F.sum(F.col("h.hyp_to") - F.col("h.hyp_from")).alias("hyp_words"))


def normalize_words_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the scoring normalizer per document: how many, and a digest of them."""
    ship(spark)
    return read_table(spark, sf_dir, "documents").select("doc_id", text.words_digest_udf("text").alias("w")).select("doc_id", "w.*")


def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each benchmark item stands in documents word by word, and in how many documents."""
    items = read_table(spark, sf_dir, "benchmark").select(text.text_words_column(F.col("text")).alias("words")).filter("size(words) > 0").distinct()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text.text_words_column(F.col("text")).alias("w"))
    hits = term_positions(docs, items)
    return hits.groupBy(F.array_join("words", " ").alias("term")).agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("doc_id").alias("docs"))


#: Words of a term that it is looked up by, and distinct first words that are tested before a gram is made.
LOOKED_UP, FIRSTS = 3, 10_000


def term_positions(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, at, words): where the terms (words: an array, of any length) stand in docs (doc_id, w: an array).

    A term is looked up by its first words: a gram of a document is made only where the first word of a term stands (if those are few
    enough to test for), joined to the terms that begin so, and the rest compared in place.
    """
    t = terms.select("words", F.least(F.size("words"), F.lit(LOOKED_UP)).alias("k"))
    t = materialize(t.withColumn("gram", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ")), "terms")
    firsts = [r[0] for r in t.select(F.element_at("words", 1)).distinct().limit(FIRSTS + 1).collect()]
    longest = t.agg(F.max(F.size("words"))).first()[0] or 1
    places = F.sequence(F.lit(1), F.size("w"))
    if len(firsts) <= FIRSTS:
        places = F.filter(places, lambda i: F.element_at("w", i).isin(firsts))
    found = None
    for k in range(1, LOOKED_UP + 1):
        own = t.filter(F.col("k") == k)
        grams = F.transform(places, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("w", i, F.lit(k)), " ").alias("gram"), F.slice("w", i, F.lit(longest)).alias("rest")))  # noqa: B023
        if own.isEmpty():
            continue
        x = docs.filter(F.size("w") >= k).select("doc_id", F.explode(grams).alias("g")).select("doc_id", "g.*").join(small_or_shuffled(own), "gram")
        x = x.filter(F.slice("rest", F.lit(1), F.size("words")) == F.col("words")).select("doc_id", "at", "words")
        found = x if found is None else found.unionByName(x)
    return found if found is not None else docs.select("doc_id", F.lit(0).alias("at"), F.col("w").alias("words")).limit(0)


def spot_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in lines (their fourth to sixth word, between the two before and the two after) that a later version still has right."""
    ship(spark)

    def score(batches):
        import pandas as pd

        for pdf in batches:
            rows = [text.score_spots(text.text_words(r), text.text_words(h), [(b, w, a, s)])[0] for r, h, b, w, a, s in zip(pdf["ref"], pdf["hyp"], pdf["before"], pdf["words"], pdf["after"], pdf["share"])]
            yield pd.DataFrame({"session_id": pdf["session_id"], "pos": pdf["pos"], "found": [f for f, _ in rows], "fixed": [f for _, f in rows]})

    s = load(spark, sf_dir, "segments").withColumn("w", text.text_words_column(F.col("text"))).filter("size(w) >= 8")
    # the later version loses every third word that is long, from the session's place on
    hyp = F.array_join(F.filter("w", lambda x, i: (i + F.col("session_id")) % 5 != 0), " ")
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    x = s.select("session_id", "pos", F.array_join("w", " ").alias("ref"), hyp.alias("hyp"), part(2, 2).alias("before"), part(4, 3).alias("words"), part(7, 2).alias("after"), (F.lit(1) / F.size("w")).alias("share"))
    return x.mapInPandas(score, "session_id long, pos long, found boolean, fixed boolean")


def word_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a session, every seventh replaced and every eleventh lost, given to the turns whose words they are aligned with."""
    ship(spark)

    def step(pdf):
        import pandas as pd

        turns = [t.split(" ") for t in pdf["text"]]
        words = [w for t in turns for w in t]
        hyp = [("x" if i % 7 == 3 else w) for i, w in enumerate(words) if i % 11 != 5]
        found = pd.Series(text.turns_of_words(turns, hyp)).value_counts()
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[0], "pos": pdf["pos"], "words": [int(found.get(k, 0)) for k in range(len(turns))]})

    return fold(load(spark, sf_dir, "segments").select("session_id", "pos", "text"), ["session_id"], ["pos"], step, "session_id long, pos long, words long")


def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of part names folded within a brand: most frequent first, each joins the first leader it equals but for an edit or is the beginning of."""
    ship(spark)

    def step(pdf):
        import pandas as pd

        leaders: list[str] = []
        out = []
        for name in pdf.sort_values(["n", "name"], ascending=[False, True])["name"]:
            leader = next((x for x in leaders if _same(x, name)), None)
            if leader is None:
                leaders.append(name)
                leader = name
            out.append({"name": name, "canonical": leader})
        return pd.DataFrame(out, columns=["name", "canonical"]).assign(p_brand=pdf["p_brand"].iloc[0])

    n = read_table(spark, sf_dir, "part").select("p_brand", F.explode(F.array("p_name", F.expr("left(p_name, length(p_name) - 2)"))).alias("name")).groupBy("p_brand", "name").agg(F.count(F.lit(1)).alias("n"))
    return fold(n, ["p_brand"], ["name"], step, "p_brand string, name string, canonical string")


def _same(a: str, b: str) -> bool:
    short, long = sorted((a, b), key=lambda x: len(x.encode()))
    n, m = len(short.encode()), len(long.encode())
    if a == b or (n >= 4 and long.startswith(short)):
        return True
    return n >= 5 and text.word_distance(list(a), list(b)) <= max(1, m // 8)


def export_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.srt(load(spark, sf_dir, "segments"), "session_id")


def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.paragraphs_text(timeline.paragraphs(spark, sf_dir), "session_id", True)


def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.paragraphs_text(timeline.paragraphs(spark, sf_dir), "session_id", False)


def session_list_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of an id prefix that have others' lines and last half a minute, longest first."""
    s = load(spark, sf_dir, "segments").groupBy("session_id").agg(F.max("end_ms").alias("length_ms"), F.count(F.lit(1)).alias("lines"), F.bool_or(F.col("source") == "monitor").alias("monitor"))
    x = s.filter(F.startswith(F.col("session_id").cast("string"), F.lit("1")) & F.col("monitor") & (F.col("length_ms") >= 30_000)).drop("monitor")
    return x.withColumn("place", F.row_number().over(Window.orderBy(F.col("length_ms").desc(), "session_id")).cast("long"))


def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of lines as clock texts, and read back."""
    s = load(spark, sf_dir, "segments")
    seconds = F.col("start_ms") / 1000
    clock = timefmt.clock(seconds)
    return s.select("session_id", "pos", timefmt.srt_timestamp(F.col("start_ms")).alias("srt"), timefmt.timestamp_floored(seconds).alias("floored"), clock.alias("clock"), timefmt.parse_clock(clock).alias("parsed"))


def signal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values of a user as samples: mean removed, peak normalized, gated; level and what is left."""
    e = load(spark, sf_dir, "event_ms").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "event_id", "value"))), lambda s: s["value"]).alias("x"))
    flat = signal.normalize_peak(signal.remove_dc(F.col("x")))
    x = e.select("user_id", "x", flat.alias("y")).withColumn("z", signal.noise_gate(F.col("y"), -6.0))
    return x.select("user_id", F.round(signal.level_db(F.col("y")), 4).alias("level"), F.size(F.filter("z", lambda v: v != 0)).cast("long").alias("kept"), signal.has_signal(F.col("y")).alias("signal"))


QUERIES = [spot_words, word_turns, word_tokens, text_shift_anchors, word_errors, word_distance, diff_hunks, normalize_words_full, term_hits, canonical_names, export_srt, export_markdown, export_text, session_list_prefix, clock_texts, signal_chain]

_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{Nd}'']+'), lambda w: w <> '')"
_HMS = "printf('%02d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60)"
_SRT = lambda c: f"printf('%02d:%02d:%02d,%03d', {c} // 3600000, {c} % 3600000 // 60000, {c} % 60000 // 1000, {c} % 1000)"
_PARAGRAPHS = "(" + timeline._SQL["paragraphs"] + ")"
_ROUND = _HMS.replace("{s}", "CAST(round(start_ms / 1000) AS BIGINT)")
_LENGTH = "CASE WHEN d >= 3600 THEN printf('%dh%02dm%02ds', d // 3600, d % 3600 // 60, d % 60) WHEN d >= 60 THEN printf('%dm%02ds', d // 60, d % 60) ELSE printf('%ds', d) END"
_DOCUMENT = "SELECT session_id, @HEAD || body AS document FROM (SELECT session_id, CAST(round(max(end_ms) / 1000) AS BIGINT) AS d, string_agg(@LINE, '' ORDER BY paragraph) AS body FROM " + _PARAGRAPHS + " p GROUP BY session_id) x"
_SQL = {
    "canonical_names": """WITH RECURSIVE n AS (SELECT p_brand, name, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, name) AS rn FROM (SELECT p_brand, unnest([p_name, left(p_name, length(p_name) - 2)]) AS name FROM {part}) a GROUP BY 1, 2),
        w AS (SELECT p_brand, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS leaders, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS canonical FROM (SELECT DISTINCT p_brand FROM n) u
          UNION ALL SELECT p_brand, rn, CASE WHEN hit IS NULL THEN list_append(leaders, name) ELSE leaders END, name, coalesce(hit, name)
          FROM (SELECT n.p_brand, n.rn, n.name, w.leaders, list_filter(w.leaders, lambda l: l = n.name OR least(strlen(l), strlen(n.name)) >= 4 AND (starts_with(l, n.name) OR starts_with(n.name, l)) OR least(strlen(l), strlen(n.name)) >= 5 AND levenshtein(l, n.name) <= greatest(1, greatest(strlen(l), strlen(n.name)) // 8))[1] AS hit
            FROM w JOIN n ON n.p_brand = w.p_brand AND n.rn = w.rn + 1) a)
        SELECT p_brand, name, canonical FROM w WHERE rn > 0""",
    "word_tokens": f"SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({_WORDS}) AS word FROM {{documents}}) w WHERE length(word) >= 3 GROUP BY word",
    "text_shift_anchors": """WITH w AS (SELECT *, start_ms + 37000 + w_pos % 3 * 400 AS other FROM {words} w),
        g AS (SELECT session_id, lower(word) || ' ' || lower(lead(word, 1) OVER o) || ' ' || lower(lead(word, 2) OVER o) AS gram, start_ms, other FROM w WINDOW o AS (PARTITION BY session_id ORDER BY pos, w_pos)),
        u AS (SELECT session_id, gram, min(other) - min(start_ms) AS d FROM g WHERE gram IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1),
        n AS (SELECT a.session_id, a.gram, a.d, count(*) AS inside FROM u a JOIN u b ON a.session_id = b.session_id AND b.d BETWEEN a.d AND a.d + 5000 GROUP BY 1, 2, 3),
        m AS (SELECT session_id, count(*) AS anchors, max(inside) AS densest FROM n GROUP BY 1), f AS (SELECT n.session_id, max(anchors) AS anchors, max(densest) AS densest, min(d) AS low FROM n JOIN m ON n.session_id = m.session_id AND inside = densest GROUP BY 1)
        SELECT u.session_id, CAST(max(anchors) AS BIGINT) AS anchors, CAST(max(densest) AS BIGINT) AS densest, CAST(median(d) AS DOUBLE) AS shift FROM u JOIN f ON u.session_id = f.session_id AND d BETWEEN low AND low + 5000 GROUP BY 1""",
    "word_distance": _DISTANCE,
    "term_hits": f"""WITH t AS (SELECT DISTINCT {_WORDS} AS words FROM {{benchmark}}), g AS (SELECT doc_id, w, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM {{documents}}) a) b)
        SELECT array_to_string(words, ' ') AS term, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM g JOIN t ON w[i] = words[1] AND w[i:i + len(words) - 1] = words WHERE len(words) > 0 GROUP BY 1""",
    "export_srt": f"SELECT session_id, string_agg(printf('%d', n) || chr(10) || {_SRT('start_ms')} || ' --> ' || {_SRT('end_ms')} || chr(10) || speaker || ': ' || text || chr(10) || chr(10), '' ORDER BY n) AS document FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS n FROM {{segments}} s) x GROUP BY session_id",
    "export_markdown": _DOCUMENT.replace("@HEAD", f"'# Session ' || session_id || chr(10) || chr(10) || '**Duration:** ' || {_LENGTH} || chr(10) || chr(10)").replace("@LINE", f"'**[' || {_ROUND} || '] ' || speaker || ':** ' || text || chr(10) || chr(10)"),
    "export_text": _DOCUMENT.replace("@HEAD", f"'Session ' || session_id || chr(10) || 'Duration: ' || {_LENGTH} || chr(10) || chr(10)").replace("@LINE", f"'[' || {_ROUND} || '] ' || speaker || ': ' || text || chr(10)"),
    "session_list_prefix": "SELECT *, row_number() OVER (ORDER BY length_ms DESC, session_id) AS place FROM (SELECT session_id, max(end_ms) AS length_ms, CAST(count(*) AS BIGINT) AS lines FROM {segments} s GROUP BY 1 HAVING bool_or(source = 'monitor') AND max(end_ms) >= 30000) x WHERE prefix(CAST(session_id AS VARCHAR), '1')",
    "clock_texts": f"SELECT session_id, pos, {_SRT('start_ms')} AS srt, {_HMS.replace('{s}', '(start_ms // 1000)')} AS floored, CASE WHEN start_ms >= 3600000 THEN printf('%d:%02d:%02d', start_ms // 3600000, start_ms // 1000 % 3600 // 60, start_ms // 1000 % 60) ELSE printf('%d:%02d', start_ms // 60000, start_ms // 1000 % 60) END AS clock, start_ms // 1000 AS parsed FROM {{segments}} s",
    "signal_chain": """SELECT user_id, round(20 * log10(sqrt(list_sum(list_transform(y, lambda v: v * v)) / len(y))), 4) AS level, CAST(len(list_filter(y, lambda v: abs(v) >= pow(10.0, -0.3))) AS BIGINT) AS kept, len(list_filter(y, lambda v: abs(v) > 0.0001)) > 0 AS signal
        FROM (SELECT user_id, list_transform(x, lambda v: v / m) AS y FROM (SELECT user_id, x, list_max(list_transform(x, lambda v: abs(v))) AS m FROM (SELECT user_id, list_transform(v, lambda a: a - list_sum(v) / len(v)) AS x FROM (SELECT user_id, list(value ORDER BY t, event_id) AS v FROM {event_ms} e GROUP BY 1) a) b) c) d""",
}
ORACLES = {k: duckdb(v) for k, v in _SQL.items()}
