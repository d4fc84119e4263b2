"""DuckDB SQL for those operators that SQL can express; the texts follow the contracts, not the Spark plans."""

from __future__ import annotations

from parlance.llm import host_rules, linkrank, mixing

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _hash(*parts: str) -> str:
    return "('0x' || substring(md5(" + " || ':' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts) + "), 1, 15))::BIGINT"


def _quotas(parties: str, within: str, votes: str, seats: str, order: str, columns: str, most: str = "") -> str:
    """Highest quotients votes / (k + 1/2): all k below a bound are ranked, which is the definition itself; those from `most` on do not exist."""
    group = f"PARTITION BY {within}" if within else ""
    bound = f"CAST(floor(p.{votes} / p.total * (p.{seats} + 2 * p.parties) + 3.5) AS BIGINT)"
    bound = f"least({bound}, {most})" if most else bound
    return f"""(SELECT {columns}, CAST(count(CASE WHEN rank <= {seats} THEN 1 END) AS BIGINT) AS quota FROM
        (SELECT *, row_number() OVER ({group} ORDER BY CASE WHEN k IS NULL THEN -1.0 ELSE {votes} / (k + 0.5) END DESC, {order}, k) AS rank FROM
          (SELECT p.*, CAST(u.k AS BIGINT) AS k FROM (SELECT *, SUM({votes}) OVER ({group}) AS total, count(*) OVER ({group}) AS parties FROM {parties}) p
            LEFT JOIN LATERAL (SELECT unnest(range(0, CASE WHEN p.total > 0 AND p.{votes} > 0 THEN {bound} ELSE 0 END)) AS k) u ON true) a) b
        GROUP BY {columns})"""


def mix(seed: str = "mix-1") -> str:
    at, offset = _hash(f"'{seed}'", "doc_id", "md5(text)"), _hash(f"'{seed}'", "'offset'", "source_rank", "shard")
    return f"""
    WITH sized AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, {at} AS spot FROM documents),
    src AS (SELECT *, CAST([5, 2, 1][(source_rank - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0 AS cap FROM
      (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, count(*) AS source_docs, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM sized GROUP BY source) s),
    levels AS (SELECT *, (SUM(source_size) OVER () * 1.5 - coalesce(SUM(cap) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / SUM(weight) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM src),
    level AS (SELECT arg_min(level, struct_pack(a := cap / weight, b := source_rank)) AS level FROM levels WHERE level <= cap / weight),
    targets AS (SELECT l.*, coalesce(least(cap, weight * (SELECT level FROM level)), cap) AS target FROM levels l),
    blocks AS (SELECT *, CAST(coalesce(greatest(1, least({mixing.MAX_BLOCK}, floor(min(CASE WHEN target > 0 THEN target END) OVER () / {mixing.MIN_BLOCKS}))), 1) AS BIGINT) AS block,
      CAST(greatest(1, least({mixing.MAX_SHARDS}, ceil(source_docs / {mixing.SHARD_DOCS}))) AS BIGINT) AS shards FROM targets),
    parties AS (SELECT *, CAST(round(SUM(target) OVER () / block) AS BIGINT) AS seats FROM blocks),
    sq AS (SELECT source, source_rank, source_size, target, block, shards, quota AS source_quota FROM {_quotas("parties", "", "target", "seats", "source_rank", "source, source_rank, source_size, target, block, shards")} q),
    docs AS (SELECT d.*, s.source_rank, s.source_size, s.target, d.spot % s.shards AS shard FROM sized d JOIN sq s ON d.source IS NOT DISTINCT FROM s.source),
    per AS (SELECT d.source_rank, d.shard, CAST(SUM(size) AS BIGINT) AS shard_size, any_value(source_quota) AS seats, any_value(block) AS block, CAST(ceil(SUM(size) / any_value(block)) AS BIGINT) AS n FROM docs d JOIN sq s ON d.source_rank = s.source_rank GROUP BY 1, 2),
    cut AS (SELECT * FROM {_quotas("per", "source_rank", "shard_size", "seats", "shard", "source_rank, shard, shard_size, seats, block, n", "2 * p.n")} q),
    chosen AS (SELECT *, CASE WHEN n > 0 THEN quota // n ELSE 0 END AS repeats, CASE WHEN n > 0 THEN quota % n ELSE 0 END AS more, CASE WHEN n > 0 THEN {offset} % n ELSE 0 END AS first FROM cut),
    spans AS (SELECT *, first * block AS a1, least(least(first + more, n) * block, shard_size) AS b1, greatest(first + more - n, 0) * block AS b2 FROM chosen),
    laid AS (SELECT *, SUM(size) OVER (PARTITION BY source_rank, shard ORDER BY spot, doc_id, size ROWS UNBOUNDED PRECEDING) AS stop FROM docs)
    SELECT doc_id, size, source_size, target, CAST(repeats * size + greatest(least(stop, b1) - greatest(stop - size, a1), 0) + greatest(least(stop, b2) - greatest(stop - size, 0), 0) AS BIGINT) AS taken, source
    FROM laid l JOIN spans s ON l.source_rank = s.source_rank AND l.shard = s.shard"""


def judge() -> str:
    host = r"translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = r"regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
    links = """regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\\s>]+)', 1)"""
    ordered = sorted(linkrank.RULES, key=lambda x: len(x[1]), reverse=True)
    fits = lambda r: f"(host = '{r.split('/', 1)[0]}' OR suffix(host, '.{r.split('/', 1)[0]}')) AND prefix(path, '/{r.split('/', 1)[1]}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in ordered) + " END"
    walks = """t AS (SELECT 0 AS k, host, allow AS seed, allow AS score FROM hosts
      UNION ALL SELECT t.k + 1, t.host, any_value(t.seed), any_value(t.seed) + 0.85 * coalesce(SUM(e.p * s.score), 0) FROM t LEFT JOIN shares e ON e.dst = t.host LEFT JOIN t s ON s.host = e.src
        WHERE t.k < 200 AND EXISTS (SELECT 1 FROM shares) GROUP BY t.k, t.host),
    b AS (SELECT 0 AS k, host, block AS seed, block AS score FROM hosts
      UNION ALL SELECT b.k + 1, b.host, any_value(b.seed), any_value(b.seed) + (1 - any_value(b.seed)) * 0.85 * coalesce(SUM(e.p * s.score), 0) FROM b LEFT JOIN shares e ON e.src = b.host LEFT JOIN b s ON s.host = e.dst
        WHERE b.k < 200 AND EXISTS (SELECT 1 FROM shares) GROUP BY b.k, b.host)"""
    return f"""
    WITH RECURSIVE u AS (SELECT page_id, {host} AS host, {path} AS path FROM pages), r AS (SELECT *, {rule} AS rule FROM u), v AS (SELECT *, {verdict} AS own FROM r),
    links AS (SELECT {host} AS src, translate(unnest({links}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM pages),
    edges AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM links WHERE src <> dst AND src <> '' GROUP BY 1, 2),
    shares AS (SELECT src, dst, weight / SUM(weight) OVER (PARTITION BY src) AS p FROM edges),
    seeds AS (SELECT host, avg(CASE WHEN own = 'allow' THEN 1.0 ELSE 0.0 END) AS allow, avg(CASE WHEN own = 'block' THEN 1.0 ELSE 0.0 END) AS block FROM v GROUP BY 1
      UNION ALL SELECT src, 0.0, 0.0 FROM edges UNION ALL SELECT dst, 0.0, 0.0 FROM edges),
    hosts AS (SELECT host, max(allow) AS allow, max(block) AS block FROM seeds GROUP BY 1), {walks},
    trust AS (SELECT host, arg_max(score, k) AS score FROM t GROUP BY 1), blame AS (SELECT host, arg_max(score, k) AS score FROM b GROUP BY 1)
    SELECT page_id, v.host, path, rule, coalesce(own, CASE WHEN b.score >= 0.425 AND b.score > t.score THEN 'block' ELSE 'allow' END) AS verdict
    FROM v JOIN trust t ON t.host = v.host JOIN blame b ON b.host = v.host"""


REPEATS = f"""
    WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
    x AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN array_to_string(w[i:i + 49], ' ') END AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) a),
    f AS (SELECT *, CASE WHEN run IS NOT NULL AND min(doc_id) OVER (PARTITION BY run) < doc_id THEN 1 ELSE 0 END AS again FROM x),
    c AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
    k AS (SELECT doc_id, CAST(SUM(gone) AS BIGINT) AS n_removed, coalesce(string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i), '') AS kept FROM c GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""

RULES = f"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d) a) b),
    r AS (SELECT doc_id, CAST(count(DISTINCT p) AS BIGINT) AS n_repeat_words FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM g WHERE n > 1) a GROUP BY 1),
    l AS (SELECT doc_id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) a WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
    m AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'gs')) AS BIGINT) AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id),
    b AS (SELECT *, n_words < {host_rules.MIN_WORDS} OR 100 * n_repeat_words > {host_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
    h AS (SELECT source, count(*) AS n, count(CASE WHEN base_failed THEN 1 END) AS f FROM b GROUP BY 1),
    p AS (SELECT *, SUM(f) OVER () / SUM(n) OVER () AS mean FROM h), q AS (SELECT *, avg((f / n - mean) * (f / n - mean)) OVER () AS v FROM p),
    s AS (SELECT *, CASE WHEN v > 0 THEN least({host_rules.MOST_PRIOR}, greatest({host_rules.LEAST_PRIOR}, mean * (1 - mean) / v - 1)) ELSE {host_rules.MOST_PRIOR} END AS k FROM q),
    y AS (SELECT source, n + k AS n, (f + mean * k) / (n + k) AS rate, mean / (1 - mean) AS odds FROM s),
    z AS (SELECT source, mean = 1 OR lower / (1 - lower) <= 4 * odds AS passes FROM (SELECT *, rate - 2 * sqrt(rate * (1 - rate) / (n + 1)) AS lower, odds / (1 + odds) AS mean FROM y) a)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND passes AS kept FROM b JOIN z ON b.source IS NOT DISTINCT FROM z.source"""

ORACLES = {"op1_source_mix": mix(), "op2_url_filter": judge(), "op5_substring_dedup": REPEATS, "op10_host_rules": RULES}
