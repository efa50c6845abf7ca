"""DuckDB SQL of the registered queries, written apart from the engine's plans."""

from __future__ import annotations

MAX, HALF, SINCE, TEST, TRAIN = 6, 365, 883612800, 200, 3000

_PART = (
    "lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '-') || '-' || p_partkey || "
    "['.ts', '.py', '.md', '.lock', '.json', ''][p_size % 6 + 1]"
)


def history(kind: str) -> str:
    """b: baskets; i: items; n: sizes; e: in-size baskets; w: their items with decay."""
    path = "'supp/' || l_suppkey" if kind == "dense" else _PART
    part = "" if kind == "dense" else " JOIN part ON l_partkey = p_partkey"
    return f"""
b AS (SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS ord, o_orderkey AS k, 'o' || o_orderkey AS hash,
  CAST(epoch(o_orderdate) AS BIGINT) AS t, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS date FROM orders),
i AS (SELECT DISTINCT ord, {path} AS path FROM lineitem JOIN b ON l_orderkey = k{part}),
n AS (SELECT ord, count(*) AS n FROM i GROUP BY ord),
e AS (SELECT b.*, n FROM b JOIN n USING (ord) WHERE n <= {MAX}),
w AS (SELECT ord, path, t, date, hash, n, exp(-ln(2) * greatest((SELECT max(t) FROM b) - t, 0) / 86400.0 / {HALF}) AS decay FROM i JOIN e USING (ord))"""


ITEMS = "items AS (SELECT path, count(*) AS changes, sum(decay) AS mass, max(date) AS last_seen FROM w GROUP BY path)"
PAIRS = """pairs AS (SELECT x.path AS a, y.path AS b, count(*) AS co, sum(x.decay / log2(x.n + 1)) AS weight, max(x.date) AS last_seen
  FROM w x JOIN w y USING (ord) WHERE x.path < y.path GROUP BY ALL)"""
SCORED = "scored AS (SELECT p.*, p.weight / sqrt(x.mass * y.mass) AS score FROM pairs p JOIN items x ON x.path = p.a JOIN items y ON y.path = p.b)"
BOTH = """both_ways AS (SELECT a AS seed, b AS path, co, weight, last_seen, score FROM scored UNION ALL SELECT b, a, co, weight, last_seen, score FROM scored)"""
NEWEST = "newest AS (SELECT path AS seed FROM i WHERE ord = (SELECT min(ord) FROM n WHERE n >= 3))"


def demand(where: str = "", limit: int = 0, seeds: str = "") -> str:
    """s: baskets of each seed; d: (seed, path) with score, on demand."""
    cut = f" QUALIFY row_number() OVER (PARTITION BY i.path ORDER BY ord) <= {limit}" if limit else ""
    return f"""
s0 AS (SELECT i.path AS seed, e.* FROM i JOIN e USING (ord) WHERE true{where}{seeds}{cut}),
s AS (SELECT *, exp(-ln(2) * greatest(max(t) OVER (PARTITION BY seed) - t, 0) / 86400.0 / {HALF}) AS decay FROM s0),
m AS (SELECT seed, sum(decay) AS mass FROM s GROUP BY seed),
d AS (SELECT seed, i.path AS path, count(*) AS co, sum(decay / log2(n + 1)) AS weight, max(date) AS last_seen,
  sum(decay / log2(n + 1)) / sqrt(any_value(mass) * sum(decay)) AS score FROM s JOIN i USING (ord) JOIN m USING (seed) WHERE i.path <> seed GROUP BY seed, i.path)"""


def rank(source: str, top: int | None, key: str = "seed") -> str:
    keep = f" WHERE rank <= {top}" if top else ""
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(score, 9) DESC, path) AS rank FROM {source}){keep})"


def ranked(prefix: str, source: str, top: int | None, more: str = "") -> str:
    return f"WITH {prefix} SELECT seed, path, rank, round(score, 6) AS score{more} FROM {rank(source, top)}"


BAND = "CASE WHEN {0} >= 25 THEN 'high' WHEN {0} >= 2 THEN 'medium' ELSE 'low' END"
ORDER = "CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, support_count DESC, round(score, 9) DESC, cochanges DESC, path"
_ELIGIBLE = "path NOT IN (SELECT seed FROM newest) AND CAST(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT) % 17 <> 0"


def candidates(kind: str) -> str:
    return f"""{history(kind)}, {NEWEST}, {demand(seeds=' AND i.path IN (SELECT seed FROM newest)')},
r AS (SELECT * FROM {rank('d', 64)} WHERE {_ELIGIBLE}),
c AS (SELECT path, {BAND.format('max(co)')} AS confidence, count(DISTINCT seed) AS support_count, string_agg(DISTINCT seed, ',' ORDER BY seed) AS supported_by,
  CAST(sum(co) AS BIGINT) AS cochanges, max(co) AS strongest, sum(score) AS score, sum(weight) AS weight, max(last_seen) AS last_seen, 'direct_cochange' AS reason FROM r GROUP BY path)"""


_SHOWN = "confidence, support_count, supported_by, cochanges, strongest, round(score, 6) AS score, round(weight, 6) AS weight, last_seen, reason"


def audit(kind: str, bands: str) -> str:
    return f"""WITH {candidates(kind)} SELECT rank || ' ' || path AS path, {_SHOWN} FROM
(SELECT *, row_number() OVER (ORDER BY {ORDER}) AS rank FROM c WHERE confidence IN ({bands})) WHERE rank <= 20"""


def tokens(source: str, column: str, keep: str) -> str:
    """(keep, path, token, weight) of a relation's names."""
    low = f"lower({column})"
    folder = f"regexp_replace({low}, '/[^/]*$', '')"
    ext = f"regexp_extract({low}, '\\.([^./]+)$', 1)"
    return f"""(SELECT {keep}, {column} AS path, token, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT {keep}, {column}, unnest(regexp_extract_all({low}, '[a-z0-9]+')) AS token FROM {source}) WHERE length(token) >= 2 GROUP BY ALL
UNION ALL SELECT {keep}, {column}, 'dir:' || {folder}, 3.0 FROM {source} WHERE contains({column}, '/')
UNION ALL SELECT {keep}, {column}, 'ext:' || {ext}, 0.5 FROM {source} WHERE {ext} <> '')"""


def similar(seeds: str, names: str, seeds_column: str = "seed") -> str:
    """sim: (seed, path, score)."""
    folder = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '.' END"
    return f"""
names0 AS (SELECT DISTINCT path FROM {names}), seeds0 AS (SELECT DISTINCT {seeds_column} AS path FROM {seeds}),
ta AS (SELECT path AS seed, token, sum(weight) AS weight FROM {tokens('seeds0', 'path', '1 AS one')} GROUP BY ALL),
tb AS (SELECT path, token, sum(weight) AS weight FROM {tokens('names0', 'path', '1 AS one')} GROUP BY ALL),
na AS (SELECT seed, sum(weight * weight) AS v FROM ta GROUP BY seed), nb AS (SELECT path, sum(weight * weight) AS v FROM tb GROUP BY path),
dots AS (SELECT seed, path, sum(ta.weight * tb.weight) AS dot FROM ta JOIN tb USING (token) GROUP BY seed, path),
sim AS (SELECT * FROM (SELECT seed, path, coalesce(dot, 0) / sqrt(na.v * nb.v) + CASE WHEN {folder.format('seed')} = {folder.format('path')} THEN 0.25 ELSE 0 END AS score
  FROM na CROSS JOIN nb LEFT JOIN dots USING (seed, path) WHERE seed <> path) WHERE score > 0)"""


ADJ = "adj AS (SELECT a AS u, b AS v, weight FROM pairs UNION ALL SELECT b, a, weight FROM pairs)"
DEGREE = "degree AS (SELECT u, sum(weight) AS degree FROM adj GROUP BY u)"


def walks(seeds: str, steps: int, by_seed: bool = False) -> str:
    """pr: (seed, path, score) after `steps` steps with restart; needs adj and degree."""
    key = "adj.seed = r.seed AND adj.u = r.u" if by_seed else "adj.u = r.u"
    own = "USING (seed, u)" if by_seed else "USING (u)"
    columns = "seed, u, v" if by_seed else "u, v"
    return f"""
moves AS (SELECT {columns}, 0.85 * weight / degree AS p FROM adj JOIN degree {own}),
steps AS (SELECT 0 AS step, seed, seed AS u, 1.0::DOUBLE AS r FROM {seeds}
  UNION ALL
  SELECT step + 1, seed, u, sum(r) FROM (
    SELECT r.step, r.seed, unnest([coalesce(adj.v, r.seed), CASE WHEN adj.v IS NULL OR adj.v = first_v THEN r.seed END]) AS u,
      unnest([r.r * coalesce(adj.p, 0.85), CASE WHEN adj.v IS NULL OR adj.v = first_v THEN 0.15 * r.r END]) AS r
    FROM steps r LEFT JOIN (SELECT *, min(v) OVER (PARTITION BY {columns.replace(', v', '')}) AS first_v FROM moves) adj ON {key})
  WHERE u IS NOT NULL AND step < {steps} GROUP BY step, seed, u),
pr AS (SELECT seed, u AS path, r AS score FROM steps WHERE step = {steps} AND u <> seed AND r > 0)"""


_URL = "(SELECT url AS seed, url AS path FROM pages)"
_MATCH = "(regexp_matches({0}, '.*\\.lock$') OR regexp_matches({0}, '^economy/.*') OR regexp_matches(regexp_extract({0}, '[^/]*$'), '^red-.*$') OR regexp_matches({0}, '^red-.*'))"
_PATHS = f"paths AS (SELECT {_PART} AS path FROM part)"
_SEEDS = "seeds AS (SELECT unnest(['supp/1', 'supp/7']) AS seed)"


def explained(a: str, b: str) -> str:
    return f"""WITH {history('dense')}, {demand(seeds=f" AND i.path = '{a}'")},
u AS (SELECT s.ord, s.t, s.date, s.n, decay FROM s JOIN i USING (ord) WHERE i.path = '{b}')
SELECT '{a}' AS a, '{b}' AS b, count(*) > 0 AS related, count(*) AS cochanges, round(coalesce(sum(decay / log2(n + 1)), 0), 6) AS weight, coalesce(max(date), '') AS last_seen FROM u"""


_RENAMED = "lower(p_type) || '/' || lower(p_brand) || '/' || replace(p_name, ' ', '-')"


def resolved(names: str, asked: str) -> str:
    return f"""WITH names AS (SELECT DISTINCT {names} AS path FROM part), asked AS (SELECT DISTINCT asked FROM ({asked})),
met AS (SELECT asked, path FROM asked LEFT JOIN names ON path = asked OR ends_with(path, '/' || asked)),
f AS (SELECT asked, count(path) AS n, bool_or(coalesce(path = asked, false)) AS exact, coalesce(string_agg(path, ',' ORDER BY path), '') AS all_names, min(path) AS one FROM met GROUP BY asked)
SELECT asked, CASE WHEN exact OR n = 1 THEN 'known' WHEN n = 0 THEN 'missing' ELSE 'ambiguous' END AS status,
  CASE WHEN exact THEN asked WHEN n = 1 THEN one END AS path, CASE WHEN exact THEN '' ELSE all_names END AS matches FROM f"""


_SOURCES = """
staged AS (SELECT 's/' || p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN 'old/' ELSE 's/' END || p_partkey AS old FROM part WHERE p_partkey % 3 = 0),
unstaged AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'u/' ELSE 's/' END || p_partkey AS path, 's/' || p_partkey AS old FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 < 2),
untracked AS (SELECT 'u/' || p_partkey AS path FROM part WHERE p_partkey % 7 = 0),
every AS (SELECT u.path, coalesce(s.old, u.old) AS history_path, 0 AS source FROM unstaged u LEFT JOIN staged s ON s.path = u.old
  UNION ALL SELECT path, old, 1 FROM staged WHERE path NOT IN (SELECT old FROM unstaged)
  UNION ALL SELECT path, path, 2 FROM untracked),
changed AS (SELECT path, history_path FROM every QUALIFY row_number() OVER (PARTITION BY path ORDER BY source, history_path) = 1)"""


def split(kind: str) -> str:
    """tests, train0 (in-size), known."""
    return f"""{history(kind)},
tn AS (SELECT i.ord, i.path, n FROM i JOIN n USING (ord) WHERE ord < {TEST} AND n BETWEEN 2 AND {MAX}),
tr AS (SELECT * FROM e WHERE ord BETWEEN {TEST} AND {TEST + TRAIN - 1}),
known AS (SELECT DISTINCT path FROM i JOIN tr USING (ord)),
tests AS (SELECT ord, path, n, path IN (SELECT path FROM known) AS is_known, count(*) FILTER (path IN (SELECT path FROM known)) OVER (PARTITION BY ord) AS n_known FROM tn)"""


_TRAIN_SEEDS = f"""
s AS (SELECT i.path AS seed, tr.*, exp(-ln(2) * greatest(max(t) OVER (PARTITION BY i.path) - t, 0) / 86400.0 / {HALF}) AS decay FROM i JOIN tr USING (ord)),
m AS (SELECT seed, sum(decay) AS mass FROM s GROUP BY seed),
d AS (SELECT seed, i.path AS path, count(*) AS co, sum(decay / log2(n + 1)) AS weight, max(date) AS last_seen, sum(decay) AS hot,
  sum(decay / log2(n + 1)) / sqrt(any_value(mass) * sum(decay)) AS score FROM s JOIN i USING (ord) JOIN m USING (seed) WHERE i.path <> seed GROUP BY seed, i.path)"""
_TRAIN_GLOBAL = f"""
w1 AS (SELECT i.path, tr.*, exp(-ln(2) * greatest((SELECT max(t) FROM b WHERE ord BETWEEN {TEST} AND {TEST + TRAIN - 1}) - t, 0) / 86400.0 / {HALF}) AS decay FROM i JOIN tr USING (ord)),
items AS (SELECT path, sum(decay) AS mass FROM w1 GROUP BY path),
pairs AS (SELECT x.path AS seed, y.path AS path, sum(x.decay / log2(x.n + 1)) AS weight FROM w1 x JOIN w1 y USING (ord) WHERE x.path <> y.path GROUP BY ALL),
d AS (SELECT p.seed, p.path, weight / sqrt(x.mass * y.mass) AS score FROM pairs p JOIN items x ON x.path = p.seed JOIN items y ON y.path = p.path)"""


def query_metrics(kind: str, graph: str, sources: dict[str, str]) -> str:
    modes = " UNION ALL ".join(f"SELECT '{m}' AS mode, seed, path, rank FROM {rank(s, 5)}" for m, s in sources.items())
    return f"""WITH {'RECURSIVE ' if 'pagerank' in sources else ''}{split(kind)}, {graph},
results AS ({modes}), modes AS (SELECT unnest({list(sources)}) AS mode),
tasks AS (SELECT mode, ord, path AS seed, n_known - 1 AS n_targets FROM tests, modes WHERE is_known AND n_known >= 2),
hit AS (SELECT t.mode, t.ord, t.seed, any_value(n_targets) AS n_targets, count(r.path) AS results, count(x.path) AS hits, min(CASE WHEN x.path IS NOT NULL THEN rank END) AS first
  FROM tasks t LEFT JOIN results r ON r.seed = t.seed AND r.mode = t.mode LEFT JOIN tests x ON x.ord = t.ord AND x.path = r.path AND x.is_known GROUP BY t.mode, t.ord, t.seed)
SELECT mode, count(*) AS tasks, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_at_k, round(avg(hits / 5.0), 6) AS precision_at_k,
  round(avg(hits / n_targets), 6) AS recall_at_k, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(results), 6) AS avg_results FROM hit GROUP BY mode"""


def audit_eval(graph: str, source: str) -> str:
    """tasks, shown: leave-one-out audits over the ranking `source` (seed, path, co, score)."""
    return f"""{split('dense')}, {graph},
r AS (SELECT * FROM {rank(source, 64)}),
ki AS (SELECT ord, path FROM tests WHERE is_known AND n_known >= 2),
tasks AS (SELECT ord, path AS omitted FROM ki),
f AS (SELECT t.ord, t.omitted, r.* FROM tasks t JOIN ki ON ki.ord = t.ord AND ki.path <> t.omitted JOIN r ON r.seed = ki.path
  WHERE r.path = t.omitted OR r.path NOT IN (SELECT path FROM ki k2 WHERE k2.ord = t.ord)),
c AS (SELECT ord, omitted, path, {BAND.format('max(co)')} AS confidence, count(DISTINCT seed) AS support_count, sum(co) AS cochanges, sum(score) AS score FROM f GROUP BY ord, omitted, path),
shown AS (SELECT *, row_number() OVER (PARTITION BY ord, omitted ORDER BY {ORDER}) AS rank FROM c QUALIFY rank <= 5)"""


def audit_metrics(tasks: str, mode: str) -> str:
    return f"""WITH {tasks},
kept AS (SELECT *, row_number() OVER (PARTITION BY ord, omitted ORDER BY rank) AS place FROM shown WHERE confidence <> 'low'),
t AS (SELECT tasks.ord, tasks.omitted, count(path) AS results, min(CASE WHEN path = tasks.omitted THEN place END) AS first FROM tasks LEFT JOIN kept ON kept.ord = tasks.ord AND kept.omitted = tasks.omitted GROUP BY ALL)
SELECT '{mode}' AS mode, count(*) AS tasks, count(first) AS hits_at_k, round(count(first) / count(*), 6) AS hit_rate_at_k, round(count(first) / 5.0 / count(*), 6) AS precision_at_k,
  round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(results), 6) AS avg_results, round(avg(results - CASE WHEN first IS NULL THEN 0 ELSE 1 END), 6) AS avg_false_positives,
  round(count(*) FILTER (results = 0) / count(*), 6) AS abstention_rate FROM t"""


_AUDIT_EVAL = audit_eval(_TRAIN_SEEDS, "d")
_CHAIN = """
rec AS (SELECT 10 - c_custkey % 8 AS ord, 0 AS pos, 'n/' || c_custkey AS old_path, 'n/' || CASE WHEN c_custkey % 50 = 49 THEN c_custkey - 3 ELSE c_custkey + 1 END AS new_path
  FROM customer WHERE c_custkey % 8 <> 7 OR c_custkey % 50 = 49
  UNION ALL SELECT 20 + c_custkey % 8, 1, 'n/' || c_custkey, 'n/' || (c_custkey + 3) FROM customer WHERE c_custkey % 16 = 2),
al AS (SELECT old_path, new_path FROM rec QUALIFY row_number() OVER (PARTITION BY old_path ORDER BY ord DESC, pos DESC) = 1),
walk AS (SELECT old_path, old_path AS place, CAST([] AS VARCHAR[]) AS seen FROM al UNION ALL SELECT walk.old_path, new_path, list_append(seen, place) FROM walk JOIN al ON al.old_path = place WHERE NOT list_contains(seen, place))"""

_D, _S = history("dense"), history("sparse")
_MERGED = """
every_one AS (SELECT seed, i.path AS path, hash, date, n FROM s JOIN i USING (ord) WHERE i.path <> seed QUALIFY row_number() OVER (PARTITION BY seed, i.path ORDER BY ord) <= 3),
merged AS (SELECT path, string_agg(hash || ' ' || date || ' ' || n, ',' ORDER BY date DESC, hash) AS evidence FROM (
  SELECT DISTINCT path, hash, date, n FROM every_one QUALIFY dense_rank() OVER (PARTITION BY path ORDER BY date DESC, hash) <= 3) GROUP BY path)"""

ORACLES = {
    "basket_size_filter": f"WITH {_D} SELECT ord, hash, n AS n_files FROM e",
    "item_stats": f"WITH {_D}, {ITEMS} SELECT path, changes, round(mass, 6) AS weighted_changes, last_seen FROM items",
    "pair_stats": f"WITH {_D}, {PAIRS} SELECT a, b, co AS cochanges, round(weight, 6) AS weight, last_seen FROM pairs",
    "pair_stats_sparse": f"WITH {_S}, {PAIRS} SELECT a, b, co AS cochanges, round(weight, 6) AS weight, last_seen FROM pairs",
    "pair_evidence_first3": f"""WITH {_D} SELECT x.path AS a, y.path AS b, row_number() OVER (PARTITION BY x.path, y.path ORDER BY ord) AS nth, x.hash AS hash, x.date AS date, x.n AS file_count,
  round(x.decay / log2(x.n + 1), 6) AS weight FROM w x JOIN w y USING (ord) WHERE x.path < y.path QUALIFY nth <= 3""",
    "direct_global_all": f"WITH {_D}, {ITEMS}, {PAIRS}, {SCORED} SELECT a, b, co AS cochanges, round(weight, 6) AS weight, round(score, 6) AS score, last_seen FROM scored",
    "direct_global_topk": ranked(f"{_D}, {ITEMS}, {PAIRS}, {SCORED}, {BOTH}", "both_ways", 5, ", co AS cochanges, last_seen"),
    "direct_on_demand_topk": ranked(f"{_D}, {demand()}", "d", 5, ", co AS cochanges, last_seen"),
    "direct_on_demand_sparse": ranked(f"{_S}, {demand()}", "d", 3, ", co AS cochanges"),
    "direct_on_demand_since": ranked(f"{_D}, {demand(f' AND t >= {SINCE}')}", "d", 5, ", co AS cochanges"),
    "direct_max_commits": ranked(f"{_D}, {demand(limit=50)}", "d", 5, ", co AS cochanges"),
    "on_demand_evidence": f"""WITH {_D}, {demand()} SELECT seed, i.path AS path, row_number() OVER (PARTITION BY seed, i.path ORDER BY ord) AS nth, hash, n AS file_count,
  round(decay / log2(n + 1), 6) AS weight FROM s JOIN i USING (ord) WHERE i.path <> seed QUALIFY nth <= 2""",
    "hot_topk": f"WITH {_D}, {ITEMS} SELECT path, round(mass, 6) AS score, last_seen FROM items ORDER BY round(mass, 9) DESC, path LIMIT 20",
    "hot_on_demand": ranked(f"{_D}, {demand()}, h AS (SELECT seed, i.path AS path, sum(decay) AS score, max(date) AS last_seen FROM s JOIN i USING (ord) WHERE i.path <> seed GROUP BY ALL)", "h", 5, ", last_seen"),
    "path_similarity_topk": ranked(f"{_S}, {NEWEST}, {_PATHS}, {similar('newest', 'paths')}", "sim", 20),
    "path_similarity_urls": ranked(similar(_URL, _URL).strip(), "sim", 3),
    "weighted_degree": f"WITH {_D}, {PAIRS}, {ADJ}, {DEGREE} SELECT u AS path, round(degree, 6) AS degree FROM degree",
    "adjacency": f"WITH {_D}, {PAIRS}, {ADJ} SELECT u, v, round(weight, 6) AS weight FROM adj",
    "pagerank_global": f"WITH RECURSIVE {_D}, {PAIRS}, {ADJ}, {DEGREE}, {_SEEDS}, {walks('seeds', 30)} SELECT seed, path, round(score, 6) AS score FROM pr",
    "exclude_glob": f"WITH {_PATHS} SELECT path FROM paths WHERE {_MATCH.format('path')}",
    "exclude_then_topk": ranked(f"{_S}, {NEWEST}, {demand(seeds=' AND i.path IN (SELECT seed FROM newest)')}, k AS (SELECT * FROM d WHERE NOT {_MATCH.format('path')})", "k", 5, ", co AS cochanges"),
    "broad_change_hint": f"""WITH g AS (SELECT p_brand AS seed, lower(p_type) || '/' || CASE p_partkey % 3 WHEN 0 THEN 'package.json' WHEN 1 THEN 'Cargo.lock' ELSE p_name END AS path, sum(p_retailprice) AS score FROM part GROUP BY ALL)
SELECT seed, count(*) AS shown, count(*) FILTER (ends_with(path, '/package.json') OR ends_with(path, '/Cargo.lock')) AS broad,
  count(*) FILTER (ends_with(path, '/package.json') OR ends_with(path, '/Cargo.lock')) >= 4 AND 2 * count(*) FILTER (ends_with(path, '/package.json') OR ends_with(path, '/Cargo.lock')) >= count(*) AS hint
FROM {rank('g', 8)} GROUP BY seed""",
    "explain_pair": explained("supp/7", "supp/1"),
    "explain_unrelated": explained("supp/7", "supp/none"),
    "resolve_path_suffix": resolved(_PART, f"SELECT regexp_replace({_PART}, '^[^/]*/', '') AS asked FROM part"),
    "resolve_path_ambiguous": resolved(_RENAMED, "SELECT replace(p_name, ' ', '-') AS asked FROM part UNION ALL SELECT 'no-such-name'"),
    "audit_candidates": f"WITH {candidates('dense')} SELECT path, {_SHOWN} FROM c",
    "audit_eligible": f"""WITH {_D}, {NEWEST}, {demand(seeds=' AND i.path IN (SELECT seed FROM newest)')}
SELECT seed, path, rank, round(score, 6) AS score, co AS cochanges FROM {rank('d', 64)} WHERE {_ELIGIBLE} AND NOT starts_with(path, 'supp/1')""",
    "audit_low": audit("sparse", "'low', 'medium', 'high'"),
    "audit_medium": audit("dense", "'medium', 'high'"),
    "audit_high": audit("dense", "'high'"),
    "audit_evidence": f"""WITH {_D}, {NEWEST}, {demand(seeds=' AND i.path IN (SELECT seed FROM newest)')},
v AS (SELECT seed, i.path AS path, hash, date, n FROM s JOIN i USING (ord) WHERE i.path <> seed QUALIFY row_number() OVER (PARTITION BY seed, i.path ORDER BY ord) <= 3),
o AS (SELECT DISTINCT path, hash, date, n FROM v WHERE path NOT IN (SELECT seed FROM newest))
SELECT path, row_number() OVER (PARTITION BY path ORDER BY date DESC, hash) AS nth, hash, date, n AS file_count FROM o QUALIFY nth <= 3""",
    "audit_filtered_count": f"WITH {candidates('sparse')} SELECT count(*) AS candidates, count(*) FILTER (confidence = 'low') AS filtered FROM c",
    "audit_enforcement": f"""WITH {candidates('dense')}, shown AS (SELECT * FROM c WHERE confidence <> 'low' ORDER BY {ORDER} LIMIT 50)
SELECT count(*) FILTER (confidence = 'high') AS findings, count(*) FILTER (confidence = 'high') > 0 AS triggered FROM shown""",
    "diff_aggregate": f"""WITH {_D}, {NEWEST}, {demand(seeds=' AND i.path IN (SELECT seed FROM newest)')},
c AS (SELECT path, count(DISTINCT seed) AS support_count, CAST(sum(co) AS BIGINT) AS cochanges, max(co) AS strongest, sum(score) AS score, sum(weight) AS weight, max(last_seen) AS last_seen
  FROM {rank('d', 20)} WHERE path NOT IN (SELECT seed FROM newest) GROUP BY path)
SELECT path, support_count, cochanges, strongest, round(score, 6) AS score, round(weight, 6) AS weight, last_seen, 'direct_cochange' AS reason FROM c ORDER BY round(c.score, 9) DESC, path LIMIT 20""",
    "worktree_changed_set": f"WITH {_SOURCES} SELECT path, history_path FROM changed",
    "changed_name_set": f"WITH {_SOURCES} SELECT path FROM changed UNION SELECT history_path FROM changed",
    "rename_follow_exact": f"""WITH {_D},
own AS (SELECT DISTINCT new_name AS seed, e.ord, old_name FROM e JOIN i USING (ord), (VALUES ('supp/1', 'supp/2'), ('supp/7', 'supp/8')) v(new_name, old_name)
  WHERE i.path = new_name OR (t < {SINCE} AND i.path = old_name)),
f AS (SELECT DISTINCT seed, own.ord, CASE WHEN t < {SINCE} AND i.path = old_name THEN seed ELSE i.path END AS path FROM own JOIN i USING (ord) JOIN b USING (ord))
SELECT seed, path, count(*) AS cochanges FROM f WHERE path <> seed GROUP BY ALL""",
    "multi_seed_follow": f"""WITH {_D},
own AS (SELECT DISTINCT new_name AS seed, e.ord, e.t, e.date, old_name FROM e JOIN i USING (ord), (VALUES ('supp/1', 'supp/2'), ('supp/7', 'supp/8')) v(new_name, old_name)
  WHERE i.path = new_name OR (t < {SINCE} AND i.path = old_name)),
f AS (SELECT DISTINCT seed, ord, t, CASE WHEN t < {SINCE} AND i.path = old_name THEN seed ELSE i.path END AS path FROM own JOIN i USING (ord)),
fn AS (SELECT seed, ord, any_value(t) AS t, count(*) AS n FROM f GROUP BY seed, ord),
fd AS (SELECT *, exp(-ln(2) * greatest(max(t) OVER (PARTITION BY seed) - t, 0) / 86400.0 / {HALF}) AS decay FROM fn),
fm AS (SELECT seed, sum(decay) AS mass FROM fd GROUP BY seed),
d2 AS (SELECT seed, path, count(*) AS co, sum(decay / log2(n + 1)) / sqrt(any_value(mass) * sum(decay)) AS score FROM fd JOIN f USING (seed, ord) JOIN fm USING (seed) WHERE path <> seed GROUP BY seed, path)
SELECT seed, path, rank, round(score, 6) AS score, co AS cochanges FROM {rank('d2', None)}""",
    "audit_candidates_with_evidence": f"""WITH {candidates('dense')}, {_MERGED},
top AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS rank FROM c WHERE confidence IN ('medium', 'high'))
SELECT path, rank, confidence, coalesce(evidence, '') AS evidence FROM top LEFT JOIN merged USING (path) WHERE rank <= 20""",
    "diff_evidence": f"""WITH {_D}, {NEWEST}, {demand(seeds=' AND i.path IN (SELECT seed FROM newest)')}, {_MERGED},
c AS (SELECT path, sum(score) AS score FROM {rank('d', 20)} WHERE path NOT IN (SELECT seed FROM newest) GROUP BY path)
SELECT path, round(score, 6) AS score, coalesce(evidence, '') AS evidence FROM c LEFT JOIN merged USING (path) ORDER BY round(c.score, 9) DESC, path LIMIT 20""",
    "explain_evidence": f"""WITH {_D}, {demand(seeds=" AND i.path = 'supp/7'")}
SELECT row_number() OVER (ORDER BY ord) AS nth, hash, date, (SELECT o_orderpriority FROM orders WHERE o_orderkey = k) AS subject, n AS file_count, round(decay / log2(n + 1), 6) AS weight
FROM s JOIN i USING (ord) WHERE i.path = 'supp/1' QUALIFY nth <= 3""",
    "staged_rename_mapping": f"""WITH {_D}, {demand(seeds=" AND i.path IN ('supp/1', 'supp/7')")}
SELECT CASE seed WHEN 'supp/7' THEN 'supp/new' ELSE seed END AS seed, path, rank, round(score, 6) AS score, co AS cochanges FROM {rank('d', 10)} WHERE path NOT IN ('supp/1', 'supp/7')""",
    "rename_exact_blob": """WITH bf AS (SELECT 'a/' || p_partkey AS path, CASE WHEN p_partkey % 10 < 8 THEN p_partkey ELSE p_partkey // 10 * 10 + 8 END AS blob FROM part),
af AS (SELECT CASE WHEN p_partkey % 5 = 3 THEN 'b/' ELSE 'a/' END || p_partkey AS path, CASE WHEN p_partkey % 10 < 8 THEN p_partkey ELSE p_partkey // 10 * 10 + 8 END AS blob FROM part WHERE p_partkey % 10 <> 9),
gone AS (SELECT blob, min(path) AS old_path FROM bf WHERE path NOT IN (SELECT path FROM af) GROUP BY blob HAVING count(*) = 1)
SELECT old_path, path AS new_path FROM af JOIN gone USING (blob) WHERE path NOT IN (SELECT path FROM bf)""",
    "rename_alias_closure": f"""WITH RECURSIVE {_CHAIN} SELECT old_path, place AS canonical FROM walk QUALIFY row_number() OVER (PARTITION BY old_path ORDER BY len(seen) DESC) = 1""",
    "eval_known_items": f"WITH {split('dense')} SELECT path FROM known",
    "eval_split": f"WITH {_D} SELECT ord, hash, CASE WHEN ord < {TEST} THEN 'test' ELSE 'train' END AS part FROM b WHERE ord < {TEST + TRAIN}",
    "eval_query_counters": f"WITH {split('sparse')} SELECT count(*) AS candidate_tasks, count(*) FILTER (is_known) AS evaluated_tasks, count(*) FILTER (NOT is_known) AS skipped_unknown_seed FROM tests WHERE n_known >= 2",
    "eval_audit_counters": f"""WITH {split('sparse')} SELECT count(*) AS candidate_tasks, count(*) FILTER (is_known AND n_known >= 2) AS evaluated_tasks,
  count(*) FILTER (NOT is_known) AS skipped_unknown_targets, count(*) FILTER (is_known AND n_known < 2) AS skipped_insufficient_known_files FROM tests""",
    "eval_query_on_demand": query_metrics("dense", f"{_TRAIN_SEEDS}, h AS (SELECT seed, path, hot AS score FROM d), {similar('known', 'known', 'path')}, p AS (SELECT sim.* FROM sim JOIN d USING (seed, path))".replace("sim.*", "sim.seed, sim.path, sim.score"), {"direct": "d", "hot": "h", "path": "p"}),
    "eval_query_global": query_metrics("dense", f"{_TRAIN_GLOBAL}, h AS (SELECT x.path AS seed, y.path AS path, y.mass AS score FROM items x, items y WHERE x.path <> y.path), {similar('known', 'known', 'path')}", {"direct": "d", "hot": "h", "path": "sim"}),
    "eval_audit_metrics": audit_metrics(_AUDIT_EVAL, "direct"),
    "eval_audit_band_metrics": f"""WITH {_AUDIT_EVAL},
g AS (SELECT confidence, ord, omitted, count(*) AS n, count(*) FILTER (path = omitted) AS hit FROM shown GROUP BY ALL),
x AS (SELECT confidence, CAST(sum(n) AS BIGINT) AS candidates, CAST(sum(hit) AS BIGINT) AS correct, count(*) AS tasks, count(*) FILTER (hit > 0) AS hits FROM g GROUP BY confidence)
SELECT 'direct' AS mode, v.confidence, coalesce(candidates, 0) AS candidates, coalesce(correct, 0) AS correct_candidates, round(coalesce(correct / nullif(candidates, 0), 0), 6) AS candidate_precision,
  coalesce(tasks, 0) AS tasks_with_candidates, coalesce(hits, 0) AS tasks_with_correct_candidate, round(coalesce(tasks, 0) / (SELECT count(*) FROM tasks), 6) AS task_coverage,
  round(coalesce(hits / nullif(tasks, 0), 0), 6) AS conditional_hit_rate FROM (VALUES ('low'), ('medium'), ('high')) v(confidence) LEFT JOIN x USING (confidence)""",
    "bounded_scan_cut": f"""WITH {_D}, h AS (SELECT b.ord, hash, i.path IS NOT NULL AS hit FROM b LEFT JOIN i ON i.ord = b.ord AND i.path = 'supp/7' WHERE b.ord < 12000),
r AS (SELECT *, count(*) FILTER (hit) OVER (ORDER BY ord) AS hits, max(CASE WHEN hit THEN ord END) OVER (ORDER BY ord) AS last FROM h),
x AS (SELECT coalesce(min(ord), 12000) AS stop FROM r WHERE ord + 1 >= 100 AND (hits >= 20 OR (hits >= 1 AND ord - last >= 400)))
SELECT ord, hash FROM r, x WHERE ord <= stop""",
    "history_coverage": """SELECT * FROM (VALUES
  ('git', 'target-window-exact', false, 'git-follow'), ('git', 'target-window-exact', false, 'git-follow+diff-renames'),
  ('git-remove-empty', 'target-window-exact', false, 'git-follow'), ('git-remove-empty', 'target-window-exact', false, 'git-follow+diff-renames'),
  ('pack-scan', 'target-window-exact', false, 'exact-blob-renames'), ('pack-scan', 'target-window-exact', false, 'exact-blob-renames+diff-renames'),
  ('pack-scan', 'scan-bounded', true, 'exact-blob-renames'), ('pack-scan', 'scan-bounded', true, 'exact-blob-renames+diff-renames'),
  ('pack-fast', 'latency-bounded', true, 'exact-blob-renames'), ('pack-fast', 'latency-bounded', true, 'exact-blob-renames+diff-renames'),
  ('gix', 'backend-dependent', true, 'current-path-only'), ('gix', 'backend-dependent', true, 'diff-renames-only')) v(backend, completeness, approximate, rename_tracking)""",
    "path_normalise": "SELECT page_id, array_to_string([p FOR p IN string_split('./' || replace(url, '://', '//./') || '//x/.', '/') IF p <> '' AND p <> '.'], '/') AS path FROM pages",
    "path_parts": f"""WITH {_PATHS} SELECT path, regexp_extract(path, '[^/]*$') AS base, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir,
  nullif(regexp_extract(path, '\\.([^./]+)$', 1), '') AS ext FROM paths""",
    "path_tokens": f"SELECT page_id, token, weight FROM {tokens('pages', 'url', 'page_id')}",
    "time_decay": f"WITH {_D} SELECT hash, round(exp(-ln(2) * greatest((SELECT max(t) FROM b) - t, 0) / 86400.0 / {HALF}), 9) AS decay FROM b",
    "confidence_band": f"""WITH {_S}, p AS (SELECT x.path AS a, y.path AS b, count(*) AS co FROM i x JOIN i y USING (ord) WHERE x.path < y.path GROUP BY ALL)
SELECT {BAND.format('co')} AS confidence, count(*) AS pairs FROM p GROUP BY ALL""",
}

_SEED_GRAPH = """
sg AS (SELECT s.seed, x.path AS u, y.path AS v, sum(decay / log2(n + 1)) AS weight FROM s JOIN i x USING (ord) JOIN i y USING (ord) WHERE x.path <> y.path GROUP BY ALL),
adj AS (SELECT * FROM sg), degree AS (SELECT seed, u, sum(weight) AS degree FROM adj GROUP BY seed, u)"""
_REASON = "CASE WHEN co IS NULL THEN 'pagerank_via_cochange_graph' ELSE 'pagerank_direct_evidence' END AS reason"
_OWN = demand(seeds=" AND i.path IN ('supp/1', 'supp/7')")
ORACLES["pagerank_on_demand"] = (
    f"WITH RECURSIVE {_D}, {_SEEDS}, {_OWN}, {_SEED_GRAPH}, {walks('seeds', 30, True)}, x AS (SELECT pr.seed, pr.path, pr.score, co, {_REASON} FROM pr LEFT JOIN d ON d.seed = pr.seed AND d.path = pr.path) "
    f"SELECT seed, path, rank, round(score, 6) AS score, coalesce(co, 0) AS cochanges, reason FROM {rank('x', 20)}"
)
ORACLES["pagerank_with_direct_evidence"] = (
    f"WITH RECURSIVE {_S}, {NEWEST}, {ITEMS}, {PAIRS}, {SCORED}, {BOTH}, {ADJ}, {DEGREE}, {walks('newest', 30)}, "
    f"x AS (SELECT pr.seed, pr.path, pr.score, co, {_REASON} FROM pr LEFT JOIN both_ways d ON d.seed = pr.seed AND d.path = pr.path) "
    f"SELECT seed, path, rank, round(score, 6) AS score, coalesce(co, 0) AS cochanges, reason FROM {rank('x', 50)}"
)
_AUDIT_SEEDS = demand(seeds=" AND i.path IN (SELECT seed FROM newest)")
ORACLES["audit_pagerank"] = f"""WITH RECURSIVE {_D}, {NEWEST}, {_AUDIT_SEEDS}, {_SEED_GRAPH}, {walks('newest', 30, True)},
x AS (SELECT pr.seed, pr.path, pr.score, coalesce(co, 0) AS co, coalesce(weight, 0) AS weight, coalesce(last_seen, '') AS last_seen, {_REASON} FROM pr LEFT JOIN d ON d.seed = pr.seed AND d.path = pr.path),
r AS (SELECT * FROM {rank('x', 64)} WHERE {_ELIGIBLE}),
c AS (SELECT path, {BAND.format('max(co)')} AS confidence, count(DISTINCT seed) AS support_count, string_agg(DISTINCT seed, ',' ORDER BY seed) AS supported_by, CAST(sum(co) AS BIGINT) AS cochanges,
  max(co) AS strongest, sum(score) AS score, sum(weight) AS weight, max(last_seen) AS last_seen, CASE WHEN min(reason) = max(reason) THEN min(reason) ELSE 'changed_set_cochange' END AS reason FROM r GROUP BY path)
SELECT path, {_SHOWN} FROM (SELECT * FROM c ORDER BY {ORDER} LIMIT 20)"""
ORACLES["eval_query_pagerank"] = query_metrics(
    "dense", f"{_TRAIN_SEEDS}, {_SEED_GRAPH}, seeds AS (SELECT DISTINCT path AS seed FROM tests WHERE is_known AND n_known >= 2), {walks('seeds', 30, True)}", {"pagerank": "pr"}
)
_EVAL_SEEDS = "seeds AS (SELECT DISTINCT path AS seed FROM tests WHERE is_known AND n_known >= 2)"
ORACLES["eval_query_global_pagerank"] = query_metrics(
    "dense", f"{_TRAIN_GLOBAL}, adj AS (SELECT seed AS u, path AS v, weight FROM pairs), {DEGREE}, {_EVAL_SEEDS}, {walks('seeds', 30)}", {"pagerank": "pr"}
)
_WALKED = f"{_TRAIN_SEEDS}, {_SEED_GRAPH}, {_EVAL_SEEDS}, {walks('seeds', 30, True)}, x AS (SELECT pr.seed, pr.path, pr.score, coalesce(co, 0) AS co FROM pr LEFT JOIN d USING (seed, path))"
ORACLES["eval_audit_pagerank_metrics"] = audit_metrics(audit_eval(_WALKED, "x"), "pagerank").replace("WITH ", "WITH RECURSIVE ", 1)
