"""DuckDB twins of the queries, over the same tables."""

from __future__ import annotations

from lakeloom import vocab
from lakeloom.operators.probe import LINKER_MARKS

_VALUES = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)
_VERDICTS = f"verdicts(status, coarse_label, discard_reason, kept) AS (SELECT * FROM (VALUES {_VALUES([(v, c, r, c is not None) for v, c, r in vocab.VERDICTS])}) t(a, b, c, d))"
_POOL = f"pool(ord, verdict, tier, target_classes) AS (SELECT * FROM (VALUES {_VALUES([(k, *r) for k, r in enumerate(vocab.POOL_TIERS)])}) t(a, b, c, d))"


def _submissions(problem: str) -> str:
    return f"""
e AS (SELECT *, event_id % 100 AS m FROM events),
s0 AS (SELECT event_id, CAST(event_id AS VARCHAR) AS submission_id, {problem} AS problem_id, 'u' || CAST(user_id AS VARCHAR) AS user_id,
  CAST(floor(epoch(ts)) AS BIGINT) AS date, CASE WHEN event_id % 10 = 9 THEN 'Python' ELSE 'C++' END AS language,
  CASE user_id % 3 WHEN 0 THEN 'C++ (GCC 9.2.1)' WHEN 1 THEN 'C++14 (GCC 5.4.1)' ELSE 'C++17 (Clang 10)' END AS original_language,
  CASE WHEN m < 54 THEN 'Accepted' WHEN m < 80 THEN 'Wrong Answer' WHEN m < 86 THEN 'Compile Error' WHEN m < 91 THEN 'Runtime Error' WHEN m = 91 THEN 'Time Limit Exceeded'
    WHEN m = 92 THEN 'Memory Limit Exceeded' WHEN m = 93 THEN 'Output Limit Exceeded' WHEN m = 94 THEN 'Query Limit Exceeded' WHEN m = 95 THEN 'WA: Presentation Error'
    WHEN m = 96 THEN 'Judge Not Available' WHEN m = 97 THEN 'Internal error' ELSE 'Judge System Error' END AS status,
  CAST(floor(value * 10) AS INTEGER) AS code_size FROM e),
submissions AS (SELECT * EXCLUDE (event_id), CASE WHEN status <> 'Compile Error' THEN event_id % 1000 - 1 END AS cpu_time, CASE WHEN status <> 'Compile Error' THEN event_id * 7 % 4096 END AS memory FROM s0),
{_VERDICTS},
labeled AS (SELECT submission_id, problem_id, user_id, s.status, date, code_size, original_language, coarse_label FROM submissions s JOIN verdicts v ON s.status = v.status WHERE kept)"""


_SUB = "WITH RECURSIVE " + _submissions("'p' || lpad(json_extract_string(props, '$.k'), 5, '0')")
_SKEW = "WITH RECURSIVE " + _submissions("'g' || lpad(CAST(CAST(floor(sqrt(event_id)) AS BIGINT) AS VARCHAR), 4, '0')")
_CORPUS = """WITH RECURSIVE corpus AS (SELECT CAST(doc_id AS VARCHAR) AS submission_id, source AS problem_id,
  CASE doc_id % 4 WHEN 0 THEN 'ERROR_FREE' WHEN 1 THEN 'COMPILE_ERROR' WHEN 2 THEN 'RUNTIME_ERROR' ELSE 'LOGICAL' END AS coarse_label,
  strlen(text) AS code_size, strlen(text) AS bytes,
  sha256(regexp_replace(regexp_replace(regexp_replace(text, '^\ufeff', ''), '\\r\\n?', chr(10), 'g'), '[ \\t\\x0B\\f]+(\\n|$)', '\\1', 'g')) AS sha256 FROM documents)"""


def _allocated(rows: str) -> str:
    """Recursive greedy allocation of groups: largest first, each to the split that lacks most."""
    return f""",
sizes AS (SELECT problem_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, md5('42:' || problem_id), problem_id) AS r FROM {rows} WHERE problem_id IS NOT NULL GROUP BY problem_id),
whole AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM sizes),
fold AS (SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, CAST(NULL AS VARCHAR) AS problem_id, CAST(NULL AS VARCHAR) AS split
  UNION ALL SELECT r, a + CASE WHEN split = 'train' THEN n ELSE 0 END, b + CASE WHEN split = 'val' THEN n ELSE 0 END, c + CASE WHEN split = 'test' THEN n ELSE 0 END, problem_id, split FROM (
    SELECT s.r, s.n, f.a, f.b, f.c, s.problem_id, CASE WHEN total * CAST(0.6 AS DOUBLE) - a >= total * CAST(0.2 AS DOUBLE) - b AND total * CAST(0.6 AS DOUBLE) - a >= total * CAST(0.2 AS DOUBLE) - c THEN 'train' WHEN b <= c THEN 'val' ELSE 'test' END AS split
    FROM fold f JOIN sizes s ON s.r = f.r + 1 CROSS JOIN whole)),
assigned AS (SELECT problem_id, split FROM fold WHERE r > 0),
rows_split AS (SELECT t.*, g.split FROM {rows} t LEFT JOIN assigned g ON t.problem_id = g.problem_id)"""


def _random(rows: str, name: str) -> str:
    return f"SELECT t.*, CASE WHEN r <= round_even(n * CAST(0.6 AS DOUBLE), 0) THEN 'train' WHEN r <= round_even(n * CAST(0.6 AS DOUBLE), 0) + round_even(n * CAST(0.2 AS DOUBLE), 0) THEN 'val' ELSE 'test' END AS {name} FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || submission_id), submission_id) AS r, count(*) OVER () AS n FROM {rows}) t"


def _pairs(rows: str, key: str) -> str:
    one = lambda a, b: f"SELECT '{a}&{b}' AS pair, count(*) AS n FROM (SELECT {key} FROM {rows} WHERE split = '{a}' AND {key} IS NOT NULL INTERSECT SELECT {key} FROM {rows} WHERE split = '{b}')"
    return " UNION ALL ".join((one("train", "val"), one("train", "test"), one("val", "test")))


_QUOTA = "CASE split WHEN 'train' THEN 60 ELSE 20 END"


def _drawn(rows: str) -> str:
    return f""",
turns AS (SELECT *, row_number() OVER (PARTITION BY split, coarse_label, problem_id ORDER BY md5('42:' || submission_id), submission_id) AS turn FROM {rows}),
placed AS (SELECT *, row_number() OVER (PARTITION BY split, coarse_label ORDER BY turn, md5('42:' || submission_id), submission_id) AS pos FROM turns),
drawn AS (SELECT * FROM placed WHERE pos <= {_QUOTA})"""


def _keep(rows: str) -> str:
    return f""",
per AS (SELECT sha256, split, count(*) AS n FROM {rows} WHERE sha256 IS NOT NULL AND split IS NOT NULL GROUP BY ALL),
best AS (SELECT sha256, split AS keep_split FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY n DESC, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) AS r, count(*) OVER (PARTITION BY sha256) AS k FROM per) WHERE r = 1 AND k > 1),
kept AS (SELECT t.* FROM {rows} t LEFT JOIN best b ON t.sha256 = b.sha256 WHERE keep_split IS NULL OR keep_split = t.split)"""


_COARSE_COUNTS = ", ".join(f"count(*) FILTER (coarse_label = '{c}') AS \"{c}\"" for c in vocab.COARSE)
_BINS = "least(CAST(floor((least({x}, {hi}) - 0) / ({hi} / {n})) AS INTEGER), {n} - 1)"
_REPORT = """SELECT CAST(coalesce(sum(n) FILTER (sha256 IS NOT NULL), 0) AS BIGINT) AS files_hashed, CAST(0 AS BIGINT) AS files_missing, count(*) AS unique_hashes, count(*) FILTER (n > 1) AS duplicate_groups,
  CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS files_in_duplicate_groups, CAST(sum(n) - count(*) AS BIGINT) AS redundant_files, round_even((1 - count(*) / CAST(sum(n) AS DOUBLE)) * 100, 4) AS duplicate_rate_pct{more}
  FROM (SELECT sha256, count(*) AS n FROM corpus GROUP BY sha256)"""


def _described(points: tuple[float, ...]) -> list[str]:
    return ["('count', CAST(count(n) AS DOUBLE))", "('mean', avg(n))", "('std', stddev_samp(n))", "('min', CAST(min(n) AS DOUBLE))", *(f"('p{round(100 * p)}', quantile_cont(n, {p}))" for p in points), "('max', CAST(max(n) AS DOUBLE))"]


_DESCRIBE = _described((0.05, 0.25, 0.5, 0.75, 0.95))

_METADATA = _SUB + " SELECT submission_id, problem_id, user_id, date, language, original_language, 'cpp' AS filename_ext, status, CAST(cpu_time AS BIGINT) AS cpu_time, CAST(memory AS BIGINT) AS memory, CAST(code_size AS BIGINT) AS code_size FROM submissions"
_CELL = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
_LANES = ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {16 * k + 1}, 16) AS UBIGINT) AS HUGEINT)) % 18446744073709551616 AS VARCHAR)" for k in range(4))
_GUARDS = {
    "rows": "true",
    **{f"{c}_null": f"{c} IS NULL" for c in ("submission_id", "problem_id", "user_id")},
    **{f"coarse_label={c}": f"coarse_label = '{c}'" for c in vocab.COARSE},
    "coarse_label_other": f"coarse_label NOT IN {vocab.COARSE}",
}
_DRAWN = lambda k: f"CAST(CAST('0x' || substr(md5('42:' || doc_id || ':{k}'), 1, 8) AS BIGINT) % 1000003 + 1 AS DOUBLE)"

_LABELED_COLUMNS = sorted(("submission_id", "problem_id", "user_id", "status", "date", "code_size", "original_language", "coarse_label"))

SQL: dict[str, str] = {
    "verdict_distribution": _SUB + " SELECT status, count(*) AS n, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM submissions), 2) AS pct FROM submissions GROUP BY status",
    "language_status_matrix": _SUB + " SELECT language, status, count(*) AS n FROM submissions GROUP BY ALL",
    "candidate_pool": _SUB + f", {_POOL} SELECT CAST(ord AS INTEGER) AS ord, tier, verdict, target_classes, count(s.status) AS n, round_even(100.0::DOUBLE * count(s.status) / (SELECT count(*) FROM submissions), 2) AS pct_of_all FROM pool LEFT JOIN submissions s ON s.status = verdict GROUP BY ALL",
    "pool_totals": _SUB + " SELECT total, kept, round_even(100.0::DOUBLE * kept / total, 2) AS kept_pct, total - kept AS discarded, round_even(100.0::DOUBLE * (total - kept) / total, 2) AS discarded_pct FROM (SELECT count(*) AS total, (SELECT count(*) FROM labeled) AS kept FROM submissions)",
    "discard_summary": _SUB + " SELECT s.status, discard_reason, count(*) AS n, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM submissions), 4) AS pct FROM submissions s JOIN verdicts v ON s.status = v.status WHERE NOT kept GROUP BY ALL",
    "discard_by_reason": _SUB + " SELECT discard_reason, count(*) AS n, count(DISTINCT s.status) AS verdicts FROM submissions s JOIN verdicts v ON s.status = v.status WHERE NOT kept GROUP BY ALL",
    "unknown_verdicts": _SUB + " SELECT DISTINCT status FROM (SELECT CASE WHEN CAST(submission_id AS BIGINT) % 1000 = 7 THEN lower(status) ELSE status END AS status FROM submissions) WHERE status NOT IN (SELECT status FROM verdicts)",
    "labeled_manifest": _SUB + " SELECT * FROM labeled",
    "label_distribution": _SUB + " SELECT coarse_label, CAST(CASE coarse_label WHEN 'ERROR_FREE' THEN 0 WHEN 'COMPILE_ERROR' THEN 1 WHEN 'RUNTIME_ERROR' THEN 2 ELSE 3 END AS INTEGER) AS coarse_id, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM labeled) AS share FROM labeled GROUP BY coarse_label",
    "null_counts": _SUB + " SELECT * FROM (SELECT 'cpu_time' AS column_name, count(*) - count(cpu_time) AS nulls FROM submissions UNION ALL SELECT 'memory', count(*) - count(memory) FROM submissions) WHERE nulls > 0",
    "null_zero_negative_audit": _SUB + " SELECT status, count(*) AS n, " + ", ".join(f"count(*) FILTER ({c} {p}) AS {c}_{k}" for c in ("cpu_time", "memory") for k, p in (("null", "IS NULL"), ("zero", "= 0"), ("negative", "< 0"))) + ", count(*) FILTER (code_size < 0) AS code_size_negative FROM submissions GROUP BY status",
    "compiler_distribution": _SUB + " SELECT original_language, count(*) AS n, count(*) FILTER (status = 'Compile Error') AS compile_errors FROM submissions GROUP BY original_language ORDER BY n DESC, original_language LIMIT 10",
    "provenance_by_year": _SUB + " SELECT CAST(year(to_timestamp(date) AT TIME ZONE 'UTC') AS INTEGER) AS year, count(*) AS n FROM submissions GROUP BY ALL",
    "provenance_by_judge": _SUB + " SELECT CASE WHEN substr(problem_id, 6, 1) < '5' THEN 'AIZU' ELSE 'AtCoder' END AS judge, count(*) AS n FROM submissions GROUP BY ALL",
    "date_range": _SUB + " SELECT strftime(to_timestamp(min(date)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS first_day, strftime(to_timestamp(max(date)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS last_day, count(*) - count(date) AS undated FROM submissions",
    "group_size_describe": _SKEW + ", g AS (SELECT count(*) AS n FROM submissions GROUP BY problem_id) " + " UNION ALL ".join(f"SELECT {x.split(',', 1)[0][1:]} AS stat, round({x.split(',', 1)[1][:-1]}, 4) AS value FROM g" for x in _DESCRIBE),
    "code_size_describe": _SUB + ", g AS (SELECT status, language, code_size AS n FROM submissions WHERE code_size > 0) " + " UNION ALL ".join(f"SELECT status, language, {x.split(',', 1)[0][1:]} AS stat, round({x.split(',', 1)[1][:-1]}, 4) AS value FROM g GROUP BY ALL" for x in _described((0.01, 0.5, 0.99))),
    "concentration_share": _SKEW + ", g AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS k, sum(n) OVER (ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER () AS total FROM (SELECT count(*) AS n FROM submissions GROUP BY problem_id)) SELECT CAST(k AS INTEGER) AS k, round(CAST(upto AS DOUBLE) / total, 6) AS share FROM g WHERE k IN (10, 50, 100, 500, 1000)",
    "code_size_truncation": _SUB + ", x AS (SELECT status, code_size FROM submissions WHERE code_size > 0 UNION ALL SELECT 'ALL', code_size FROM submissions WHERE code_size > 0) SELECT status, count(*) AS n, round(quantile_cont(code_size, 0.5), 4) AS median, round(quantile_cont(code_size, 0.95), 4) AS p95, round(avg(CASE WHEN code_size > 1792 THEN 1.0 ELSE 0.0 END), 6) AS over_share FROM x GROUP BY status",
    "code_size_histogram": _SUB + f" SELECT {_BINS.format(x='CAST(code_size AS DOUBLE)', hi='8000.0::DOUBLE', n=80)} AS bin, count(*) AS n FROM submissions WHERE code_size >= 0 GROUP BY ALL",
    "group_size_histogram": _SKEW + f", g AS (SELECT count(*) AS n FROM submissions GROUP BY problem_id) SELECT {_BINS.format(x='CAST(n AS DOUBLE)', hi='600.0::DOUBLE', n=60)} AS bin, count(*) AS n FROM g GROUP BY ALL",
    "chain_profile": _SUB + ", c AS (SELECT count(*) AS length FROM labeled GROUP BY user_id, problem_id), t AS (SELECT count(*) AS pairs, count(*) FILTER (length > 1) AS multi, CAST(coalesce(sum(length) FILTER (length > 1), 0) AS BIGINT) AS in_chains, sum(length) AS total, max(length) AS longest FROM c) SELECT pairs, multi, round_even(100.0::DOUBLE * multi / pairs, 2) AS multi_pct, in_chains, round_even(100.0::DOUBLE * in_chains / CAST(total AS BIGINT), 2) AS in_chains_pct, longest FROM t",
    "chain_length_topk": _SUB + ", c AS (SELECT count(*) AS length FROM labeled GROUP BY user_id, problem_id) SELECT length, count(*) AS n FROM c GROUP BY length ORDER BY n DESC, length LIMIT 8",
    "random_split": _SUB + f" SELECT submission_id, random_split FROM ({_random('submissions', 'random_split')})",
    "group_split_lpt": _SKEW + _allocated("labeled") + " SELECT problem_id, split, count(*) AS n FROM rows_split GROUP BY ALL",
    "split_summary": _SKEW + _allocated("labeled") + f", c AS (SELECT split, count(*) AS n, {_COARSE_COUNTS} FROM rows_split GROUP BY split) SELECT CAST(ord AS INTEGER) AS ord, o.split, coalesce(n, 0) AS rows, round_even(100.0::DOUBLE * coalesce(n, 0) / (SELECT CAST(sum(n) AS BIGINT) FROM c), 2) AS pct, " + ", ".join(f'coalesce("{c}", 0) AS "{c}"' for c in vocab.COARSE) + " FROM (VALUES (0, 'train'), (1, 'val'), (2, 'test')) o(ord, split) LEFT JOIN c ON c.split = o.split",
    "split_class_composition": _SKEW + _allocated("labeled") + " SELECT split, " + ", ".join(f"round_even(100.0::DOUBLE * count(*) FILTER (coarse_label = '{c}') / count(*), 4) AS \"{c}\"" for c in vocab.COARSE) + " FROM rows_split GROUP BY split",
    "problem_overlap_group": _SKEW + _allocated("labeled") + " " + _pairs("rows_split", "problem_id"),
    "problem_overlap_random": _SKEW + f", x AS ({_random('labeled', 'split')}) " + _pairs("x", "problem_id"),
    "chain_straddle": _SUB + _allocated("labeled") + f", x AS ({_random('rows_split', 'random_split')}), c AS (SELECT count(*) AS n, count(DISTINCT split) AS a, count(DISTINCT random_split) AS b FROM x GROUP BY user_id, problem_id) SELECT count(*) AS chains, count(*) FILTER (n > 1) AS multi, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS submissions, count(*) FILTER (n > 1 AND a > 1) AS split_straddling, count(*) FILTER (n > 1 AND b > 1) AS random_split_straddling FROM c",
    "quota_table": _SUB + ", t AS (SELECT coarse_label, greatest(1, round_even(count(*) * CAST(0.1 AS DOUBLE), 0)) AS n FROM labeled GROUP BY coarse_label), q AS (SELECT coarse_label, n, round_even(n * CAST(0.6 AS DOUBLE), 0) AS train, round_even(n * CAST(0.2 AS DOUBLE), 0) AS val FROM t) "
    + " UNION ALL ".join(f"SELECT '{split}' AS split, coarse_label, CAST({x} AS INTEGER) AS requested FROM q" for split, x in (("train", "train"), ("val", "val"), ("test", "n - train - val"))),
    "round_robin_sample": _SKEW + _allocated("labeled") + _drawn("rows_split") + " SELECT submission_id, problem_id, split, coarse_label FROM drawn",
    "sampling_report": _SKEW + _allocated("labeled") + _drawn("rows_split") + f", cells AS (SELECT * FROM (VALUES ('train'), ('val'), ('test')) a(split) CROSS JOIN (VALUES {_VALUES([(c,) for c in vocab.COARSE])}) b(coarse_label)), av AS (SELECT split, coarse_label, count(*) AS available FROM rows_split GROUP BY ALL), pg AS (SELECT split, coarse_label, problem_id, count(*) AS n FROM drawn GROUP BY ALL), tk AS (SELECT split, coarse_label, CAST(sum(n) AS BIGINT) AS taken, count(*) AS problems, max(n) AS m FROM pg GROUP BY ALL) SELECT split, coarse_label, CAST({_QUOTA} AS INTEGER) AS requested, coalesce(available, 0) AS available, coalesce(taken, 0) AS taken, greatest({_QUOTA} - coalesce(taken, 0), 0) AS shortfall, coalesce(problems, 0) AS problems, coalesce(m, 0) AS max_per_problem FROM cells LEFT JOIN av USING (split, coarse_label) LEFT JOIN tk USING (split, coarse_label)",
    "round_robin_coverage": _SKEW + ", k AS (SELECT *, md5('42:' || submission_id) AS k FROM labeled), t AS (SELECT *, row_number() OVER (PARTITION BY coarse_label, problem_id ORDER BY k, submission_id) AS turn, row_number() OVER (PARTITION BY coarse_label ORDER BY k, submission_id) AS plain FROM k), p AS (SELECT *, row_number() OVER (PARTITION BY coarse_label ORDER BY turn, k, submission_id) AS pos FROM t) SELECT coarse_label, count(DISTINCT CASE WHEN pos <= 100 THEN problem_id END) AS round_robin_groups, count(DISTINCT CASE WHEN plain <= 100 THEN problem_id END) AS naive_groups FROM p GROUP BY coarse_label",
    "archive_paths": _SUB + " SELECT submission_id, 'Project_CodeNet/data/' || problem_id || '/C++/' || submission_id || '.cpp' AS archive_path, problem_id || '/C++/' || submission_id || '.cpp' AS rel_path FROM labeled",
    "content_hashes": _CORPUS + " SELECT submission_id AS path, sha256, CAST(bytes AS BIGINT) AS bytes, true AS exists FROM corpus",
    "duplicate_groups": _CORPUS + " SELECT sha256, count(*) OVER g AS count, min(submission_id) OVER g AS representative, row_number() OVER (PARTITION BY sha256 ORDER BY submission_id) AS place, submission_id AS path FROM corpus WINDOW g AS (PARTITION BY sha256) QUALIFY count(*) OVER g > 1",
    "dedup_report": _CORPUS + " " + _REPORT.format(more=""),
    "cross_split_overlap": _CORPUS + _allocated("corpus") + " " + _pairs("rows_split", "sha256"),
    "collision_forensics": _CORPUS + _allocated("corpus") + " SELECT sha256, count(*) AS files, concat_ws(',', CASE WHEN bool_or(split = 'train') THEN 'train' END, CASE WHEN bool_or(split = 'val') THEN 'val' END, CASE WHEN bool_or(split = 'test') THEN 'test' END) AS splits FROM rows_split GROUP BY sha256 HAVING count(DISTINCT split) > 1",
    "label_consistency": _CORPUS + " SELECT count(*) FILTER (k = 1) AS one_label, count(*) FILTER (k > 1) AS several_labels FROM (SELECT count(DISTINCT coarse_label) AS k FROM corpus GROUP BY sha256 HAVING count(*) > 1)",
    "plurality_exclusion": _CORPUS + _allocated("corpus") + _keep("rows_split") + " SELECT submission_id, split, sha256 FROM kept",
    "final_report": _CORPUS + _allocated("corpus") + _keep("rows_split") + " " + _REPORT.format(more=", (SELECT count(*) FROM rows_split) - (SELECT count(*) FROM kept) AS rows_dropped_cross_split_dedup"),
    "path_reconciliation": _CORPUS + ", n AS (SELECT submission_id, CAST(submission_id AS BIGINT) AS k FROM corpus) SELECT submission_id, 'missing' AS side FROM n WHERE k % 7 <> 0 AND k % 11 = 0 UNION ALL SELECT submission_id, 'extra' FROM n WHERE k % 7 = 0 AND k % 11 <> 0",
    "byte_check": "SELECT doc_id AS id, n_chars AS code_size, CAST(strlen(text) AS INTEGER) AS length, strlen(text) - n_chars AS diff FROM documents",
    "byte_check_summary": "SELECT count(*) AS compared, avg(CASE WHEN strlen(text) = n_chars THEN 1.0 ELSE 0.0 END) AS equal_share, min(strlen(text) - n_chars) AS least, max(strlen(text) - n_chars) AS most FROM documents",
    "worst_byte_diffs": "SELECT doc_id AS id, n_chars AS code_size, CAST(strlen(text) AS INTEGER) AS length, strlen(text) - n_chars AS diff FROM documents ORDER BY abs(strlen(text) - n_chars) DESC, doc_id LIMIT 5",
    "taxonomy_leaf_dim": _SUB + f", d AS (SELECT CAST(a AS INTEGER) AS leaf_id, b AS leaf, c AS coarse_label, CAST(d AS INTEGER) AS coarse_id, CAST(e AS INTEGER) AS tier, f AS terminal FROM (VALUES {_VALUES([(k, leaf, parent, vocab.COARSE.index(parent), tier, leaf == parent) for k, (leaf, parent, tier) in enumerate(vocab.LEAVES)])}) t(a, b, c, d, e, f))" + ", c AS (SELECT coarse_label, count(*) AS n FROM labeled GROUP BY coarse_label) SELECT d.*, coalesce(n, 0) AS class_rows, CASE WHEN terminal THEN coalesce(n, 0) ELSE 0 END AS leaf_rows FROM d LEFT JOIN c ON c.coarse_label = d.coarse_label",
    "encoding_mix": "WITH f AS (SELECT doc_id % 5 AS kind, regexp_matches(text, '[^\\x00-\\x7F]') AS high FROM documents) SELECT CASE kind WHEN 0 THEN 'shift_jis' WHEN 1 THEN 'neither' ELSE 'utf-8' END AS encoding, count(*) AS n, count(*) FILTER (kind < 2 OR high) AS high_byte FROM f GROUP BY ALL",
    "encoding_survey": """SELECT 'utf-8' AS encoding, count(*) AS n, count(*) FILTER (strlen(text) <> len(text)) AS high_byte FROM (
  SELECT text FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR) LIMIT 2000) HAVING count(*) > 0""",
    "metadata_csv": _METADATA,
    "incremental_metadata": _METADATA,
    "archive_members": _CORPUS + " SELECT 'Project_CodeNet/data/' || problem_id || '/C++/' || submission_id || '.cpp' AS name, bytes AS size, true AS regular FROM corpus WHERE problem_id LIKE 'src1%'",
    "extracted_tree": _CORPUS + " SELECT problem_id || '/C++/' || submission_id || '.cpp' AS path, bytes AS length, sha256 FROM corpus",
    "artifact_digests": _SKEW + _allocated("labeled") + f", r AS (SELECT split, sha256({' || '.join(map(_CELL, _LABELED_COLUMNS))}) AS h FROM rows_split) SELECT split, count(*) AS rows, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {_LANES})) AS digest FROM r GROUP BY split",
    "frozen_config": _SKEW + _allocated("labeled") + f", r AS (SELECT split, sha256({' || '.join(map(_CELL, sorted((*_LABELED_COLUMNS, 'split'))))}) AS h FROM rows_split) SELECT CAST(42 AS BIGINT) AS seed, '{vocab.TAXONOMY_VERSION}' AS taxonomy_version, " + ", ".join(f"count(*) FILTER (split = '{x}') AS {x}_rows" for x in vocab.SPLITS) + f", sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {_LANES})) AS digest FROM r",
    "stderr_classes": f"WITH s AS (SELECT doc_id, doc_id % 5 AS kind, coalesce(text, '') || CASE doc_id % 5 WHEN 1 THEN ': {LINKER_MARKS[0]} to main' WHEN 2 THEN chr(10) || '{LINKER_MARKS[1]} 1 exit status' ELSE '' END AS said FROM documents) SELECT doc_id, CASE kind WHEN 0 THEN 'COMPILED_CLEAN' ELSE 'FAILED' END AS outcome, CASE WHEN kind = 0 THEN NULL WHEN contains(said, '{LINKER_MARKS[0]}') OR contains(said, '{LINKER_MARKS[1]}') THEN 'LINKER' ELSE 'OTHER' END AS classification, right(said, 300) AS stderr_tail FROM s",
    "guarded_manifest": _SUB + " " + " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) FILTER ({c}) AS n FROM labeled" for m, c in _GUARDS.items()),
    "predict_distribution": f"WITH s AS (SELECT doc_id, [{', '.join(map(_DRAWN, range(len(vocab.SERVING_CLASSES))))}] AS s FROM documents WHERE len(text) BETWEEN 1 AND 50000), p AS (SELECT doc_id, list_transform(s, lambda x: x / list_sum(s)) AS p FROM s) SELECT doc_id, {list(vocab.SERVING_CLASSES)}[list_position(p, list_max(p))] AS predicted_class, round(list_max(p), 9) AS confidence, "
    + ", ".join(f"round(p[{k + 1}], 9) AS p_{label}" for k, label in enumerate(vocab.SERVING_CLASSES)) + ", 'dummy-random-v1' AS model_name, true AS is_placeholder FROM p",
    "report_csv": _SUB + " SELECT status, CAST(count(*) AS BIGINT) AS n FROM submissions GROUP BY status",
    "path_lines": "SELECT DISTINCT CAST(doc_id AS VARCHAR) || '.cpp' AS archive_path FROM documents",
    "exact_n_sample": _SUB + " SELECT submission_id, status FROM submissions ORDER BY md5('42:' || submission_id), submission_id LIMIT 500",
    "clean_corpus": _CORPUS + _allocated("corpus") + _drawn("rows_split") + _keep("drawn") + " SELECT submission_id, problem_id, coarse_label, split, sha256 FROM kept",
}
