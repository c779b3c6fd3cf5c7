"""The queries of the training-data operators: thin views that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.chaining import repeated_passages
from lakeloom.llm.chat import digests, format_conversations
from lakeloom.llm.collocations import collocations
from lakeloom.llm.jaccard_join import jaccard_components
from lakeloom.llm.lattice import embedding_links
from lakeloom.llm.line_dedup import dedup_lines
from lakeloom.llm.merkle import tamper_report
from lakeloom.llm.mixing import mix_sources
from lakeloom.llm.packing import pack_documents
from lakeloom.llm.pii import personal_data_report
from lakeloom.llm.syncmers import fingerprint_report
from lakeloom.llm.token_counts import section_token_counts
from lakeloom.llm.toxicity import toxicity_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    return digests(format_conversations(turns.unionByName(extra)))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_report(_table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_report(_table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_document_fingerprints": op3_document_fingerprints,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_mix_sources": op6_mix_sources,
        "op7_toxicity": op7_toxicity,
        "op8_line_dedup": op8_line_dedup,
        "op9_embedding_near_dedup": op9_embedding_near_dedup,
        "op10_chat_formatting": op10_chat_formatting,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_personal_data": op12_personal_data,
        "op13_phrase_collocations": op13_phrase_collocations,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ESCAPED = r"(len(said) + len(regexp_replace(said, '[^␛<\[]', '', 'g')))"

_FIELD = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"
_LEAF = lambda text: f"sha256({' || '.join(map(_FIELD, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
_CRC = """list_reduce(list_prepend(4294967295, list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
  lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, range(8)), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _tree(name: str, leaves: str) -> str:
    """Levels of the trees of ``leaves`` (g, i, h, n), and the siblings on the way of each leaf."""
    return f"""{name} AS (SELECT 0 AS lv, g, i, h, n FROM {leaves}
  UNION ALL SELECT lv + 1, g, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY lv, g, i // 3, n),
{name}_sib AS (SELECT lv, g, i, coalesce(string_agg(h, '') OVER (PARTITION BY lv, g, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (PARTITION BY lv, g, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name} WHERE n > 1)"""


_SQL = {
    "op11_merkle_manifest": f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF("text")} AS leaf, CASE WHEN {_CRC} & 1 = 1 THEN {_LEAF("replace(text, chr(10), '')")} ELSE {_LEAF("text")} END AS now FROM documents),
leaves AS (SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS n, doc_id, now FROM d),
{_tree("t", "leaves")},
subs AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n, g AS source FROM t WHERE n = 1),
{_tree("u", "subs")},
way AS (SELECT a.g AS source, a.i, s.lv, s.l, s.r FROM leaves a JOIN t_sib s ON s.g IS NOT DISTINCT FROM a.g AND s.i = a.i // CAST(pow(3, s.lv) AS BIGINT)
  UNION ALL SELECT a.g, a.i, 100 + s.lv, s.l, s.r FROM leaves a JOIN subs b ON b.source IS NOT DISTINCT FROM a.g JOIN u_sib s ON s.i = b.i // CAST(pow(3, s.lv) AS BIGINT)),
proof AS (SELECT source, i, string_agg(l || r, '' ORDER BY lv) AS p FROM way GROUP BY source, i),
steps AS (SELECT *, row_number() OVER (PARTITION BY source, i ORDER BY lv) AS k FROM way),
folding AS (SELECT g AS source, i, CAST(0 AS BIGINT) AS k, now AS h FROM leaves
  UNION ALL SELECT f.source, f.i, s.k, sha256(s.l || f.h || s.r) FROM folding f JOIN steps s ON s.source IS NOT DISTINCT FROM f.source AND s.i = f.i AND s.k = f.k + 1),
folded AS (SELECT source, i, arg_max(h, k) AS h FROM folding GROUP BY source, i)
SELECT a.doc_id, a.h AS leaf, b.h AS subroot, root, sha256(coalesce(p, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves a JOIN subs b ON b.source IS NOT DISTINCT FROM a.g JOIN folded f ON f.source IS NOT DISTINCT FROM a.g AND f.i = a.i LEFT JOIN proof q ON q.source IS NOT DISTINCT FROM a.g AND q.i = a.i CROSS JOIN (SELECT h AS root FROM u WHERE n = 1) z""",
    "op5_ngram_jaccard_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS there FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.there)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(there) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op9_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id, vec_id AS there FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.there),
c AS (SELECT vec_id, min(there) AS component_id FROM r GROUP BY vec_id)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, component_id = c.vec_id AS kept FROM c""",
    "op13_phrase_collocations": rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p), i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM i, range(1, 6) t(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
tot AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang), g AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM f WHERE f >= 100),
c AS (SELECT lang, k, phrase, f AS a, ws, unnest(range(1, k)) AS cut FROM g WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.k, c.a, c.cut, x.f AS l, y.f AS r, CAST(n AS BIGINT) AS n, CAST(1000 * CAST(a AS HUGEINT) * CAST(n AS HUGEINT) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM c JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:cut], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[cut + 1:], ' ') JOIN tot ON tot.lang = c.lang),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s),
held AS (SELECT DISTINCT low.lang, low.phrase FROM low JOIN g ON g.lang = low.lang AND g.k > low.k AND contains(' ' || g.phrase || ' ', ' ' || low.phrase || ' ') AND 100 * g.f >= 100 * low.a WHERE nth = 1),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM low ANTI JOIN held USING (lang, phrase) WHERE nth = 1)
SELECT * FROM r WHERE rank <= 2000""",
    "op10_chat_formatting": rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) x(k)),
m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, said) IS DISTINCT FROM role AS opens FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY turn, role, said)) AS turns_sha256,
  CAST(coalesce(sum(len(said)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(said, '' ORDER BY turn, role, said) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum({_ESCAPED} + CASE WHEN opens THEN 14 + len(role) ELSE 3 END) AS BIGINT) AS formatted_chars FROM m GROUP BY conv_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
