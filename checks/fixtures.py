"""Deterministic fixtures over the given tables, one SQL text for both engines.

``@name@`` stands for a base table and ``@range n AS c@`` for "every row times the
numbers 0..n-1 in column c". On Spark the latter is a LATERAL VIEW explode (a map-side
generator, not a join). A fixture may use fixtures named before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from math import prod

from pyspark.sql import DataFrame, SparkSession

FIXTURES: dict[str, str] = {}

FIXTURES["eval_results"] = """
WITH base AS (
  SELECT o_orderkey AS k, m, o_orderpriority AS question_category, o_orderstatus AS question_type,
    (o_orderkey*7919 + m*104729 + 13) % 1000 AS h, (o_orderkey*31 + m*17) % 5 AS c5,
    o_orderkey % 6 AS ci, CAST(floor(o_orderkey/6) AS BIGINT) % 3 AS ii, CAST(floor(o_orderkey/18) AS BIGINT) % 4 AS g
  FROM @orders@ @range 5 AS m@),
lab AS (
  SELECT *, concat('model_', CAST(m AS STRING)) AS model_id, concat('s', CAST(k AS STRING)) AS sample_id,
    concat('gen_', CAST(g AS STRING)) AS generator_model,
    CASE ii WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS intensity,
    CASE ci WHEN 0 THEN 'P-Ambiguity' WHEN 1 THEN 'P-Contradiction' WHEN 2 THEN 'P-MissingInfo' WHEN 3 THEN 'P-FalsePremise'
            WHEN 4 THEN 'P-GranularityMismatch' ELSE 'P-EpistemicMismatch' END AS perturbation_class,
    CASE ci WHEN 0 THEN 'REFUSE_AMBIGUOUS_QUERY' WHEN 1 THEN 'REFUSE_CONTRADICTORY_CONTEXT'
            WHEN 2 THEN 'REFUSE_INFO_MISSING_IN_CONTEXT' WHEN 3 THEN 'REFUSE_FALSE_PREMISE_IN_QUERY'
            WHEN 4 THEN 'REFUSE_GRANULARITY_MISMATCH' ELSE 'REFUSE_NONFACTUAL_QUERY' END AS code
  FROM base),
gt AS (SELECT *, CASE WHEN intensity='LOW' THEN 'ANSWER_CORRECTLY' ELSE code END AS ground_truth_label FROM lab),
pr AS (
  SELECT *, CASE
    WHEN h >= 985 THEN 'ERROR'
    WHEN intensity='LOW' THEN CASE WHEN h < 600 + 50*m THEN 'answer_attempt' ELSE code END
    WHEN h < 250 + 60*m + 10*ci THEN code
    WHEN h < 700 THEN 'REFUSE_OTHER'
    ELSE 'answer_attempt' END AS model_predicted_type
  FROM gt)
SELECT k, model_id, sample_id, generator_model, question_category, question_type, perturbation_class, intensity,
  ground_truth_label, model_predicted_type, ground_truth_label='ANSWER_CORRECTLY' AS is_answerable,
  CASE WHEN intensity='LOW' AND model_predicted_type='answer_attempt' AND h % 50 <> 0 THEN CAST(1 + h % 5 AS DOUBLE) END AS answer_quality_score,
  CASE WHEN model_predicted_type='ERROR' THEN CAST(NULL AS BOOLEAN)
       WHEN intensity='LOW' AND model_predicted_type='answer_attempt' THEN CAST(NULL AS BOOLEAN)
       ELSE model_predicted_type = ground_truth_label END AS refusal_match_correct,
  CASE WHEN intensity<>'LOW' THEN CAST(NULL AS INT) WHEN model_predicted_type<>'answer_attempt' THEN 0
       WHEN h % 10 < 7 THEN 1 ELSE 0 END AS raf_score,
  CASE WHEN intensity<>'LOW' THEN CAST(NULL AS INT) WHEN model_predicted_type<>'answer_attempt' THEN 0
       WHEN h % 10 < 9 THEN 1 ELSE 0 END AS eligibility_score,
  CASE c5 WHEN 0 THEN 'VERY_UNCERTAIN' WHEN 1 THEN 'UNCERTAIN' WHEN 2 THEN 'SOMEWHAT_CONFIDENT'
          WHEN 3 THEN 'CONFIDENT' ELSE 'VERY_CONFIDENT' END AS confidence_level
FROM pr
"""

FIXTURES["verifications"] = """
WITH b AS (
  SELECT p_partkey AS p, g, v, (p_partkey*7919 + g*104729 + v*1299709 + 17) % 1000 AS h,
    p_partkey % 6 AS ci, CAST(floor(p_partkey/6) AS BIGINT) % 3 AS ii, CAST(floor(p_partkey/18) AS BIGINT) AS q
  FROM @part@ @range 4 AS g@ @range 4 AS v@),
r AS (SELECT *, CASE WHEN h >= 960 THEN 'ERROR' WHEN h >= 920 - 15*g - 20*v - CASE WHEN g=v THEN 0 ELSE 25 END THEN 'FAIL' ELSE 'PASS' END AS outcome,
        p AS line_no FROM b WHERE h < 990
      UNION ALL
      SELECT *, 'FAIL' AS outcome, p + 1000000000 AS line_no FROM b WHERE h < 990 AND p % 50 = 0 AND v = 2)
SELECT CASE g WHEN 0 THEN 'claude' WHEN 1 THEN 'deepseek' WHEN 2 THEN 'gpt' ELSE 'nova' END AS generator_model,
  CASE v WHEN 0 THEN 'claude' WHEN 1 THEN 'nova' WHEN 2 THEN 'gpt' ELSE 'deepseek' END AS verifier_model,
  v AS verifier_ord, line_no, concat('q', CAST(q AS STRING)) AS source_qid,
  concat('query ', CAST(p AS STRING)) AS original_query, concat('context ', CAST(p AS STRING)) AS original_context,
  concat('pq ', CAST(p AS STRING), ' g', CAST(g AS STRING)) AS perturbed_query,
  concat('pc ', CAST(p AS STRING), ' g', CAST(g AS STRING)) AS perturbed_context,
  CASE ci WHEN 0 THEN 'P-Ambiguity' WHEN 1 THEN 'P-Contradiction' WHEN 2 THEN 'P-MissingInfo' WHEN 3 THEN 'P-FalsePremise'
          WHEN 4 THEN 'P-GranularityMismatch' ELSE 'P-EpistemicMismatch' END AS perturbation_class,
  CASE ii WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS intensity,
  concat('lever_', CAST((p + g) % 5 AS STRING)) AS lever_selected, TRUE AS generation_successful,
  outcome <> 'ERROR' AS verification_successful,
  CASE WHEN outcome = 'ERROR' THEN NULL ELSE outcome END AS verification_result,
  CASE WHEN outcome = 'ERROR' THEN CAST(NULL AS BOOLEAN) ELSE h % 7 <> 0 END AS lever_correctly_implemented,
  CASE WHEN outcome = 'ERROR' THEN CAST(NULL AS BOOLEAN) ELSE h % 11 <> 0 END AS intensity_correctly_achieved,
  CASE WHEN outcome = 'ERROR' THEN CAST(NULL AS BOOLEAN) ELSE h % 13 <> 0 END AS uncertainty_successfully_induced
FROM r
"""

FIXTURES["grounding_passages"] = """
SELECT concat('s', CAST(l_orderkey AS STRING)) AS sample_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS INT) AS idx,
  concat('passage part ', CAST(l_partkey AS STRING), ' supplier ', CAST(l_suppkey AS STRING)) AS passage,
  CASE l_returnflag WHEN 'R' THEN 'ANSWER-THE-QUESTION' WHEN 'A' THEN 'RELATED-INFORMATION' ELSE 'OUTDATED' END AS evidence_correct,
  CASE l_linestatus WHEN 'F' THEN 'YES' ELSE 'NO' END AS evidence_cited
FROM @lineitem@
"""

FIXTURES["part_passages"] = """
SELECT concat('p', CAST(l_partkey AS STRING)) AS sample_id, l_partkey AS k,
  CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) - 1 AS INT) AS idx,
  concat('passage order ', CAST(l_orderkey AS STRING), ' line ', CAST(l_linenumber AS STRING)) AS passage,
  CASE l_returnflag WHEN 'R' THEN 'ANSWER-THE-QUESTION' WHEN 'A' THEN 'RELATED-INFORMATION' ELSE 'OUTDATED' END AS evidence_correct,
  CASE l_linestatus WHEN 'F' THEN 'YES' ELSE 'NO' END AS evidence_cited
FROM @lineitem@
"""

FIXTURES["base_instances"] = """
SELECT doc_id AS line_no, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE concat('d', CAST(doc_id AS STRING)) END AS qid,
  CASE WHEN doc_id % 23 = 0 THEN '' ELSE text END AS query,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END AS gold_doc,
  CASE WHEN doc_id % 29 = 0 THEN NULL ELSE concat('retrieved ', lang, ' ', source) END AS retrieved_doc,
  lang AS answer
FROM @documents@
"""

FIXTURES["judge_responses"] = """
SELECT k, model_id, sample_id, is_answerable, ground_truth_label,
  CASE WHEN k % 40 = 0 THEN concat('the model said ', lower(model_predicted_type))
       WHEN k % 41 = 0 THEN 'no verdict'
       ELSE concat('CLASSIFICATION: ', model_predicted_type, chr(10), 'QUALITY_SCORE: ',
         CASE WHEN answer_quality_score IS NULL THEN 'N/A' ELSE CAST(CAST(answer_quality_score AS INT) AS STRING) END, chr(10),
         'ELIGIBILITY: ', CASE WHEN eligibility_score IS NULL THEN 'N/A' ELSE CAST(eligibility_score AS STRING) END, chr(10),
         'FACTUALITY_RELEVANT: ', CASE WHEN raf_score IS NULL THEN 'N/A' ELSE CAST(raf_score AS STRING) END, chr(10),
         'EXPLANATION: because ', sample_id) END AS response
FROM eval_results
"""

FIXTURES["json_responses"] = """
SELECT p_partkey AS id, CAST(p_partkey % 6 AS INT) AS shape,
  CASE p_partkey % 6
   WHEN 0 THEN concat('```json', chr(10), body, chr(10), '```')
   WHEN 1 THEN concat('```', chr(10), body, chr(10), '```')
   WHEN 2 THEN body
   WHEN 3 THEN concat('```json', chr(10), body)
   WHEN 4 THEN substring(body, 1, 30)
   ELSE concat('Here it is: ```json', chr(10), body, chr(10), '``` done') END AS response
FROM (SELECT p_partkey, concat('{"perturbed_query": "', p_name, '", "lever_selected": "', p_type, '", "intensity_achieved": "HIGH"}') AS body FROM @part@) t
"""

FIXTURES["patches"] = """
WITH pos AS (
  SELECT sample_id, idx, CASE WHEN evidence_correct='ANSWER-THE-QUESTION' THEN 'signal' ELSE 'noise' END AS kind,
    CAST(row_number() OVER (PARTITION BY sample_id, CASE WHEN evidence_correct='ANSWER-THE-QUESTION' THEN 'signal' ELSE 'noise' END ORDER BY idx) - 1 AS INT) AS pos
  FROM grounding_passages)
SELECT sample_id, kind, idx AS seq, pos AS original_index, concat('patched ', sample_id, ' ', CAST(idx AS STRING)) AS perturbed_text FROM pos WHERE idx % 3 = 0
UNION ALL
SELECT sample_id, kind, idx + 100 AS seq, pos AS original_index, concat('repatched ', sample_id, ' ', CAST(idx AS STRING)) AS perturbed_text FROM pos WHERE idx = 0
UNION ALL
SELECT sample_id, kind, idx + 200 AS seq, pos + 50 AS original_index, 'out of range' AS perturbed_text FROM pos WHERE idx = 1
"""

FIXTURES["originals"] = """
SELECT concat('q', CAST(c_custkey AS STRING)) AS qid, c_name AS answer, concat('gold ', c_mktsegment) AS doc0,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('second ', c_mktsegment) END AS doc1
FROM @customer@ WHERE c_custkey % 10 <> 3
"""

_TABLE = re.compile(r"@(\w+)@")
_RANGE = re.compile(r"@range (\d+) AS (\w+)@")
_EXPANDED = re.compile(r"@(\w+)@((?:\s*@range \d+ AS \w+@)+)")

#: bytes of a table file, times the rows made of each of its rows, that one task expands
SPREAD_BYTES = 1_000_000


def needed(text: str) -> list[str]:
    """Fixtures a text depends on, directly or not, in definition order."""
    found: set[str] = set()
    todo = [text]
    while todo:
        body = todo.pop()
        for name in FIXTURES:
            if name not in found and re.search(rf"\b{name}\b", body):
                found.add(name)
                todo.append(FIXTURES[name])
    return [name for name in FIXTURES if name in found]


def with_ctes(text: str) -> str:
    """Put every needed fixture in front of a query as a CTE."""
    text = text.strip()
    ctes = [f"{name} AS ({FIXTURES[name].strip()})" for name in needed(text)]
    if not ctes:
        return text
    if text[:5].upper() == "WITH ":
        return f"WITH {', '.join(ctes)}, {text[5:]}"
    return f"WITH {', '.join(ctes)} {text}"


def for_duckdb(text: str) -> str:
    text = _RANGE.sub(r"CROSS JOIN (SELECT unnest(range(0, \1)) AS \2) AS r_\2", with_ctes(text))
    return _TABLE.sub(r"\1", text)


def for_spark(text: str, sf_dir: str, sizes: Callable[[str], int] | None = None) -> str:
    """``sizes`` gives a file's bytes. A table of which every row becomes several is dealt out first: its
    file is one split up to 128 MB, so one task would make all the rows. How finely follows the size."""
    def each(m: re.Match) -> str:
        return f"LATERAL VIEW explode(sequence(0L, {int(m[1]) - 1}L)) r_{m[2]} AS {m[2]}"

    def spread(m: re.Match) -> str:
        table = f"parquet.`{sf_dir}/{m[1]}.parquet`"
        parts = prod(int(n) for n, _ in _RANGE.findall(m[2])) * sizes(f"{sf_dir}/{m[1]}.parquet") // SPREAD_BYTES
        return (f"(SELECT /*+ REPARTITION({parts}) */ * FROM {table})" if parts > 1 else table) + m[2]

    text = with_ctes(text)
    if sizes is not None:
        text = _EXPANDED.sub(spread, text)
    return _TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", _RANGE.sub(each, text))


def file_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder wherever Spark can read it; 0 if there is none."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return filesystem.getContentSummary(hadoop_path).getLength() if filesystem.exists(hadoop_path) else 0


def on_spark(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(for_spark(text, sf_dir, lambda path: file_size(spark, path)))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return on_spark(spark, sf_dir, f"SELECT * FROM {name}")
