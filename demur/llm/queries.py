"""The operators over their whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demur.llm import (
    alignment, byte_bpe, conversations, decontamination, exact_dedup, language_id, near_dedup, packing, personal_data, quality, repeats,
    token_counts, token_output,
)
from demur.llm.common import table
from demur.llm.shingling import MARKS

# words and shingles as in shingling.py, in SQL
_MARKS = MARKS.replace("'", "''")
_SHINGLES = """
    {name}_words AS (
        SELECT {key}, list_filter(
            list_transform(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: trim(w, '{marks}')), lambda w: w <> ''
        ) AS w FROM {source}
    ),
    {name} AS (
        SELECT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
        FROM {name}_words
    )"""


def shingles_sql(name: str, source: str, key: str) -> str:
    return _SHINGLES.format(name=name, source=source, key=key, marks=_MARKS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(table(spark, sf_dir, "documents"))


@query("op2_suffix_dedup", """
    WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    windows AS (
        SELECT doc_id, unnest(range(0, greatest(0, len(h) // 2 - 49))) AS pos FROM bytes
    ),
    strings AS (SELECT w.doc_id, pos, md5(substr(h, 2 * pos + 1, 100)) AS s FROM windows w JOIN bytes USING (doc_id)),
    earliest AS (SELECT s, min(doc_id) AS first_doc FROM strings GROUP BY s),
    hits AS (SELECT doc_id, pos FROM strings JOIN earliest USING (s) WHERE first_doc < doc_id),
    marked AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM hits),
    numbered AS (
        SELECT doc_id, pos, sum(CASE WHEN before IS NULL OR pos > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS span
        FROM marked
    ),
    spans AS (SELECT doc_id, span, min(pos) AS lo, max(pos) + 50 AS hi FROM numbered GROUP BY ALL),
    gaps AS (
        SELECT doc_id, span, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY span), 0) AS since FROM spans
    ),
    kept AS (
        SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last,
            string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY span) AS head
        FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id
    )
    SELECT b.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
        sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM bytes b LEFT JOIN kept k ON k.doc_id = b.doc_id
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def near_sql(source: str) -> str:
    return f"""{shingles_sql("d", source, "doc_id")},
    counts AS (SELECT doc_id, shingle, count(*) AS c FROM d GROUP BY ALL),
    sizes AS (SELECT doc_id, sum(c) AS n FROM counts GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS common
        FROM counts a JOIN counts b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL
    ),
    links AS (
        SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE common / (x.n + y.n - common) >= 0.8 - 1e-12
    ),
    reach(a, b) AS (SELECT doc_id, doc_id FROM {source} UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)"""


@query("op3_near_dedup", f"WITH RECURSIVE {near_sql('documents')} SELECT doc_id, class_id, doc_id = class_id AS kept FROM classes")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op5_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op6_token_output")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokens_in_shared_folder(spark, table(spark, sf_dir, "documents"))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op8_benchmark_decontamination", f"""
    WITH {shingles_sql("d", "documents", "doc_id")}, {shingles_sql("b", "benchmark", "item_id")},
    docs AS (SELECT DISTINCT doc_id, shingle FROM d), items AS (SELECT DISTINCT item_id, shingle FROM b),
    sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id)
    SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
    FROM docs JOIN items USING (shingle) JOIN sizes USING (item_id)
    GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_personal_data")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(table(spark, sf_dir, "documents"))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit_conversations(conversations.damage(table(spark, sf_dir, "conversations")), F.col("present"))


@query("op13_byte_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.encode(table(spark, sf_dir, "documents")))
