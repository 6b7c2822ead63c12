"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .balltree import top_k
from .decontam import find as find_benchmark
from .katz import score
from .langid import identify
from .linedup import dedup_lines
from .mixing import mix
from .omh import near_duplicates
from .preference import assemble, segments
from .repeats import drop_repeats
from .warczip import read_archives, write_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), keep=["doc_id"])


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT no_source, source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY no_source, source) - 1) % 3 + 1.0e0 AS w FROM d GROUP BY 1, 2),
f AS (SELECT *, 3e0 * source_size AS cap, 3e0 * source_size / w AS full_at FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0e0)) / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0e0)) AS level, row_number() OVER (ORDER BY full_at, no_source, source) AS rank
      FROM f WINDOW earlier AS (ORDER BY full_at, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT no_source, source, source_size, least(coalesce((SELECT arg_min(level, rank) FROM l WHERE level <= full_at) * w, cap), cap) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY no_source, source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      least(floor(target / greatest(source_size, 1)), 3) AS epochs FROM d JOIN t USING (no_source, source))
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, CASE WHEN epochs < 3 THEN floor(target - epochs * source_size) ELSE 0 END - before)))::BIGINT AS taken FROM p
"""


def op9_warczip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages")), payloads=False).drop("url")


OP9_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS hex FROM p),
d AS (SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, k * 5 + 1, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT + 1, 1), '' ORDER BY k, j)
      FROM range(8) a(k), range(4) c(j)) AS payload_digest, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS largest FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to FROM d
"""

def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT rid, s, n, item_id FROM dw JOIN iw USING (n, win)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""

def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) form pair k; a row a pair, with the spans of the completions that carry the loss as text."""
    turns = table(spark, sf_dir, "conversations")
    pairs = assemble(segments(turns, F.floor(turns["conv_id"] / 2).cast("long"), F.pmod(turns["conv_id"], F.lit(2)) == 0))
    spans = [F.array_join(F.transform(f"{p}_loss", lambda x: F.concat_ws("-", x["from"].cast("string"), x["to"].cast("string"))), ",").alias(f"{p}_loss") for p in ("chosen", "rejected")]
    return pairs.select("pair_id", "paired", "prompt", "chosen", "rejected", *spans)


OP6_SQL = r"""
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS good, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT pair_id, turn, list_sort(list(role || chr(10) || text) FILTER (good)) IS DISTINCT FROM list_sort(list(role || chr(10) || text) FILTER (NOT good)) AS differs FROM t GROUP BY 1, 2),
c AS (SELECT pair_id, min(turn) FILTER (differs) AS cut FROM s GROUP BY 1),
b AS (SELECT pair_id, count(DISTINCT good) = 2 AS paired FROM t GROUP BY 1),
r AS (SELECT t.*, paired, paired AND (cut IS NULL OR turn < cut) AS common FROM t JOIN c USING (pair_id) JOIN b USING (pair_id)),
o AS (SELECT pair_id, paired, CASE WHEN common THEN 'prompt' WHEN good THEN 'chosen' ELSE 'rejected' END AS part, turn, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered, NOT common AND role = 'assistant' AS loss
      FROM r WHERE NOT common OR good),
p AS (SELECT *, coalesce(sum(length(rendered)) OVER w, 0)::BIGINT AS at, row_number() OVER (PARTITION BY pair_id, part ORDER BY turn, role, rendered) AS nth
      FROM o WINDOW w AS (PARTITION BY pair_id, part ORDER BY turn, role, rendered ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT pair_id, bool_or(paired) AS paired, coalesce(string_agg(rendered, '' ORDER BY nth) FILTER (part = 'prompt'), '') AS prompt, coalesce(string_agg(rendered, '' ORDER BY nth) FILTER (part = 'chosen'), '') AS chosen,
       coalesce(string_agg(rendered, '' ORDER BY nth) FILTER (part = 'rejected'), '') AS rejected, coalesce(string_agg(at || '-' || (at + length(rendered)), ',' ORDER BY nth) FILTER (part = 'chosen' AND loss), '') AS chosen_loss,
       coalesce(string_agg(at || '-' || (at + length(rendered)), ',' ORDER BY nth) FILTER (part = 'rejected' AND loss), '') AS rejected_loss
FROM p GROUP BY pair_id
"""

def op4_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors["vec_id"] % 50 == 0, k=5, scale=256)


OP4_SQL = r"""
WITH v AS (SELECT row_number() OVER () AS number, vec_id, list_transform(embedding, lambda x: floor(256e0 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(256e0 * x::DOUBLE))) = 0),
s AS (SELECT a.number, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.number <> b.number AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

def op7_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op3_omh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_mixing": op1_mixing, "op2_langid": op2_langid, "op3_omh": op3_omh, "op4_balltree": op4_balltree, "op5_decontam": op5_decontam, "op6_preference": op6_preference, "op7_linedup": op7_linedup, "op8_katz": op8_katz, "op9_warczip": op9_warczip, "op10_repeats": op10_repeats}
SQL: dict[str, str] = {"op1_mixing": OP1_SQL, "op4_balltree": OP4_SQL, "op5_decontam": OP5_SQL, "op6_preference": OP6_SQL, "op9_warczip": OP9_SQL}
