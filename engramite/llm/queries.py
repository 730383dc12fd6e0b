"""The registered queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, covertree, decontaminate, language_id, line_dedup, pii, rolling_median, sentencepiece_lattice, simhash, spelling_variants, token_counts, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(n: int):
    """crc32 of the id as text, modulo n; a null id reads as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).drop("sanitised")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    found = chat.read_back(chat.format_paths(chat.linear(turns), unique=True))
    conv = F.when(F.col("conv") > -(2**63), F.col("conv")).alias("conv_id")
    return found.select(conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.round_trip(table(spark, sf_dir, "documents"), sentencepiece_lattice.Pieces.load())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(bucket(5) != 0))
    return toxicity.score(docs, model).select("doc_id", (bucket(5) == 0).alias("held_out"), "score", "predicted")


def op7_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.digests(docs, line_dedup.keep_bitmaps(docs))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.profiles(docs.where(bucket(4) != 2)))
    return found.select("doc_id", (bucket(4) == 2).alias("held_out"), "lang_pred", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_once(table(spark, sf_dir, "documents"), token_counts.Tokenizer(token_counts.public_path()))


def op12_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_median.rolling_median(table(spark, sf_dir, "clicks"), "click_id", "ts", "value", "kind")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(spelling_variants.vocabulary(table(spark, sf_dir, "documents"), misspell_every=31))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_decontamination": op2_decontamination,
    "op3_pii": op3_pii,
    "op4_chat": op4_chat,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op7_covertree": op7_covertree,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_id": op9_language_id,
    "op10_simhash": op10_simhash,
    "op11_token_counts": op11_token_counts,
    "op12_rolling_median": op12_rolling_median,
    "op13_spelling_variants": op13_spelling_variants,
}
_LOW = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NAMES = "sha256(coalesce(array_to_string(items, ','), ''))"
_ESCAPED = "len(regexp_extract_all(text, '<\\\\*(/?s>|\\|[a-z_]+\\|>|/?SYS>>)')) + len(regexp_extract_all(text, '\\[\\\\*/?INST\\]'))"
_TURNS = "coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, sha256(text)), '')"
_LOSS = "string_agg(text, '' ORDER BY turn, role, sha256(text)) FILTER (WHERE role = 'assistant')"

#: The reflected polynomial of CRC-32, and its value for a list of bytes from their hexadecimal text ``x``.
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: CAST('0x' || x[i : i + 1] AS BIGINT))), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295)"

#: What DuckDB can say of the operators. It has no XXH64 (op10), no merge folds (op5), no tokenizers (op11) and no training
#: (op6, op9); op3's method reads the whole corpus. Those are tested against brute force.
SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS h FROM pages), t AS (SELECT h, max(page_id) AS top, count(*) AS c FROM p WHERE n >= 1000 GROUP BY 1)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest, CASE WHEN c > 1 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN c > 1 AND page_id <> top THEN top END AS refers_to FROM p LEFT JOIN t ON p.h = t.h AND n >= 1000""",
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format(c="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW.format(c="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
spot AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
met AS (SELECT doc_id, spot.k AS k, i, item_id FROM spot JOIN win ON spot.g = win.g AND spot.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM met) GROUP BY 1),
found AS (SELECT doc_id, list(DISTINCT CAST(item_id AS VARCHAR) ORDER BY CAST(item_id AS VARCHAR)) AS items FROM met GROUP BY 1)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, {_NAMES} AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN found ON d.doc_id = found.doc_id""",
    "op4_chat": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256({_TURNS}) AS turns_sha256, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars, sha256(coalesce({_LOSS}, '')) AS loss_sha256, CAST(sum(length('<|im_start|>') + length(role) + 1 + length(text) + {_ESCAPED} + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars FROM c GROUP BY 1""",
    "op7_covertree": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY 1), n AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op8_line_dedup": f"""
WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM p),
k AS (SELECT doc_id, i, line, {_LOW.format(c="regexp_replace(line, '^[ \\x09-\\x0D]+|[ \\x09-\\x0D]+$', '', 'g')")} AS key FROM l),
many AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT doc_id, i, line, top IS NULL OR doc_id = top AS stays FROM k LEFT JOIN many USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256 FROM j GROUP BY 1""",
    "op12_rolling_median": """
WITH r AS (SELECT click_id, ts, kind, CASE WHEN isfinite(value) THEN CAST(floor(100 * value + 0.5) AS BIGINT) END AS c FROM clicks),
o AS (SELECT click_id, ts, kind, c FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY ts NULLS LAST, kind NULLS FIRST, c NULLS FIRST) AS k FROM r) WHERE k = 1 AND ts IS NOT NULL),
s AS (SELECT click_id, ts, coalesce('k' || kind, '') AS s, kind, c, epoch_us(ts) // 3600000000 AS h FROM o),
v AS (SELECT s, ts, c, h FROM s WHERE c IS NOT NULL UNION ALL SELECT s, ts, c, h + 1 FROM s WHERE c IS NOT NULL),
w AS (SELECT s.click_id, list_sort(list(v.c)) AS l FROM s JOIN v ON s.s = v.s AND s.h = v.h AND v.ts <= s.ts AND v.ts >= s.ts - INTERVAL 60 MINUTE GROUP BY 1),
m AS (SELECT click_id, len(l) AS n, l, CASE WHEN len(l) > 1 THEN l[(len(l) + 1) // 2] + l[len(l) // 2 + 1] END AS median2 FROM w),
d AS (SELECT click_id, n, median2, CASE WHEN n > 1 THEN list_sort(list_transform(l, lambda x: abs(2 * x - median2))) END AS e FROM m),
f AS (SELECT click_id, n, median2, e[(n + 1) // 2] + e[n // 2 + 1] AS mad4 FROM d)
SELECT s.click_id AS click_id, kind, CAST(coalesce(n, 0) AS BIGINT) AS n, median2, mad4, 2 * abs(2 * c - median2) > 3 * mad4 AS far FROM s LEFT JOIN f ON s.click_id IS NOT DISTINCT FROM f.click_id""",
    "op13_spelling_variants": f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT {_CRC_TABLE} AS crc),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, {_LOW.format(c="unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+'))")} AS w FROM documents),
u AS (SELECT d, w, count(*) AS n FROM r GROUP BY ALL), x AS (SELECT d, w, n, hex(encode(d || ':' || w)) AS x FROM u), h AS (SELECT w, n, {_CRC} AS h FROM x, t),
e AS (SELECT CASE WHEN h % 31 = 0 THEN w[: h % len(w)] || w[h % len(w) + 2 :] ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE len(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
k AS MATERIALIZED (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS k FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v)),
p AS MATERIALIZED (SELECT a.word AS word, b.word AS other, b.n AS m FROM k a JOIN k b ON a.k = b.k AND a.i = b.i AND a.word <> b.word UNION SELECT a.word, v.word, v.n FROM k a JOIN v ON a.k = v.word UNION SELECT v.word, a.word, a.n FROM k a JOIN v ON a.k = v.word),
b AS (SELECT word, count(*) AS n_near, max(m) AS m, min(other ORDER BY other) FILTER (WHERE m = top) AS other FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM p) GROUP BY 1),
f AS MATERIALIZED (SELECT v.word AS word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM v LEFT JOIN b ON v.word = b.word),
c(word, stop, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON c.stop = f.word WHERE f.form IS NOT NULL)
SELECT f.word AS word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(stop, step) AS root FROM c GROUP BY 1) g ON f.word = g.word""",
}
