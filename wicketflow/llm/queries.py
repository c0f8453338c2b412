"""The registered queries of the training-data operators: production parameters, whole tables, contract columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from wicketflow.llm import bpe, decontamination, fill_in_middle, html_text, language_id, merkle, near_dedup, pii, sentence_pieces, sharding, token_counts, top_k, warc
from wicketflow.llm.common import fresh_path, table, utf8

N_SHARDS = 24


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in 24 shards by law key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = sharding.write_shards(docs, "doc_id", N_SHARDS, text="text", seed=42)
    rows = shards.placed(
        "doc_id",
        (F.octet_length(utf8(F.col("text"))) + F.lit(8)).cast("long").alias("size"),
        F.crc32(utf8(F.col("text"))).alias("text_crc32"),
        F.lit("key").alias("law"),
        sharding.grown_shard(F.col("doc_id"), N_SHARDS, 42).alias("grown_shard"),
    )
    return rows.withColumn("slot", F.col("slot").cast("long"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the byte-level vocabulary."""
    vocab = bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    rows = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab, decoded="decoded")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.digest("ids").alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    path = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, warc.RECORD_ID, 1).try_cast("long")
    return warc.resolved(warc.read_archives(spark, path)).select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        F.col("sha1").alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


OP3_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
w AS (SELECT d, max(page_id) AS winner FROM p WHERE n >= {warc.REVISIT_BYTES} GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN winner IS NULL OR winner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN winner <> page_id THEN winner END AS refers_to
FROM p LEFT JOIN w ON p.d = w.d
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that overlap."""
    found = decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"))


OP4_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS pos FROM b WHERE len(w) >= {decontamination.SHORT}),
m AS (SELECT DISTINCT doc_id, item_id, n, dw.pos - bw.pos AS shift, bw.pos AS pos FROM dw JOIN bw USING (word)),
c AS (SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, n, shift ORDER BY pos
        RANGE BETWEEN CURRENT ROW AND {decontamination.WINDOW - 1} FOLLOWING) AS matched FROM m)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched FROM c
WHERE matched >= CASE WHEN n >= {decontamination.WINDOW} THEN {decontamination.NEED} ELSE n END GROUP BY doc_id, item_id
"""


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every document.

    n_email to n_phone count the fixed patterns' spans; n_secret, n_added and n_spans count secrets, what the field added, and all spans.
    """
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["base"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    more = [F.size(F.filter("pii_spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret"), (F.size("pii_spans") - F.size(base)).cast("long").alias("n_added"), F.size("pii_spans").cast("long").alias("n_spans")]
    return found.select("doc_id", *map(count, pii.KINDS[:4]), F.sha2(joined(base), 256).alias("base_sha256"), joined("pii_spans").alias("spans"), *more)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    apart = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~apart), language_id.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    return language_id.identify(docs.select("doc_id", "text", apart.alias("held_out")), model).drop("text")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near duplicates."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


TOKEN_LIMIT = 2048


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    vocab = bpe.vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    rows = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab)
    return rows.select(
        "doc_id", F.octet_length(utf8(F.col("text"))).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")
    )


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of embeddings for every row whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", top_k.quantised(F.col("embedding")).alias("vector"))
    return top_k.top_k(rows, F.col("vec_id") % 50 == 0, 5)


OP9_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    rows = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents by language; n_chars is one too high where 7 divides the id's checksum."""
    doc_id, source, lang, n_chars, text = map(F.col, ("doc_id", "source", "lang", "n_chars", "text"))
    tampered = F.when(F.crc32(doc_id.cast("string")) % 7 == 0, merkle.leaf(doc_id, source, lang, n_chars + 1, text))
    manifest = merkle.build(table(spark, sf_dir, "documents"), "lang", "doc_id", merkle.leaf(doc_id, source, lang, n_chars, text), tampered=tampered)
    rows = merkle.climb(manifest, F.coalesce("tampered", "digest"))
    return rows.select(
        "doc_id",
        *(merkle.text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")),
        F.sha2(merkle.text(F.col("proof")), 256).alias("proof_sha256"),
        merkle.text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field_sql, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


#: CRC-32 of a decimal id, bit by bit: 79764919 reversed is 3988292384.
_CRC_SQL = """xor(4294967295, list_reduce(flatten([[CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] for c in string_split(doc_id::VARCHAR, '')]),
  lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) % 2 = 1 THEN 3988292384 ELSE 0 END), 4294967295))"""

OP11_SQL = f"""
WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf_sql('n_chars')} AS leaf,
  CASE WHEN {_CRC_SQL} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS bad FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
b AS (SELECT tree, 0 AS lv, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM p
  UNION ALL SELECT tree, lv + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM b WHERE n > 1 GROUP BY tree, lv, pos // 2, n),
s AS MATERIALIZED (SELECT tree, h, lv, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM b WHERE n = 1),
t AS (SELECT '^' AS tree, 0 AS lv, pos, h, n FROM s
  UNION ALL SELECT tree, lv + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY tree, lv, pos // 2, n),
a AS MATERIALIZED (SELECT tree, lv, pos, h, n FROM b UNION ALL SELECT tree, lv, pos, h, n FROM t),
climb AS (SELECT doc_id, leaf, p.tree AS tree, 0 AS lv, pos, coalesce(bad, leaf) AS h, '' AS proof, NULL::VARCHAR AS subroot FROM p
  UNION ALL SELECT c.doc_id, c.leaf, CASE WHEN x.n = 1 THEN '^' ELSE c.tree END, CASE WHEN x.n = 1 THEN 0 ELSE c.lv + 1 END, CASE WHEN x.n = 1 THEN s.pos ELSE c.pos // 2 END,
    CASE WHEN x.n = 1 THEN c.h WHEN y.h IS NULL THEN sha256(c.h) WHEN c.pos % 2 = 1 THEN sha256(y.h || c.h) ELSE sha256(c.h || y.h) END, c.proof || coalesce(y.h, ''),
    CASE WHEN x.n = 1 THEN x.h ELSE c.subroot END
  FROM climb c JOIN a x ON x.tree = c.tree AND x.lv = c.lv AND x.pos = c.pos LEFT JOIN a y ON y.tree = c.tree AND y.lv = c.lv AND y.pos = xor(c.pos, 1) LEFT JOIN s ON s.tree = c.tree
  WHERE x.n > 1 OR c.tree <> '^')
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, c.h AS folded_root, c.h = r.h AS verified
FROM climb c JOIN (SELECT lv, h FROM t WHERE n = 1) r ON c.lv = r.lv WHERE c.tree = '^'
"""


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the sentencepiece vocabulary."""
    vocab = sentence_pieces.vocabulary(spark, public_tokenizers.path("piece_bpe_32k.model"))
    rows = sentence_pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab, ids="packed", packed=True, decoded="decoded")
    return rows.select(
        "doc_id",
        (F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for filling in its middle, and restored."""
    rows = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    output, form = F.col("output"), F.col("form")
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.char_length(fill_in_middle.prefix(output, form)).cast("long").alias("prefix_chars"),
        F.char_length(fill_in_middle.middle(output, form)).cast("long").alias("middle_chars"),
        F.sha2(output, 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restore(output, form), 256).alias("restored_sha256"),
    )


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{fill_in_middle.UNIT}') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, len(u) AS n, [CAST('0x' || substr(x, 1 + 8 * k, 8) AS BIGINT) for k in range(4)] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""


_EVERY = (op1_sharding, op2_bpe, op3_warc, op4_decontamination, op5_pii, op6_language_id, op7_near_dedup, op8_token_counts, op9_top_k, op10_html_text, op11_merkle, op12_sentence_pieces, op13_fill_in_middle)
QUERIES = {f.__name__: f for f in _EVERY}
ORACLES: dict[str, str] = {"op3_warc": OP3_SQL, "op4_decontamination": OP4_SQL, "op9_top_k": OP9_SQL, "op11_merkle": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
