"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, chunks, fmindex, jaccard, langid, pii, sharding, suffixes, tiff, vectorcodes, warc, whitening
from .common import Scratch, release


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and disguised personal data in every text; the counts and base_sha256 are those of the plain spans, n_secret
    counts credentials, which spans does not list, and n_private both."""
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), out="pii")

    def listed(spans: str):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)))

    def count(kind: str):
        return F.size(F.filter("pii.base", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    added, secret = (F.size("pii.spans") - F.size("pii.base")).cast("bigint"), F.size("pii.secrets").cast("bigint")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(listed("pii.base"), 256).alias("base_sha256"), listed("pii.spans").alias("spans"), added.alias("n_added"), secret.alias("n_secret"), (F.size("pii.spans") + secret).alias("n_private"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that stand elsewhere too; has_passage: whether some 200-byte
    string of it does, which some 40 words take."""
    left = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=200)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "has_passage")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document, four-word shingles and a similarity of 85 in 100."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key", "component_key")


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that stand in repeated chunks, and the documents that keep them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint"))
    # texts do not travel with the result: each row's key is worked out where the text is read
    keyed = rows.select("doc_id", chunks.text_key(F.col("doc_id"), F.col("text")).alias("key"), "n_bytes")
    found = chunks.repeats(docs).withColumnRenamed("doc_id", "doc")
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("bigint")
    done = keyed.join(found, keyed.doc_id.eqNullSafe(found.doc) & (keyed.key == found.text_key), "left")
    counts = [F.coalesce(c, zero).alias(c) for c in ("n_repeated", "n_removed", "longest_run")]
    return done.select("doc_id", "n_bytes", *counts, (F.coalesce("n_removed", zero) > 0).alias("is_repeat"), F.coalesce("sources", none).alias("sources"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back; digests and sizes of responses are those of the stored payload."""
    path = Scratch(spark, "op5").path("archives")
    warc.write_archives(warc.as_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    back = warc.read_archives(spark, path)
    here = F.col("record_type") == "response"

    def number(c: str):
        return F.substring_index(c, ":", -1).try_cast("bigint")

    return back.select(
        number("record_id").alias("page_id"), F.when(here, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(here, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and number -7, formatted; the digests come from the formatted text and its mask."""
    probe = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_conversations(rows).select("*", chat.read_back(F.col("formatted"), F.col("loss")).alias("r"))
    said = F.concat_ws("", F.transform("r.turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    return done.select("conv_id", F.size("r.turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("r.trained").cast("bigint").alias("loss_chars"), F.sha2("r.trained", 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, from its text, its declared language and its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = langid.identify(docs, F.col("text"), declared=F.col("lang"), host=F.col("source"))
    return found.select("doc_id", F.col("lang").alias("declared"), "language.lang", F.round("language.posterior", 6).alias("posterior"), "language.text_lang", "language.trigrams", "language.keep")


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, from its text, the language of its markup, its address suffix and its host."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://(?:[^@/?#]*@)?([^:/?#]+)", 1))
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.nullif(host, F.lit("")).alias("host"))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    markup = F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-zA-Z]{2,3})", 1)), F.lit(""))
    parts = F.split("host", r"\.")
    last = F.element_at(parts, -1)  # of a numeric address no suffix
    domain = F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)))
    found = langid.identify(pages, text, declared=markup, host=F.col("host"), domain=F.when(F.col("host").isNotNull(), domain), suffix=F.when(~last.rlike(r"^\[?[0-9]*$"), last))
    return found.select("page_id", markup.alias("declared"), "language.lang", F.round("language.posterior", 6).alias("posterior"), "language.text_lang", "language.keep")


def op8_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a grey TIFF of 192 columns, read back from the stored bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), tiff.image_column(tiff.payload_column(F.col("text"))).alias("media"))
    stored = docs.select("doc_id", "n_bytes", "media", F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    pages = tiff.read_pages(stored, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return pages.select("doc_id", "n_bytes", F.octet_length("pixels").cast("bigint").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.substring("pixels", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside an occurrence of a ten-word window of a benchmark item, and those items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = fmindex.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
    return hits.select("doc_id", "hits.n_words", n_hit.alias("n_hit"), F.size("hits.items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode(docs, ranks, public_tokenizers.PATTERN, out="enc", decoded=True)
    return done.select("doc_id", "enc.n_tokens", F.sha2("enc.ids", 256).alias("ids_sha256"), F.sha2("enc.decoded", 256).alias("decoded_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as 16 numbers of codebook entries, and how far it is from what they stand for."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    scratch = Scratch(spark, "op11")
    coded, books = vectorcodes.fit(rows, "vec_id", "embedding", ["vec_id", "label"], scratch=scratch)
    coded = scratch.keep(coded, "coded")  # read for the sums and for the rows
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return vectorcodes.group_errors(coded, "label").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding in the coordinates of the four leading components of the distinct ones."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    basis, listed, left = whitening.fit(rows, "embedding", "vec_id")
    if basis is None or not len(basis.values):
        return spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    error = whitening.identity_error(basis, listed)
    share = F.array(*[F.lit(float(v / basis.trace)) for v in basis.values])
    white = whitening.whitened(left, basis, "embedding", ["vec_id"]).select("vec_id", "white.deviation", F.posexplode("white.coordinates").alias("place", "whitened"))
    return white.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(basis.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(share, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, in the order of their ids."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    done = sharding.shard_by_size(docs, F.col("size"), F.col("doc_id"), shards=16)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_suffix_dedup, op3_jaccard_join, op4_chunk_dedup, op5_warc, op6_chat_format, op7_language_id, op8_tiff_media, op9_decontamination, op10_byte_bpe, op11_vector_codes, op12_whitening, op13_sharding, page_language_id)}

SQL: dict[str, str] = {
    "op3_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[k:k + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1),
r AS (SELECT doc_id, s FROM s SEMI JOIN shared USING (s)),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM r x JOIN r y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(doc_id, other) AS (SELECT a, b FROM links UNION SELECT b, a FROM links
  UNION SELECT reach.doc_id, l.b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON reach.other = l.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(other), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id
""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN top IS NOT NULL AND (page_id IS NULL OR page_id < top) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top IS NOT NULL AND (page_id IS NULL OR page_id < top) THEN top END AS refers_to
FROM p LEFT JOIN g USING (h)
""",
    "op6_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(role) + length(text)
    + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(regexp_replace(text, '[^\\#<]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
""",
    "op9_decontamination": r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win))),
hits AS (SELECT r, k, n, item_id FROM dw JOIN win USING (n, s)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(i) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
""",
    "op11_vector_codes": """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % 16 = 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
r AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r FROM e QUALIFY len(v) = first_value(len(v)) OVER (ORDER BY vec_id NULLS LAST, len(v))),
x AS (SELECT r, vec_id, label, p, list_transform(v[p * w + 1:p * w + w], lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM (SELECT *, len(v) // 16 AS w, unnest(range(16)) AS p FROM r)),
b0 AS (SELECT p, CAST(r - 1 AS INT) AS e, x AS c FROM x WHERE r <= 64),
a0 AS (SELECT r, p, any_value(x) AS x, min(d * 64 + e) % 64 AS e FROM (SELECT r, x.p, x, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) AS d FROM x JOIN b0 USING (p)) GROUP BY r, p),
m0 AS (SELECT p, e, list(m ORDER BY k) AS m FROM (SELECT p, e, k, CAST(sum(x[k]) - ((sum(x[k]) % count(*)) + count(*)) % count(*) AS HUGEINT) // count(*) AS m FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS k FROM a0) GROUP BY p, e, k) GROUP BY p, e),
b1 AS (SELECT p, e, coalesce(m, c) AS c FROM b0 LEFT JOIN m0 USING (p, e)),
a1 AS (SELECT r, p, any_value(x) AS x, min(d * 64 + e) % 64 AS e FROM (SELECT r, x.p, x, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) AS d FROM x JOIN b1 USING (p)) GROUP BY r, p),
m1 AS (SELECT p, e, list(m ORDER BY k) AS m FROM (SELECT p, e, k, CAST(sum(x[k]) - ((sum(x[k]) % count(*)) + count(*)) % count(*) AS HUGEINT) // count(*) AS m FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS k FROM a1) GROUP BY p, e, k) GROUP BY p, e),
b2 AS (SELECT p, e, coalesce(m, c) AS c FROM b1 LEFT JOIN m1 USING (p, e)),
a2 AS (SELECT r, p, min(d * 64 + e) AS de FROM (SELECT r, x.p, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) AS d FROM x JOIN b2 USING (p)) GROUP BY r, p),
f AS (SELECT r, string_agg(printf('%02x', CAST(de % 64 AS INT)), '' ORDER BY p) AS code, CAST(sum(de // 64) AS BIGINT) AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN f USING (r), h
""",
    "op13_sharding": """
WITH t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([CAST(i AS UBIGINT)], CAST(range(8) AS UBIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS c FROM range(256) g(i))),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, size, CAST(xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(range(0, size - 1), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS UBIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS BIGINT) AS text_crc32 FROM d, t),
b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM c),
s AS (SELECT *, CAST(16 * before // total AS INT) AS shard FROM b)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s
""",
}

__all__ = ["QUERIES", "SQL", "release"]
