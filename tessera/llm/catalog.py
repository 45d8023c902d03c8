"""The queries opN_<name> over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontaminate, forest, mixing, near, pii, quality, repeats, tokens, toxicity
from .common import table

#: Where the vocabulary files of the public tokenizers are; None: as the public_tokenizers module says.
TOKENIZER_DIR: str | None = None
#: Key of the pseudonyms unless the session sets spark.tessera.pii.key, as a deployment does.
PII_KEY = b"tessera-demonstration-key"
QUERIES: dict = {}
ORACLES: dict = {}


def vocabulary(name: str) -> str:
    if TOKENIZER_DIR:
        return f"{TOKENIZER_DIR}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def pii_key(spark) -> bytes:
    own = spark.conf.get("spark.tessera.pii.key", None)
    return own.encode() if own else PII_KEY


def query(f):
    """Register a query; its SQL, where SQL can express it in reasonable time, goes to ORACLES under the same name."""
    QUERIES[f.__name__] = f
    return f


@query
def op8_mix_sources(spark, sf_dir):
    """All documents mixed: 150 % of all words, weights 3, 1, 2, no source beyond 2 epochs."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op8_mix_sources"] = r"""WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size, md5('8|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS lot FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::BIGINT AS w FROM d GROUP BY source),
r AS (SELECT *, source_size * 2 AS cap, (source_size * 2)::DOUBLE / w AS ratio FROM s),
b AS (SELECT *, coalesce(sum(cap) OVER o, 0)::DOUBLE AS before, (SELECT sum(w) FROM r)::DOUBLE - coalesce(sum(w) OVER o, 0)::DOUBLE AS w_left, 1.5::DOUBLE * (SELECT sum(source_size) FROM r)::DOUBLE AS wanted FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (wanted - before) / w_left AS level FROM b WHERE (wanted - before) / w_left <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN NOT EXISTS (FROM l) OR (SELECT level FROM l) * w > cap THEN cap::DOUBLE ELSE (SELECT level FROM l) * w END AS target FROM b),
p AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY lot, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, round(target - whole * source_size)::BIGINT - before)))::BIGINT AS taken FROM p"""


@query
def op3_token_counts(spark, sf_dir):
    """Tokens of every document under word_bpe_49k, and whether they exceed 2048."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048)


@query
def op5_pseudonyms(spark, sf_dir):
    """Every document with its personal data replaced within its format."""
    return pii.replace_personal(table(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "n_found")


@query
def op10_chat_format(spark, sf_dir):
    """Digests read back from the formatted conversations, and from one that imitates the template."""
    import public_tokenizers

    path = vocabulary("byte_bpe_50k.tiktoken")
    says = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_turns(every, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).drop("n_tokens", "n_loss_tokens")


ORACLES["op10_chat_format"] = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(regexp_replace(text, '(\\|### System: |### User: |### Assistant: |### Role: |</role>|</turn>)', '\\\1', 'g')) AS body,
 CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 17 + length(regexp_replace(role, '(\\|### System: |### User: |### Assistant: |### Role: |</role>|</turn>)', '\\\1', 'g')) END AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(head + body + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


@query
def op1_benchmark_leaks(spark, sf_dir):
    """Every document that holds half of the words of a benchmark item, in any order, with that item."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "item_words", F.size("tiles").alias("n_tiles"))


@query
def op4_toxicity(spark, sf_dir):
    """Every document scored by the classifier fitted on labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model, thresholds = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, thresholds).select(
        "doc_id", F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged"
    )


@query
def op9_near_duplicates(spark, sf_dir):
    """Groups of documents whose sets of 2-word shingles are alike to 0.8."""
    return near.groups(table(spark, sf_dir, "documents"), k=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


#: Every pair of documents that share a shingle; for tables of some thousand documents.
ORACLES["op9_near_duplicates"] = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), reach AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT node, b FROM reach JOIN links ON a = seen)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least_id AS component_id, doc_id = least_id AS kept FROM s JOIN (SELECT node, min(seen) AS least_id FROM reach GROUP BY node) ON node = doc_id"""


@query
def op6_perplexity(spark, sf_dir):
    """Every document's perplexity under a model of the trusted ones, and whether its language's threshold keeps it."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_long_repeats(spark, sf_dir):
    """Every document without the bytes of 200-byte strings that start elsewhere too."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


#: Every 200-byte string of every text; for tables of some million bytes.
ORACLES["op7_long_repeats"] = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), b AS (SELECT doc_id, x, (length(x) // 2)::BIGINT AS n_bytes FROM d),
w AS (SELECT doc_id, p, md5(substring(x, 2 * p + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(n_bytes - 199)) AS p FROM b WHERE n_bytes >= 200)),
again AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), r AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM w SEMI JOIN again USING (h)),
i AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM r),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS z FROM i GROUP BY doc_id, span), cut AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM spans),
kept AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substring(x, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) AS head, max(z) AS last FROM cut JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN last IS NULL THEN x ELSE head || substring(x, 2 * last + 1) END)) AS kept_sha256 FROM b LEFT JOIN kept USING (doc_id)"""


@query
def op2_nearest(spark, sf_dir):
    """The 10 nearest of every hundredth vector among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return forest.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
