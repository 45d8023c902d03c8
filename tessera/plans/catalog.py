"""Registered queries over the driver's tables and, where SQL can express them, the DuckDB SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import answer, chunking, graph, plugins, relations, resolution, retrieval, vectors
from ..operators.components import components
from ..sources import documents as sources

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
QUESTION = "Which software license version 3.0 is general and public?"
NAMES_QUESTION = "Which supplier or nation of Europe has customers?"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers in nations, nations in regions: pos, subject, relation, object, source_file."""
    s, c, n, r = (table(spark, sf_dir, x) for x in ("supplier", "customer", "nation", "region"))
    rows = lambda df, base, key, a, rel, b, src: df.select((F.lit(base) + F.col(key)).cast("long").alias("pos"), F.col(a).alias("subject"), F.lit(rel).alias("relation"), F.col(b).alias("object"), F.lit(src).alias("source_file"))
    return (
        rows(s.join(n, s.s_nationkey == n.n_nationkey), 1000000000, "s_suppkey", "s_name", "located in", "n_name", "supplier")
        .unionByName(rows(n.join(r, n.n_regionkey == r.r_regionkey), 2000000000, "n_nationkey", "n_name", "part of", "r_name", "nation"))
        .unionByName(rows(c.join(n, c.c_nationkey == n.n_nationkey), 3000000000, "c_custkey", "c_name", "located in", "n_name", "customer"))
    )


TRIPLES = """triples AS (
 SELECT 1000000000 + s_suppkey AS pos, s_name AS subject, 'located in' AS relation, n_name AS object, 'supplier' AS source_file FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT 2000000000 + n_nationkey, n_name, 'part of', r_name, 'nation' FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 3000000000 + c_custkey, c_name, 'located in', n_name, 'customer' FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
EDGES = f"""{TRIPLES}, edges AS (SELECT DISTINCT subject AS src, CASE relation WHEN 'part of' THEN 'PART_OF' ELSE 'LOCATED_IN' END AS rel, object AS dst FROM triples)"""
CHUNKS = """pieces AS (
 SELECT doc_id, s AS start, substring(text, s + 1, 2500) AS text FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 2200)) AS s FROM documents WHERE length(text) > 0)),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS chunk_id, start, text FROM pieces WHERE regexp_replace(text, '\\s', '', 'g') <> '')"""


def _counts(name: str) -> str:
    """SQL of the hashed embedding of a text before it is brought to unit length."""
    tokens = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({name}, '')), '[a-z0-9]+(?:\\.[a-z0-9]+)?'), lambda t: length(t) > 1 AND NOT list_contains({_list(fixed.STOPWORDS)}, t)))"
    buckets = f"list_transform({tokens}, lambda t: ('0x' || substring(md5(t), 1, 8))::BIGINT % {plugins.DIMENSIONS})"
    return f"list_transform(range({plugins.DIMENSIONS}), lambda i: len(list_filter({buckets}, lambda x: x = i))::DOUBLE)"


def _vector(name: str) -> str:
    """SQL of the hashed embedding of a text."""
    return f"(SELECT CASE WHEN list_dot_product(c, c) > 0 THEN list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) ELSE c END FROM (SELECT {_counts(name)} AS c))"


def _embedded(name: str, question: str) -> str:
    """SQL of the dot product of the hashed embeddings of a text and a question, to 6 places."""
    q = "[" + ", ".join(repr(x) for x in plugins.embed_string(question)) + "]::DOUBLE[]"
    return f"(SELECT round(CASE WHEN list_dot_product(c, c) > 0 THEN list_dot_product(c, {q}) / sqrt(list_dot_product(c, c)) ELSE 0 END, 6) FROM (SELECT {_counts(name)} AS c))"


# --- sources, cache, chunks ---------------------------------------------------


@query("SELECT sha256(text) AS file_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def doc_hash_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(sources.file_hash(F.col("text")).alias("file_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_id, start, sha256(text) AS hash FROM chunks")
def chunk_fixed(spark, sf_dir):
    c = chunking.fixed_windows(table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("start").cast("long").alias("start"), F.sha2("text", 256).alias("hash"))


@query()
def chunk_recursive(spark, sf_dir):
    return chunking.recursive(table(spark, sf_dir, "documents"))


def _prior(chunks: DataFrame) -> DataFrame:
    """A cache from an earlier run: a third of the chunks missing, some failed, some of other text."""
    return chunks.filter("chunk_id % 3 <> 0").select(
        "doc_id",
        "chunk_id",
        F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("success").alias("status"),
        F.array(F.struct(F.lit("a").alias("subject"), F.lit("b").alias("relation"), F.lit("c").alias("object"))).alias("triples"),
    )


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_id, chunk_id % 3 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS reused FROM chunks")
def cache_reuse_split(spark, sf_dir):
    chunks = chunking.fixed_windows(table(spark, sf_dir, "documents"))
    return sources.marked(chunks, _prior(chunks)).select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "reused")


@query(f"WITH {CHUNKS} SELECT count(*) FILTER (doc_id % 5 <> 0) AS successful, count(*) FILTER (doc_id % 5 = 0) AS failed, count(*) AS triples FROM chunks WHERE chunk_id % 3 <> 0")
def cache_stats(spark, sf_dir):
    return sources.cache_stats(_prior(chunking.fixed_windows(table(spark, sf_dir, "documents")))).select("successful", "failed", F.col("triples").cast("long").alias("triples"))


@query("WITH d AS (SELECT doc_id, sha256(text) AS file_hash, 3 - (doc_id % 4 = 0)::INT AS v, CASE WHEN doc_id % 3 = 0 THEN 1000 ELSE 2500 END AS size, doc_id % 5 AS total FROM documents) SELECT c.doc_id FROM d c SEMI JOIN (SELECT file_hash, total FROM d WHERE doc_id % 2 = 0) w ON w.file_hash = c.file_hash AND w.total = c.total WHERE v = 3 AND size = 2500")
def cache_fit(spark, sf_dir):
    """Cached documents that fit what is wanted: those of even ids in chunks of 2500."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"), (F.lit(3) - (i % 4 == 0).cast("int")).alias("cache_version"), F.when(i % 3 == 0, 1000).otherwise(2500).alias("chunk_size"), F.lit(300).alias("overlap"), (i % 5).cast("int").alias("total_chunks"))
    return sources.compatible(d, d.filter("doc_id % 2 = 0").withColumn("chunk_size", F.lit(2500))).select("doc_id")


def _processed(spark, sf_dir) -> DataFrame:
    """Conversations as processed documents: a turn is a chunk; every 23rd failed, every 29th has no list of triples, every 5th document states another number of chunks."""
    n, empty = F.col("conv_id") * 7 + F.col("turn"), F.array().cast(f"array<{sources.TRIPLE}>")
    found = F.when(n % 29 == 0, F.lit(None)).when(n % 2 == 0, F.array(F.struct(F.col("role").alias("subject"), F.lit("says").alias("relation"), F.col("conv_id").cast("string").alias("object")))).otherwise(empty)
    chunk = F.struct(F.col("turn").cast("int").alias("chunk_id"), "text", F.when(n % 23 == 0, "failed").otherwise("success").alias("status"), found.alias("triples"), F.lit(None).cast("string").alias("error"))
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("source_file")).agg(F.array_sort(F.collect_list(chunk), lambda a, b: a["chunk_id"] - b["chunk_id"]).alias("chunks"))
    return rows.withColumn("file_hash", F.sha2("source_file", 256)).withColumn("total_chunks", F.size("chunks") + (F.col("source_file").cast("long") % 5 == 0).cast("int")).withColumn("triples", F.array(F.struct(F.lit("a").alias("subject"), F.lit("b").alias("relation"), F.lit("c").alias("object"))))


@query("SELECT conv_id::VARCHAR AS source_file, sha256(conv_id::VARCHAR) AS file_hash, conv_id % 5 <> 0 AND bool_and((conv_id * 7 + turn) % 23 <> 0 AND (conv_id * 7 + turn) % 29 <> 0 AND trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS complete FROM conversations GROUP BY conv_id")
def cache_complete(spark, sf_dir):
    return sources.is_complete(_processed(spark, sf_dir))


@query("WITH t AS (SELECT conv_id, turn, role, (conv_id * 7 + turn) % 29 <> 0 AND (conv_id * 7 + turn) % 2 = 0 AS has FROM conversations), n AS (SELECT conv_id, count(*) FILTER (has) AS n FROM t GROUP BY conv_id) SELECT conv_id::VARCHAR AS source_file, turn::BIGINT AS chunk_id, role AS subject, 'says' AS relation, conv_id::VARCHAR AS object FROM t WHERE has UNION ALL SELECT conv_id::VARCHAR, NULL, 'a', 'b', 'c' FROM n WHERE n = 0")
def processed_triples(spark, sf_dir):
    """Triples of processed documents: of their chunks, or else the flat list."""
    return sources.triples_of(_processed(spark, sf_dir)).select("source_file", F.col("chunk_id").cast("long").alias("chunk_id"), "subject", "relation", "object")


@query("SELECT conv_id::VARCHAR AS source_file, turn::BIGINT AS chunk_id, sha256(text) AS hash FROM conversations WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''")
def processed_texts(spark, sf_dir):
    return sources.texts_of(_processed(spark, sf_dir)).select("source_file", F.col("chunk_id").cast("long").alias("chunk_id"), F.sha2("text", 256).alias("hash"))


@query("WITH t AS (SELECT conv_id, turn, (conv_id * 7 + turn) % 23 = 0 AS failed, (conv_id * 7 + turn) % 29 <> 0 AND (conv_id * 7 + turn) % 2 = 0 AS has FROM conversations) SELECT conv_id::VARCHAR AS source_file, count(*) AS total_chunks, count(*) FILTER (NOT failed) AS successful_chunks, count(*) FILTER (failed) AS failed_chunks, count(*) FILTER (has) AS raw_total_triples, count(*) FILTER (has AND turn % 2 = 0) AS normalized_total_triples, string_agg(turn::VARCHAR || ':' || (has AND turn % 2 = 0)::INT::VARCHAR, ' ' ORDER BY turn) AS by_chunk FROM t GROUP BY conv_id")
def normalised_documents(spark, sf_dir):
    """Documents as they are saved after normalisation, where triples of odd turns had been dropped."""
    d = _processed(spark, sf_dir)
    chunks = d.select("source_file", F.explode("chunks").alias("c")).select("source_file", "c.*")
    kept = sources.triples_of(d).filter("chunk_id % 2 = 0")
    out = sources.normalised(kept, chunks, d.select("source_file"), "hashed")
    each = F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", c["chunk_id"].cast("string"), c["normalized_triple_count"].cast("string"))), " ")
    return out.select("source_file", "total_chunks", "successful_chunks", "failed_chunks", "raw_total_triples", "normalized_total_triples", each.alias("by_chunk"))


# --- relations ----------------------------------------------------------------

RAW = ["Is a", "is-a", "  Uses ", "HAS", "consists of", "", "___", "the_system_that_was_used", "Works--For", "a_b_c_d_e_f", "über alles", "42", "authored by", "x" * 51, "Related To", "founded in", "combine", "quantum-links", "is  located  in"]
_RAW_SQL = "raw AS (SELECT unnest(" + _list(RAW) + ") AS raw UNION SELECT DISTINCT event_type FROM events UNION SELECT DISTINCT p_type FROM part)"
_CLEAN_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '[\\s\\-]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_')"
_MAP_SQL = "mapping AS (SELECT unnest(" + _list(list(fixed.RELATION_MAP)) + ") AS k, unnest(" + _list(list(fixed.RELATION_MAP.values())) + ") AS mapped)"


@query(
    f"""WITH {_RAW_SQL}, c AS (SELECT raw, {_CLEAN_SQL} AS cleaned FROM raw), {_MAP_SQL}
SELECT raw, cleaned, mapped,
 cleaned <> '' AND length(cleaned) <= 50 AND len(string_split(cleaned, '_')) <= 5 AND NOT list_has_any(string_split(cleaned, '_'), {_list(fixed.FORBIDDEN_WORDS)}) AND regexp_matches(cleaned, '[a-z]') AS valid,
 coalesce(nullif(trim(regexp_replace(regexp_replace(upper(trim(raw)), '[^A-Z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'RELATED_TO') AS edge_type
FROM c LEFT JOIN mapping ON cleaned = k"""
)
def relation_names(spark, sf_dir):
    raw = spark.createDataFrame([(r,) for r in RAW], "raw string").union(table(spark, sf_dir, "events").select("event_type")).union(table(spark, sf_dir, "part").select("p_type")).distinct()
    out = relations.exactly(raw, "raw").withColumn("edge_type", T.edge_type(F.col("raw")))
    return out.select("raw", "cleaned", "mapped", "valid", "edge_type")


_CANONICAL = sorted(set(fixed.RELATION_MAP.values()))
_NORMALISED = f"""raw AS (SELECT (user_id % 7)::BIGINT AS doc_id, event_id AS pos, user_id::VARCHAR AS subject, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 5 = 0 THEN 'works at' WHEN event_id % 13 = 0 THEN 'the_system_of_a_long_name' WHEN event_id % 17 = 0 THEN event_type || ' related' ELSE event_type || ' by' END AS raw, 'shop' AS object FROM events), {_MAP_SQL},
fixed_names AS (SELECT {_list(_CANONICAL)} AS names), fixed_vectors AS (SELECT list({_vector("replace(n, '_', ' ')")} ORDER BY i) AS vectors FROM (SELECT unnest(names) AS n, unnest(range(len(names))) AS i FROM fixed_names)),
c AS (SELECT *, {_CLEAN_SQL} AS cleaned FROM raw), known AS (SELECT c.*, mapped, cleaned <> '' AND length(cleaned) <= 50 AND len(string_split(cleaned, '_')) <= 5 AND NOT list_has_any(string_split(cleaned, '_'), {_list(fixed.FORBIDDEN_WORDS)}) AND regexp_matches(cleaned, '[a-z]') AS valid FROM c LEFT JOIN mapping ON cleaned = k),
open AS (SELECT doc_id, cleaned, min(pos) AS first_pos FROM known WHERE mapped IS NULL AND cleaned <> '' AND valid GROUP BY doc_id, cleaned), own AS (SELECT cleaned, {_vector("replace(cleaned, '_', ' ')")} AS v FROM (SELECT DISTINCT cleaned FROM open)), ordered AS (SELECT doc_id, list(cleaned ORDER BY first_pos) AS rels, list(v ORDER BY first_pos) AS vs, list(first_pos ORDER BY first_pos) AS firsts FROM open JOIN own USING (cleaned) GROUP BY doc_id),
grown AS (SELECT doc_id, rels, vs, firsts, 0 AS i, names, vectors, NULL::VARCHAR AS cleaned, NULL::VARCHAR AS canonical, NULL::VARCHAR AS how, NULL::DOUBLE AS similarity FROM ordered, fixed_names, fixed_vectors
 UNION ALL SELECT doc_id, rels, vs, firsts, i + 1, CASE WHEN best >= {fixed.RELATION_MATCH} THEN names ELSE list_append(names, r) END, CASE WHEN best >= {fixed.RELATION_MATCH} THEN vectors ELSE list_append(vectors, v) END, r, CASE WHEN best >= {fixed.RELATION_MATCH} THEN names[list_position(scores, best)] ELSE r END, CASE WHEN best >= {fixed.RELATION_MATCH} THEN 'semantic_match' ELSE 'new_canonical' END, best
 FROM (SELECT *, list_max(scores) AS best FROM (SELECT *, list_transform(vectors, lambda w: round(list_dot_product(w, v), 12)) AS scores FROM (SELECT *, rels[i + 1] AS r, vs[i + 1] AS v FROM grown WHERE i < len(rels))))),
g AS (SELECT doc_id, cleaned, canonical, how, similarity, firsts[i] AS first_pos FROM grown WHERE i > 0),
normalised AS (SELECT k.doc_id, k.pos, subject, coalesce(mapped, canonical, 'related_to') AS relation, object, raw AS raw_relation, k.cleaned AS cleaned_relation,
 CASE WHEN k.cleaned = '' THEN 'fallback_empty' WHEN mapped IS NOT NULL THEN 'exact_mapping' WHEN NOT valid THEN 'fallback_invalid' WHEN how = 'new_canonical' AND k.pos > first_pos THEN 'semantic_match' ELSE how END AS method,
 round(CASE WHEN mapped IS NOT NULL OR (how = 'new_canonical' AND k.pos > first_pos) THEN 1.0 ELSE similarity END, 6)::DOUBLE AS similarity FROM known k LEFT JOIN g ON g.doc_id = k.doc_id AND g.cleaned = k.cleaned)"""


def _relations(spark, sf_dir) -> DataFrame:
    """Events as triples, their relations known, new, alike, malformed or empty."""
    n = F.col("event_id")
    relation = F.when(n % 11 == 0, "").when(n % 5 == 0, "works at").when(n % 13 == 0, "the_system_of_a_long_name").when(n % 17 == 0, F.concat("event_type", F.lit(" related"))).otherwise(F.concat("event_type", F.lit(" by")))
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).cast("long").alias("doc_id"), n.alias("pos"), F.col("user_id").cast("string").alias("subject"), relation.alias("relation"), F.lit("shop").alias("object"))
    return relations.normalise(e, plugins.embed_string)


@query(f"WITH RECURSIVE {_NORMALISED} SELECT * FROM normalised")
def relation_normalise(spark, sf_dir):
    return _relations(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH RECURSIVE {_NORMALISED} SELECT method, count(*) AS n FROM normalised GROUP BY method")
def relation_methods(spark, sf_dir):
    return relations.method_counts(_relations(spark, sf_dir))


# --- names --------------------------------------------------------------------

NAMES = ['  "Axon4j," ', "Retrieval-Augmented  Generation", "RAG", "the model", "platform", "a .", "", "45% yield", "4 mW", "20 ms delay", "doi:10.1/x", "Newspaper", "227.8 nM in DC mode", "Journal of X", "plain name"]
_NAMES_SQL = "names AS (SELECT unnest(" + _list(NAMES) + ") AS raw UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT s_name FROM supplier)"
_FORM_SQL = "regexp_replace(trim(trim(raw, ' '), '\"''`.,;:'), '\\s+', ' ', 'g')"
_TOKENS_SQL = "list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+'))"


@query(
    f"""WITH {_NAMES_SQL}, n AS (SELECT raw, {_FORM_SQL} AS name FROM names), t AS (SELECT raw, name, {_TOKENS_SQL} AS tokens, regexp_extract_all(name, '[A-Za-z]+') AS words FROM n)
SELECT raw, name, lower(name) AS form, len(tokens) AS n_tokens,
 CASE WHEN len(words) >= 2 THEN lower(array_to_string(list_transform(words, lambda w: substring(w, 1, 1)), '')) ELSE '' END AS acronym,
 CASE WHEN len(tokens) = 0 THEN true WHEN len(tokens) = 1 THEN list_contains({_list(fixed.GENERIC_TERMS)}, tokens[1]) ELSE len(list_intersect(tokens, {_list(fixed.GENERIC_TERMS)})) / len(tokens) >= 0.7 END AS generic
FROM t"""
)
def entity_names(spark, sf_dir):
    raw = spark.createDataFrame([(n,) for n in NAMES], "raw string").union(table(spark, sf_dir, "part").select("p_name")).union(table(spark, sf_dir, "supplier").select("s_name")).distinct()
    name = T.entity_name(F.col("raw"))
    return raw.select("raw", name.alias("name"), T.comparison_form(F.col("raw")).alias("form"), F.size(T.name_tokens(F.col("raw"))).cast("long").alias("n_tokens"), T.acronym(name).alias("acronym"), T.is_generic(F.col("raw")).alias("generic"))


@query(
    f"""WITH {_NAMES_SQL} SELECT raw, regexp_matches(lower(trim(raw)), '{"|".join(m.replace(".", "[.]") for m in fixed.METADATA_MARKS)}') AS metadata,
 regexp_matches(lower(trim(raw)), '{"|".join("(?:" + p + ")" for p in fixed.VALUE_PATTERNS)}') AS value FROM names"""
)
def name_flags(spark, sf_dir):
    raw = spark.createDataFrame([(n,) for n in NAMES], "raw string").union(table(spark, sf_dir, "part").select("p_name")).union(table(spark, sf_dir, "supplier").select("s_name")).distinct()
    return raw.select("raw", T.is_metadata_name(F.col("raw")).alias("metadata"), T.is_value_name(F.col("raw")).alias("value"))


def _name_pairs(spark, sf_dir) -> DataFrame:
    """Every two part names; the names are a short fixed vocabulary at any scale."""
    p = table(spark, sf_dir, "part").select(F.lower("p_name").alias("a")).distinct()
    return p.join(p.select(F.col("a").alias("b")), F.col("a") < F.col("b"))


@query(
    """WITH p AS (SELECT DISTINCT lower(p_name) AS n, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS t FROM part)
SELECT x.n AS a, y.n AS b, round(CASE WHEN len(x.t) = 0 OR len(y.t) = 0 THEN 0 ELSE len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) END, 9) AS token FROM p x JOIN p y ON x.n < y.n"""
)
def token_jaccard(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(T.token_jaccard(F.col("a"), F.col("b")), 9).alias("token"))


def _lcs(pairs: str) -> str:
    """Common table expressions up to lexical (a, b, lexical): longest common subsequences of the pairs (a, b), one character of a after another."""
    return f"""lcs AS (SELECT a, b, 0::BIGINT AS i, list_transform(range(length(b) + 1), lambda x: 0::BIGINT) AS row FROM {pairs}
 UNION ALL SELECT a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j::BIGINT]), lambda acc, x: list_append(acc, CASE WHEN substring(b, x[1], 1) = substring(a, i + 1, 1) THEN row[x[1]] + 1 ELSE greatest(row[x[1] + 1], acc[-1]) END), [0::BIGINT]) FROM lcs WHERE i < length(a)),
lexical AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * row[-1] / (length(a) + length(b)) END AS lexical FROM lcs WHERE i = length(a))"""


@query(f"WITH RECURSIVE names AS (SELECT DISTINCT lower(p_name) AS n FROM part), pairs AS (SELECT x.n AS a, y.n AS b FROM names x JOIN names y ON x.n < y.n), {_lcs('pairs')} SELECT a, b, round(lexical, 9) AS lexical FROM lexical")
def lexical_ratio(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(T.lexical_ratio(F.col("a"), F.col("b")), 9).alias("lexical"))


SENTENCES = [
    "Retrieval Augmented Generation (RAG) is used.",
    "We use Retrieval Augmented Generation (RAG) here.",
    "Natural Language Processing, commonly abbreviated as NLP, helps.",
    "Nothing here (abc).",
    "Graph Database abbreviated as GDB. Large Language Model (LLM)",
]
_LONG = fixed.ALIAS_IN_PARENTHESES.replace("'", "''")
_ABBR = fixed.ALIAS_ABBREVIATED.replace("'", "''")


def _alias_sql(pattern: str, how: str) -> str:
    return f"SELECT i, '{how}' AS how, unnest(regexp_extract_all(s, '{pattern}', 1)) AS l, unnest(regexp_extract_all(s, '{pattern}', 2)) AS r FROM said"


@query(
    f"""WITH said AS (SELECT unnest(range({len(SENTENCES)})) AS i, unnest({_list(SENTENCES)}) AS s), found AS ({_alias_sql(_LONG, "parentheses")} UNION ALL {_alias_sql(_ABBR, "abbreviated")}),
named AS (SELECT i, how, lower(regexp_replace(trim(trim(l), '"''`.,;:'), '\\s+', ' ', 'g')) AS long, lower(regexp_replace(trim(trim(r), '"''`.,;:'), '\\s+', ' ', 'g')) AS short, array_to_string(list_transform(regexp_extract_all(l, '[A-Za-z]+'), lambda w: lower(substring(w, 1, 1))), '') AS acronym, len(regexp_extract_all(l, '[A-Za-z]+')) AS words, lower(r) AS r FROM found)
SELECT i, how, long, short FROM named WHERE how = 'abbreviated' OR (words >= 2 AND acronym = r)"""
)
def alias_pairs(spark, sf_dir):
    said = spark.createDataFrame(list(enumerate(SENTENCES)), "i long, s string")
    return said.select("i", F.explode(T.alias_pairs(F.col("s"))).alias("p")).select("i", "p.how", "p.long", "p.short")


@query(
    f"""WITH names AS (SELECT unnest({_list(NAMES)}) AS raw UNION SELECT DISTINCT p_name FROM part), n AS (SELECT raw, {_FORM_SQL} AS name FROM names), x AS (SELECT raw, lower(name) AS form, regexp_extract_all(name, '[A-Za-z]+') AS words FROM n), i AS (SELECT raw, form, CASE WHEN len(words) >= 2 THEN lower(array_to_string(list_transform(words, lambda w: substring(w, 1, 1)), '')) ELSE '' END AS initials FROM x)
SELECT a.raw AS a, b.raw AS b, (a.initials <> '' AND a.initials = b.form) OR (b.initials <> '' AND b.initials = a.form) AS acronym FROM i a JOIN i b ON a.raw < b.raw"""
)
def acronym_pairs(spark, sf_dir):
    """Every two of a short list of names and the part names, a short fixed vocabulary at any scale."""
    raw = spark.createDataFrame([(n,) for n in NAMES], "raw string").union(table(spark, sf_dir, "part").select("p_name")).distinct()
    pairs = raw.select(F.col("raw").alias("a")).join(raw.select(F.col("raw").alias("b")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", T.acronym_match(F.col("a"), F.col("b")).alias("acronym"))


@query("SELECT conv_id, turn, sha256(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g'))) AS hash FROM conversations")
def clean_texts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(T.clean_text(F.col("text")), 256).alias("hash"))


@query(f"WITH {TRIPLES}, m AS (SELECT n_name AS name, 'NATION_' || (n_nationkey % 5) AS canonical FROM nation), g AS (SELECT canonical, list(DISTINCT name ORDER BY name) AS members FROM m GROUP BY canonical) SELECT canonical AS canonical_name, array_to_string(list_filter(members, lambda x: x <> canonical), '|') AS aliases, len(members) > 1 AS clustered FROM g")
def alias_lists(spark, sf_dir):
    """Entities and clusters as they are saved."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("NATION_"), (F.col("n_nationkey") % 5)).alias("canonical"))
    entities, members = sources.clusters(names)
    many = members.select(F.col("canonical").alias("canonical_name"), F.lit(True).alias("clustered"))
    return entities.join(many, "canonical_name", "left").select("canonical_name", F.array_join("aliases", "|").alias("aliases"), F.coalesce("clustered", F.lit(False)).alias("clustered"))


# --- entities -----------------------------------------------------------------


@query(
    f"""WITH {TRIPLES}, sides AS (SELECT pos * 2 AS place, subject AS name, relation, object AS other FROM triples UNION ALL SELECT pos * 2 + 1, object, relation, subject FROM triples)
SELECT name, count(*) AS mentions, count(DISTINCT relation) AS n_relations, count(DISTINCT other) AS n_neighbours, min(place) AS first_seen FROM sides GROUP BY name"""
)
def entity_features(spark, sf_dir):
    f = resolution.features(triples(spark, sf_dir))
    return f.select("name", "mentions", F.size("relations").cast("long").alias("n_relations"), F.size("neighbours").cast("long").alias("n_neighbours"), (F.col("first_seen.pos") * 2 + F.col("first_seen.side")).alias("first_seen"))


_PAIRS = """scored AS (SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS similarity FROM embeddings x, embeddings y),
best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS r FROM scored),
pairs AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(similarity) AS similarity FROM best WHERE r <= 6 AND a <> b AND similarity >= 0.3 GROUP BY 1, 2)"""


@query(f"WITH {_PAIRS} SELECT a, b, similarity FROM pairs")
def sim_topk_pairs(spark, sf_dir):
    return vectors.unordered(vectors.similar_pairs(table(spark, sf_dir, "embeddings"), threshold=0.3))


@query(
    f"""WITH RECURSIVE {_PAIRS}, links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS node, a AS seen FROM links UNION SELECT node, b FROM reach JOIN links ON a = seen)
SELECT node, min(seen) AS root FROM reach GROUP BY node"""
)
def similarity_components(spark, sf_dir):
    return components(sim_topk_pairs(spark, sf_dir).select("a", "b"))


@query(
    f"""WITH {TRIPLES}, m AS (SELECT n_name AS name, 'NATION_' || (n_nationkey % 5) AS canonical FROM nation), re AS (
 SELECT pos, coalesce(s.canonical, subject) AS subject, relation, coalesce(o.canonical, object) AS object FROM triples LEFT JOIN m s ON subject = s.name LEFT JOIN m o ON object = o.name)
SELECT min(pos) AS pos, arg_min(subject, pos) AS subject, arg_min(relation, pos) AS relation, arg_min(object, pos) AS object FROM re GROUP BY lower(subject), lower(relation), lower(object)"""
)
def triple_rewrite_dedup(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("NATION_"), (F.col("n_nationkey") % 5)).alias("canonical"))
    return resolution.deduplicate(resolution.rewrite(triples(spark, sf_dir).drop("source_file"), names)).select("pos", "subject", "relation", "object")


@query(
    """WITH p AS (SELECT DISTINCT p_partkey AS k, 0.7 + (p_partkey % 31) / 100.0::DOUBLE AS s, (p_size * 2)::DOUBLE AS l, (p_size % 10) / 10.0::DOUBLE AS t, (p_size % 7) / 10.0::DOUBLE AS c FROM part)
SELECT k, round(0.45::DOUBLE * s + 0.25::DOUBLE * l / 100 + 0.15::DOUBLE * t + 0.15::DOUBLE * c, 9) AS combined, (s >= 0.80 AND l >= 72) OR (s >= 0.78 AND t >= 0.50) OR (s >= 0.76 AND c >= 0.35) OR s >= 0.88 AS compatible FROM p"""
)
def identity_scores(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    d = lambda c: c.cast("double")
    s, l, t, c = F.lit(0.7) + d(F.col("p_partkey") % 31) / 100.0, d(F.col("p_size") * 2), d(F.col("p_size") % 10) / 10.0, d(F.col("p_size") % 7) / 10.0
    return p.select(F.col("p_partkey").alias("k"), F.round(resolution.identity_score(s, l, t, c), 9).alias("combined"), resolution.compatible(s, l, t, c).alias("compatible"))


def _word_triples(spark, sf_dir) -> DataFrame:
    """Part names as kinds of their last word, with their first word as a property; pos by name."""
    from pyspark.sql import Window

    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("n")).distinct().withColumn("i", F.row_number().over(Window.orderBy("n")))
    words = F.split("n", " ")
    each = F.array(F.struct((F.col("i") * 2).cast("long").alias("pos"), F.col("n").alias("subject"), F.lit("is_a").alias("relation"), F.element_at(words, -1).alias("object")), F.struct((F.col("i") * 2 + 1).cast("long").alias("pos"), F.col("n").alias("subject"), F.lit("has").alias("relation"), F.element_at(words, 1).alias("object")))
    return names.select(F.explode(each).alias("t")).select("t.*")


def _drawn(a, b, at: int):
    """A number from 0.60 to 0.99 that follows from two names."""
    return F.round(F.lit(0.6) + (F.conv(F.substring(F.md5(F.concat(a, F.lit("|"), b).cast("binary")), at, 4), 16, 10).cast("long") % 40) / F.lit(100.0), 2)


def _decided(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Features of names and words, and the decisions on all pairs that share a word; similarities and scores are drawn from the names."""
    f = resolution.features(_word_triples(spark, sf_dir))
    whole = F.struct(*f.columns)
    word = f.select("name", whole.alias("f"), F.explode(T.name_tokens(F.col("name"))).alias("w"))
    y = word.select(F.col("name").alias("b"), F.col("f").alias("y"), F.col("w").alias("v"))
    pairs = word.join(y, (F.col("w") == F.col("v")) & (F.col("name") < F.col("b"))).select(F.col("name").alias("a"), "b", F.col("f").alias("x"), "y").dropDuplicates(["a", "b"])
    pairs = pairs.withColumn("semantic", _drawn(F.col("a"), F.col("b"), 1))
    return f, resolution.cross_accept(resolution.cascade(pairs), lambda rows: rows.withColumn("cross_encoder", _drawn(F.col("a"), F.col("b"), 5)))


_GENERIC = "CASE WHEN len({0}) = 0 THEN true WHEN len({0}) = 1 THEN list_contains(" + _list(fixed.GENERIC_TERMS) + ", {0}[1]) ELSE len(list_intersect({0}, " + _list(fixed.GENERIC_TERMS) + ")) / len({0}) >= 0.7 END"
_JACCARD = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END"
_DECIDED = f"""names AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM (SELECT DISTINCT lower(p_name) AS n FROM part)),
facts AS (SELECT i * 2 AS pos, n AS s, 'is_a' AS r, string_split(n, ' ')[-1] AS o FROM names UNION ALL SELECT i * 2 + 1, n, 'has', string_split(n, ' ')[1] FROM names),
sides AS (SELECT s AS name, r, o AS other, 0 AS side, pos FROM facts UNION ALL SELECT o, r, s, 1, pos FROM facts),
f AS (SELECT name, count(*) AS mentions, min(pos * 2 + side) AS first_seen, list_distinct(list(r)) AS rels, list_distinct(list(other)) AS others, coalesce(list_distinct(list(other) FILTER (side = 0 AND r = 'is_a')), []) AS types, list_distinct(regexp_extract_all(name, '[a-z0-9]+')) AS t,
 array_to_string(list_transform(regexp_extract_all(name, '[A-Za-z]+'), lambda w: substring(w, 1, 1)), '') AS initials, len(regexp_extract_all(name, '[A-Za-z]+')) AS n_words FROM sides GROUP BY name),
pairs AS (SELECT x.name AS a, y.name AS b FROM f x JOIN f y ON x.name < y.name AND len(list_intersect(x.t, y.t)) > 0),
{_lcs('pairs')},
signals AS (SELECT p.a, p.b, x.first_seen AS fa, y.first_seen AS fb, round(0.6 + (('0x' || substring(md5(p.a || '|' || p.b), 1, 4))::BIGINT % 40) / 100.0, 2)::DOUBLE AS semantic, round(0.6 + (('0x' || substring(md5(p.a || '|' || p.b), 5, 4))::BIGINT % 40) / 100.0, 2)::DOUBLE AS drawn, l.lexical, {_JACCARD.format('x.t', 'y.t')} AS token,
 0.35::DOUBLE * {_JACCARD.format('x.rels', 'y.rels')} + 0.40::DOUBLE * {_JACCARD.format('x.others', 'y.others')} + 0.25::DOUBLE * {_JACCARD.format('x.types', 'y.types')} AS context,
 list_contains(x.types, p.b) OR list_contains(y.types, p.a) AS parent,
 (len(list_filter(x.t, lambda w: NOT list_contains(y.t, w))) = 0 AND len(x.t) < len(y.t) AND len(x.t) > 0 AND {_GENERIC.format('x.t')}) OR (len(list_filter(y.t, lambda w: NOT list_contains(x.t, w))) = 0 AND len(y.t) < len(x.t) AND len(y.t) > 0 AND {_GENERIC.format('y.t')}) AS generic,
 (x.n_words >= 2 AND x.initials = p.b) OR (y.n_words >= 2 AND y.initials = p.a) AS short FROM pairs p JOIN lexical l ON l.a = p.a AND l.b = p.b JOIN f x ON x.name = p.a JOIN f y ON y.name = p.b),
ruled AS (SELECT *, 0.45::DOUBLE * semantic + 0.25::DOUBLE * lexical / 100 + 0.15::DOUBLE * token + 0.15::DOUBLE * context AS combined,
 CASE WHEN parent THEN 'explicit_parent_child_relation' WHEN generic THEN 'generic_specific_conflict' ELSE '' END AS reason,
 CASE WHEN parent OR generic THEN 'identity_conflict' WHEN short AND semantic >= 0.70 THEN 'acronym' WHEN semantic >= 0.93 AND lexical >= 92 AND token >= 0.75 THEN 'strong_identity'
 WHEN NOT ((semantic >= 0.80 AND lexical >= 72) OR (semantic >= 0.78 AND token >= 0.50) OR (semantic >= 0.76 AND context >= 0.35) OR semantic >= 0.88) THEN 'candidate_blocked' ELSE 'borderline' END AS rule FROM signals),
crossed AS (SELECT *, CASE WHEN rule = 'borderline' THEN drawn END AS cross_encoder, rule = 'borderline' AND drawn >= 0.88 AND semantic >= 0.82 AND (lexical >= 72 OR token >= 0.5 OR context >= 0.45) AND combined >= 0.72 AS yes FROM ruled),
decided AS (SELECT *, CASE WHEN rule <> 'borderline' THEN rule WHEN yes THEN 'cross_encoder' ELSE 'cross_encoder_rejected' END AS method, rule IN ('acronym', 'strong_identity') OR yes AS merge FROM crossed)"""
_DECISION = "method, reason, round(semantic, 4) AS semantic, round(lexical, 4) AS lexical, round(token, 4) AS token, round(context, 4) AS context, round(combined, 6) AS combined, cross_encoder, merge"


def _decision(rows: DataFrame) -> DataFrame:
    return rows.select("a", "b", "method", "reason", *[F.round(c, n).alias(c) for c, n in (("semantic", 4), ("lexical", 4), ("token", 4), ("context", 4), ("combined", 6))], "cross_encoder", "merge")


@query(f"WITH RECURSIVE {_DECIDED} SELECT a, b, {_DECISION} FROM decided")
def cascade_decisions(spark, sf_dir):
    return _decision(_decided(spark, sf_dir)[1])


@query(f"WITH RECURSIVE {_DECIDED} SELECT method, count(*) AS n, count(*) FILTER (merge) AS merged FROM decided GROUP BY method")
def decision_counts(spark, sf_dir):
    return resolution.statistics(_decided(spark, sf_dir)[1])


@query(
    f"""WITH RECURSIVE {_DECIDED} SELECT a, b, cross_encoder, combined >= 0.75 AS merge FROM decided WHERE method = 'cross_encoder_rejected' AND cross_encoder >= 0.72 AND semantic >= 0.80 AND (lexical >= 55 OR token >= 0.35 OR context >= 0.35)
ORDER BY combined DESC, cross_encoder DESC, semantic DESC, fa, fb LIMIT 2"""
)
def reviewed_pairs(spark, sf_dir):
    """The two best rejected pairs before a verifier that is sure of those scored 0.75 or more."""
    sure = lambda rows: rows.withColumn("same", F.lit(True)).withColumn("confidence", F.when(F.col("combined") >= 0.75, 0.95).otherwise(0.5))
    return resolution.review(_decided(spark, sf_dir)[1], sure).select("a", "b", "cross_encoder", "merge")


@query(
    f"""WITH RECURSIVE {_DECIDED}, links AS (SELECT a, b FROM decided WHERE merge UNION SELECT b, a FROM decided WHERE merge), reach AS (SELECT name AS node, name AS seen FROM f UNION SELECT node, b FROM reach JOIN links ON a = seen),
grouped AS (SELECT node, min(seen) AS cluster FROM reach GROUP BY node),
scored AS (SELECT name, cluster, first_seen, mentions * 10 + least(length(name), 80) - CASE WHEN length(name) <= 2 THEN 20 ELSE 0 END - CASE WHEN {_GENERIC.format('t')} THEN 15 ELSE 0 END AS score FROM f JOIN grouped ON node = name)
SELECT name, first(name ORDER BY score DESC, first_seen) OVER (PARTITION BY cluster ORDER BY score DESC, first_seen ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS canonical, cluster FROM scored"""
)
def canonical_clusters(spark, sf_dir):
    f, decisions = _decided(spark, sf_dir)
    return resolution.canonical_names(f, decisions.filter("merge").select("a", "b"))


@query(
    f"""WITH {TRIPLES}, sides AS (SELECT pos * 2 AS place, subject AS name FROM triples UNION ALL SELECT pos * 2 + 1, object FROM triples), f AS (SELECT name, count(*) AS mentions, min(place) AS first_seen FROM sides GROUP BY name)
SELECT name, mentions, row_number() OVER (ORDER BY mentions DESC, first_seen) AS rank FROM f"""
)
def entity_ranks(spark, sf_dir):
    return resolution.ranked(resolution.features(triples(spark, sf_dir))).select("name", "mentions", F.col("rank").cast("long").alias("rank"))


@query(
    """WITH names AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM (SELECT DISTINCT lower(p_name) AS n FROM part)),
facts AS (SELECT i * 2 AS pos, n AS s, 'is_a' AS r, string_split(n, ' ')[-1] AS o FROM names UNION ALL SELECT i * 2 + 1, n, 'has', string_split(n, ' ')[1] FROM names),
ahead AS (SELECT s AS name, list('-> ' || r || ' ' || o ORDER BY pos) AS l, list_sort(list_distinct(list(o) FILTER (r = 'is_a'))) AS types FROM facts GROUP BY s), back AS (SELECT o AS name, list('<- ' || r || ' ' || s ORDER BY pos) AS l FROM facts GROUP BY o), every AS (SELECT name FROM ahead UNION SELECT name FROM back)
SELECT name, 'Entity: ' || name || CASE WHEN len(types) > 0 THEN chr(10) || 'Possible types: ' || array_to_string(types, ', ') ELSE '' END || CASE WHEN a.l IS NULL THEN '' ELSE chr(10) || array_to_string(a.l[1:15], chr(10)) END || CASE WHEN b.l IS NULL THEN '' ELSE chr(10) || array_to_string(b.l[1:15], chr(10)) END AS representation
FROM every LEFT JOIN ahead a USING (name) LEFT JOIN back b USING (name)"""
)
def entity_texts(spark, sf_dir):
    return resolution.representation(resolution.features(_word_triples(spark, sf_dir))).select("name", "representation")


def _part_triples(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_brand").alias("brand"), F.min("p_type").alias("type"))
    pos = F.xxhash64("p_name").bitwiseAND((1 << 40) - 1) * 2
    return p.select(F.explode(F.array(F.struct(pos.alias("pos"), F.col("p_name").alias("subject"), F.lit("has").alias("relation"), F.col("brand").alias("object")), F.struct((pos + 1).alias("pos"), F.col("p_name").alias("subject"), F.lit("is a").alias("relation"), F.col("type").alias("object")))).alias("t")).select("t.*")


@query()
def resolve_cascade(spark, sf_dir):
    """Every decision about part names, with hashed embeddings and a low similarity threshold."""
    _, _, decisions, _ = resolution.resolve(_part_triples(spark, sf_dir), plugins.embed, threshold=0.3)
    return decisions.select(F.col("x.name").alias("entity"), F.col("y.name").alias("candidate"), "method", "reason", F.round("semantic", 4).alias("semantic"), F.round("lexical", 2).alias("lexical"), F.round("token", 4).alias("token"), F.round("context", 4).alias("context"), F.round("combined", 6).alias("combined"), "merge")


@query()
def resolved_triples(spark, sf_dir):
    out, _, _, _ = resolution.resolve(_part_triples(spark, sf_dir), plugins.embed, threshold=0.3)
    return out


_FACT_SQL = plugins._FACT.pattern.replace("\\w", "\\p{L}\\p{N}_")


@query(
    f"""WITH {CHUNKS}, found AS (SELECT doc_id, chunk_id, regexp_extract_all(text, '{_FACT_SQL}', 1) AS s, regexp_extract_all(text, '{_FACT_SQL}', 2) AS r, regexp_extract_all(text, '{_FACT_SQL}', 3) AS o FROM chunks)
SELECT doc_id, chunk_id, 'success' AS status, len(list_distinct(list_transform(range(1, len(s) + 1), lambda i: s[i] || '|' || r[i] || '|' || o[i]))) AS n_triples FROM found"""
)
def extract_triples(spark, sf_dir):
    """Plain-sentence facts of every fixed chunk of the documents."""
    c = chunking.fixed_windows(table(spark, sf_dir, "documents"))
    return plugins.extract(c).select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "status", F.size("triples").cast("long").alias("n_triples"))


# --- graph --------------------------------------------------------------------


@query(f"WITH {EDGES} SELECT * FROM edges")
def graph_edges(spark, sf_dir):
    return graph.edges(triples(spark, sf_dir))


@query(f"WITH {TRIPLES}, n AS (SELECT subject AS name, pos * 2 AS place, source_file FROM triples UNION ALL SELECT object, pos * 2 + 1, source_file FROM triples) SELECT name, arg_min(source_file, place) AS source_file FROM n GROUP BY name")
def graph_nodes(spark, sf_dir):
    return graph.nodes(triples(spark, sf_dir))


@query(
    f"""WITH {EDGES}, {CHUNKS} SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS entities, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM edges) AS relationships"""
)
def graph_counts(spark, sf_dir):
    t = triples(spark, sf_dir)
    return graph.counts(graph.nodes(t), chunking.fixed_windows(table(spark, sf_dir, "documents")), graph.edges(t)).select("entities", "chunks", "relationships")


_PATHS = f"""{EDGES}, p1 AS (SELECT [src, dst] AS entities, [rel] AS relationships FROM edges WHERE src <> dst),
p2 AS (SELECT list_append(entities, dst) AS entities, list_append(relationships, rel) AS relationships FROM p1 JOIN edges ON src = entities[-1] AND NOT list_contains(entities, dst)),
p3 AS (SELECT list_append(entities, dst) AS entities, list_append(relationships, rel) AS relationships FROM p2 JOIN edges ON src = entities[-1] AND NOT list_contains(entities, dst)),
paths AS (SELECT * FROM (SELECT * FROM p1 UNION SELECT * FROM p2 UNION SELECT * FROM p3) WHERE entities[1] = 'EUROPE' OR entities[-1] = 'EUROPE')"""


def _europe(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    seeds = spark.createDataFrame([("EUROPE",)], "name string")
    return graph.paths(graph.edges(triples(spark, sf_dir)), seeds, limit=None), seeds


@query(f"WITH {_PATHS} SELECT array_to_string(entities, '|') AS entities, array_to_string(relationships, '|') AS relationships FROM paths")
def paths_1_3(spark, sf_dir):
    found, _ = _europe(spark, sf_dir)
    return found.select(F.array_join("entities", "|").alias("entities"), F.array_join("relationships", "|").alias("relationships"))


@query(
    f"""WITH {_PATHS} SELECT CASE len(relationships) WHEN 1 THEN entities[1] || ' ' || relationships[1] || ' ' || entities[2] WHEN 2 THEN entities[1] || ' ' || relationships[1] || ' ' || entities[2] || ' ; ' || entities[2] || ' ' || relationships[2] || ' ' || entities[3]
 ELSE entities[1] || ' ' || relationships[1] || ' ' || entities[2] || ' ; ' || entities[2] || ' ' || relationships[2] || ' ' || entities[3] || ' ; ' || entities[3] || ' ' || relationships[3] || ' ' || entities[4] END AS text,
 round(0.06 + CASE len(relationships) WHEN 1 THEN 0.08 WHEN 2 THEN 0.03 ELSE 0 END + least(0.03 * len(relationships), 0.06)::DOUBLE, 6) AS score FROM paths"""
)
def path_scores(spark, sf_dir):
    found, _ = _europe(spark, sf_dir)
    e, r = F.col("entities"), F.col("relationships")
    hits = F.size(F.array_intersect(e, F.array(F.lit("EUROPE"))))
    return found.select(graph.path_text(e, r).alias("text"), F.round(graph.path_score(F.lit(0.0), e, r, hits, F.lit(0.0)), 6).alias("score"))


@query(f"WITH {TRIPLES}, n AS (SELECT subject AS name FROM triples WHERE source_file <> 'customer' UNION ALL SELECT object FROM triples WHERE source_file <> 'supplier') SELECT name, count(*) AS count FROM n GROUP BY name HAVING count(*) > 1")
def key_violations(spark, sf_dir):
    """Names that two lists of mentions hold together more than once."""
    t = triples(spark, sf_dir)
    return graph.violations(t.filter("source_file <> 'customer'").select(F.col("subject").alias("name")).unionByName(t.filter("source_file <> 'supplier'").select(F.col("object").alias("name"))), "name")


@query("SELECT vec_id, len(embedding) AS size FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) <> 384")
def wrong_dimensions(spark, sf_dir):
    return graph.wrong_dimension(table(spark, sf_dir, "embeddings"), 384).select("vec_id", F.size("embedding").cast("long").alias("size"))


@query(
    """WITH t AS (SELECT conv_id::VARCHAR AS source_file, turn AS chunk_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM conversations), old AS (SELECT * FROM t WHERE chunk_id % 2 = 0 AND text <> ''), new AS (SELECT source_file, chunk_id, text || ' again' AS text FROM t WHERE chunk_id % 3 = 0 AND text <> '')
SELECT source_file, chunk_id, sha256(text) AS hash FROM (SELECT * FROM new UNION ALL SELECT o.* FROM old o ANTI JOIN new n ON n.source_file = o.source_file AND n.chunk_id = o.chunk_id)"""
)
def chunk_upserts(spark, sf_dir):
    """Turns as chunks: every second one is there, every third comes again with another text."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("source_file"), F.col("turn").alias("chunk_id"), "text")
    old = graph.fresh_chunks(t.filter("chunk_id % 2 = 0"))
    new = t.filter("chunk_id % 3 = 0").withColumn("text", F.when(T.strip("text") != "", F.concat(T.strip("text"), F.lit(" again"))))
    return graph.upsert_chunks(old, new).select("source_file", "chunk_id", F.sha2("text", 256).alias("hash"))


@query(f"WITH {EDGES}, n AS (SELECT subject AS name, pos * 2 AS place, source_file FROM triples UNION ALL SELECT object, pos * 2 + 1, source_file FROM triples), old AS (SELECT name, arg_min(source_file, place) AS source_file FROM n WHERE source_file <> 'customer' GROUP BY name), new AS (SELECT name, arg_min(source_file, place) AS source_file FROM n WHERE source_file = 'customer' GROUP BY name) SELECT * FROM old UNION ALL SELECT * FROM new ANTI JOIN old USING (name)")
def node_upserts(spark, sf_dir):
    """Nodes of suppliers and nations, then those of customers: the first writer wins."""
    t = triples(spark, sf_dir)
    return graph.add_nodes(graph.nodes(t.filter("source_file <> 'customer'")), graph.nodes(t.filter("source_file = 'customer'")))


SIGNAL_NAMES = ["45% yield", "4 mW", "doi:10.1/x", "Journal of X", "plain name", "paper"]
SIGNAL_RELATIONS = fixed.METADATA_RELATIONS[:2] + fixed.GENERIC_RELATIONS[:2] + ["USES"]


@query(
    f"""WITH n AS (SELECT unnest({_list(SIGNAL_NAMES)}) AS name), r AS (SELECT unnest({_list(SIGNAL_RELATIONS)}) AS rel), b AS (SELECT DISTINCT p_brand AS brand FROM part),
p AS (SELECT [x.name, brand, y.name] AS e, [r.rel, q.rel] AS l FROM n x, n y, r, r q, b WHERE x.name <> y.name)
SELECT array_to_string(e, '|') AS entities, array_to_string(l, '|') AS relationships,
 round(least(0.04 * len(list_filter(e, lambda x: regexp_matches(lower(trim(x)), '{"|".join("(?:" + p + ")" for p in fixed.VALUE_PATTERNS)}'))), 0.08)::DOUBLE, 6) AS value,
 round((least(0.03 * len(list_filter(l, lambda x: NOT list_contains({_list(fixed.GENERIC_RELATIONS)}, x))), 0.06) - least(0.035 * len(list_filter(l, lambda x: list_contains({_list(fixed.GENERIC_RELATIONS)}, x))), 0.07))::DOUBLE, 6) AS specificity,
 round((least(0.20 * len(list_filter(l, lambda x: list_contains({_list(fixed.METADATA_RELATIONS)}, x))), 0.40) + least(0.10 * len(list_filter(e, lambda x: regexp_matches(lower(trim(x)), '{"|".join(m.replace(".", "[.]") for m in fixed.METADATA_MARKS)}'))), 0.20))::DOUBLE, 6) AS penalty FROM p"""
)
def path_signals(spark, sf_dir):
    """Values, telling relations and metadata of two-hop paths between fixed names by way of every brand."""
    ends = [(a, b, x, y) for a in SIGNAL_NAMES for b in SIGNAL_NAMES if a != b for x in SIGNAL_RELATIONS for y in SIGNAL_RELATIONS]
    ends = spark.createDataFrame(ends, "name string, other string, rel string, rel2 string").coalesce(1)
    rows = table(spark, sf_dir, "part").select("p_brand").distinct().crossJoin(F.broadcast(ends)).select(F.array("name", "p_brand", "other").alias("e"), F.array("rel", "rel2").alias("l"))
    e, l = F.col("e"), F.col("l")
    return rows.select(F.array_join("e", "|").alias("entities"), F.array_join("l", "|").alias("relationships"), F.round(graph.value_relevance(e), 6).alias("value"), F.round(graph.specificity(l), 6).alias("specificity"), F.round(graph.metadata_penalty(e, l), 6).alias("penalty"))


_ASKED = _list(retrieval.question_tokens(NAMES_QUESTION))
_MEASURES = int(bool(set(retrieval.question_tokens(NAMES_QUESTION)) & set(fixed.MEASUREMENT_TERMS)))
_GREEDY = f"""{_PATHS}, said AS (SELECT entities AS e, relationships AS l, CASE len(relationships) WHEN 1 THEN entities[1] || ' ' || relationships[1] || ' ' || entities[2] WHEN 2 THEN entities[1] || ' ' || relationships[1] || ' ' || entities[2] || ' ; ' || entities[2] || ' ' || relationships[2] || ' ' || entities[3]
 ELSE entities[1] || ' ' || relationships[1] || ' ' || entities[2] || ' ; ' || entities[2] || ' ' || relationships[2] || ' ' || entities[3] || ' ; ' || entities[3] || ' ' || relationships[3] || ' ' || entities[4] END AS text FROM paths),
met AS (SELECT *, list_intersect({_ASKED}, regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[a-z0-9]+)?')) AS asked, {_embedded('text', NAMES_QUESTION)} AS semantic, len(list_filter(e, lambda x: regexp_matches(lower(trim(x)), '{"|".join("(?:" + p + ")" for p in fixed.VALUE_PATTERNS)}'))) AS n_values FROM said),
scored AS (SELECT *, len(asked)::DOUBLE / len({_ASKED}) AS coverage FROM met),
pool AS (SELECT *, round(semantic + 0.06::DOUBLE + CASE len(l) WHEN 1 THEN 0.08::DOUBLE WHEN 2 THEN 0.03::DOUBLE ELSE 0 END + least(0.10::DOUBLE * coverage, 0.10) + least(0.04::DOUBLE * n_values, 0.08) + least(0.03::DOUBLE * len(l), 0.06), 6) AS score FROM scored ORDER BY score DESC, text LIMIT {max(fixed.RERANK_FACTOR * 8, fixed.RERANK_LEAST)}),
steps AS (SELECT 0 AS rank, []::VARCHAR[] AS covered, []::VARCHAR[][] AS chosen, []::VARCHAR[] AS texts, NULL::VARCHAR AS text, NULL::DOUBLE AS selection, NULL::VARCHAR AS fresh
 UNION ALL SELECT * FROM (SELECT rank + 1, list_distinct(list_concat(covered, asked)), list_append(chosen, e), list_append(texts, p.text), p.text, selection, array_to_string(list_sort(new), '|') FROM (
  SELECT *, score + least(0.06::DOUBLE * len(new), 0.18) + 0.08::DOUBLE * {_MEASURES} * least(n_values, 1) - 0.07::DOUBLE * CASE WHEN len(list_filter(chosen, lambda x: len(list_intersect(x, e))::DOUBLE / len(list_distinct(list_concat(x, e))) >= 0.8)) > 0 THEN 1 ELSE 0 END AS selection FROM (
   SELECT s.rank, s.covered, s.chosen, s.texts, q.text, q.e, q.asked, q.score, q.n_values, list_filter(q.asked, lambda x: NOT list_contains(s.covered, x)) AS new FROM steps s JOIN pool q ON NOT list_contains(s.texts, q.text) WHERE s.rank < 8)) p ORDER BY round(selection, 9) DESC, score DESC, p.text LIMIT 1))"""


def _ranked(spark, sf_dir) -> DataFrame:
    """Paths of EUROPE as rank_paths() gives them, with scores to 6 places."""
    found, seeds = _europe(spark, sf_dir)
    return retrieval.rank_paths(found, seeds, NAMES_QUESTION, 8, places=6)


@query(f"WITH RECURSIVE {_GREEDY} SELECT text, score, round(semantic, 6) AS semantic_score, round(coverage, 9) AS query_coverage, len(l) = 1 AS direct_fact FROM pool")
def ranked_paths(spark, sf_dir):
    return _ranked(spark, sf_dir).select("text", "score", F.round("semantic_score", 6).alias("semantic_score"), F.round("query_coverage", 9).alias("query_coverage"), "direct_fact")


@query(f"WITH RECURSIVE {_GREEDY} SELECT s.rank::BIGINT AS rank, s.text, array_to_string(e, '|') AS entities, array_to_string(l, '|') AS relationships, score, round(selection, 6) AS selection_score, fresh AS new_query_tokens FROM steps s JOIN pool USING (text)")
def greedy_paths(spark, sf_dir):
    out = retrieval.select_greedily(_ranked(spark, sf_dir), NAMES_QUESTION, 8)
    return out.select(F.col("rank").cast("long").alias("rank"), "text", F.array_join("entities", "|").alias("entities"), F.array_join("relationships", "|").alias("relationships"), "score", F.round("selection_score", 6).alias("selection_score"), F.array_join("new_query_tokens", "|").alias("new_query_tokens"))


@query(
    f"""WITH {_PATHS}, ranked AS (SELECT *, row_number() OVER (ORDER BY len(relationships), array_to_string(entities, '|'), array_to_string(relationships, '|')) AS rank FROM paths),
steps AS (SELECT rank, unnest(range(1, len(relationships) + 1)) AS i, entities, relationships FROM ranked)
SELECT entities[i] AS source, entities[i + 1] AS target, relationships[i] AS relation, min(rank) AS first_rank FROM steps GROUP BY ALL"""
)
def graph_payload_links(spark, sf_dir):
    from pyspark.sql import Window

    found, _ = _europe(spark, sf_dir)
    order = Window.orderBy(F.size("relationships"), F.array_join("entities", "|"), F.array_join("relationships", "|"))
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("score", F.col("rank"))
    return answer.payload(ranked)[1].withColumnRenamed("score", "first_rank")


# --- retrieval ----------------------------------------------------------------


@query(
    """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], e), 6) AS score, round((1 + round(list_dot_product(embedding::DOUBLE[], e), 6)) / 2, 6) AS index_score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 5"""
)
def vector_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    q = rows.filter("vec_id = 0").first()["embedding"]
    return vectors.top_k(rows, q).select("vec_id", "score", F.round(vectors.index_score(F.col("score")), 6).alias("index_score"))


def _turns(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("source_file"), (F.col("turn") + 1).alias("chunk_id"), "text")


_EXPANDED = """turns AS (SELECT conv_id::VARCHAR AS source_file, turn + 1 AS chunk_id, text FROM conversations),
hits AS (SELECT *, length(text)::DOUBLE AS score FROM turns ORDER BY score DESC, source_file, chunk_id LIMIT 5),
wanted AS (SELECT DISTINCT source_file, unnest(generate_series(chunk_id - 1, chunk_id + 1)) AS chunk_id FROM (SELECT * FROM hits ORDER BY score DESC, source_file, chunk_id LIMIT 3)),
expanded AS (SELECT source_file, chunk_id, text, score, false AS is_neighbor FROM hits UNION ALL
 SELECT t.source_file, t.chunk_id, t.text, 0.0, true FROM turns t JOIN wanted w ON t.source_file = w.source_file AND t.chunk_id = w.chunk_id AND t.chunk_id > 0 ANTI JOIN hits h ON h.source_file = t.source_file AND h.chunk_id = t.chunk_id)"""


def _expanded(spark, sf_dir) -> DataFrame:
    turns = _turns(spark, sf_dir)
    hits = turns.withColumn("score", F.length("text").cast("double")).orderBy(F.desc("score"), "source_file", "chunk_id").limit(fixed.TOP_CHUNKS)
    return vectors.expand_neighbours(hits, turns)


@query(f"WITH {_EXPANDED} SELECT source_file, chunk_id, score, is_neighbor, sha256(text) AS hash FROM expanded")
def neighbour_expand(spark, sf_dir):
    return _expanded(spark, sf_dir).select("source_file", "chunk_id", "score", "is_neighbor", F.sha2("text", 256).alias("hash"))


@query(
    f"""WITH {_EXPANDED}, numbered AS (SELECT *, row_number() OVER (ORDER BY source_file, chunk_id) AS i, CASE WHEN is_neighbor THEN 1200 ELSE 2500 END AS n, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS t FROM expanded)
SELECT i AS index, 'VECTOR EVIDENCE ' || i || chr(10) || 'chunk_id: ' || chunk_id || chr(10) || 'source_file: ' || source_file || chr(10) || 'score: ' || printf('%.4f', score::DOUBLE) || chr(10) || 'is_neighbor: ' || CASE WHEN is_neighbor THEN 'True' ELSE 'False' END || chr(10) || 'text:' || chr(10) || CASE WHEN length(t) > n THEN rtrim(substring(t, 1, n), ' ' || chr(10) || chr(9) || chr(13)) || '...' ELSE t END AS block FROM numbered"""
)
def context_blocks(spark, sf_dir):
    return answer.vector_context(_expanded(spark, sf_dir)).select(F.col("index").cast("long").alias("index"), "block")


@query(
    f"""WITH {_EXPANDED}, numbered AS (SELECT *, row_number() OVER (ORDER BY source_file, chunk_id) AS i, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS t FROM expanded)
SELECT i AS index, 'VECTOR EVIDENCE ' || i || chr(10) || 'chunk_id: ' || chunk_id || chr(10) || 'source_file: ' || source_file || chr(10) || 'score: ' || printf('%.4f', score::DOUBLE) || chr(10) || 'is_neighbor: False' || chr(10) || 'text:' || chr(10) || substring(t, 1, {fixed.PLAIN_CONTEXT_LIMIT}) AS block FROM numbered WHERE t <> ''"""
)
def plain_context(spark, sf_dir):
    return answer.vector_context(_expanded(spark, sf_dir), expanded=False).select(F.col("index").cast("long").alias("index"), "block")


@query(f"WITH {_EXPANDED} SELECT source_file, chunk_id, score, CASE WHEN length(t) > {fixed.EVIDENCE_LIMIT} THEN rtrim(substring(t, 1, {fixed.EVIDENCE_LIMIT}), ' ' || chr(10) || chr(9) || chr(13)) || '...' ELSE t END AS text FROM (SELECT *, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS t FROM expanded)")
def evidence_rows(spark, sf_dir):
    return answer.evidence(_expanded(spark, sf_dir))


@query(
    f"""WITH {_PATHS}, said AS (SELECT entities[1] || ' ' || relationships[1] || ' ' || entities[2] AS text, len(relationships) AS hops FROM paths WHERE len(relationships) = 1), ranked AS (SELECT *, row_number() OVER (ORDER BY text) AS rank FROM said)
SELECT rank AS index, 'GRAPH PATH ' || rank || chr(10) || 'score: ' || printf('%.4f', 1.0 / rank) || chr(10) || 'semantic_score: ' || printf('%.4f', 0.5 / rank) || chr(10) || 'path: ' || text AS block FROM ranked"""
)
def graph_blocks(spark, sf_dir):
    from pyspark.sql import Window

    found, _ = _europe(spark, sf_dir)
    rows = found.filter(F.size("relationships") == 1).withColumn("text", graph.path_text(F.col("entities"), F.col("relationships")))
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy("text")).cast("long")).withColumn("score", F.lit(1.0) / F.col("rank")).withColumn("semantic_score", F.lit(0.5) / F.col("rank"))
    return answer.graph_context(rows)


_QUESTION_TOKENS = retrieval.question_tokens(QUESTION)
_CHUNK_SCORES = f"""{CHUNKS}, tokens AS (SELECT doc_id, chunk_id, text, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[a-z0-9]+)?'), lambda t: length(t) > 1 AND NOT list_contains({_list(fixed.STOPWORDS)}, t))) AS t FROM chunks),
scored AS (SELECT doc_id, chunk_id, text, round(CASE WHEN len(t) = 0 THEN 0 ELSE len(list_intersect({_list(_QUESTION_TOKENS)}, t)) / {len(_QUESTION_TOKENS)} END, 9) AS score FROM tokens)"""


def _scored_chunks(spark, sf_dir) -> DataFrame:
    c = chunking.fixed_windows(table(spark, sf_dir, "documents"))
    return c.withColumn("score", F.round(T.share_of(_QUESTION_TOKENS, F.col("text")), 9))


@query(f"WITH {_CHUNK_SCORES} SELECT doc_id, chunk_id, score FROM scored")
def lexical_overlap(spark, sf_dir):
    return _scored_chunks(spark, sf_dir).select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "score")


@query(
    f"""WITH {_CHUNK_SCORES}, hits AS (SELECT *, doc_id::VARCHAR AS source_file FROM scored ORDER BY score DESC, doc_id::VARCHAR, chunk_id LIMIT 5),
wanted AS (SELECT DISTINCT source_file, unnest(generate_series(chunk_id - 1, chunk_id + 1)) AS chunk_id FROM (SELECT * FROM hits ORDER BY score DESC, source_file, chunk_id LIMIT 3)),
own AS (SELECT source_file, chunk_id, score, false AS is_neighbor, text FROM hits)
SELECT source_file, chunk_id, score, is_neighbor, sha256(text) AS hash FROM (SELECT * FROM own UNION ALL SELECT s.doc_id::VARCHAR, s.chunk_id, 0.0, true, s.text FROM scored s JOIN wanted w ON s.doc_id::VARCHAR = w.source_file AND s.chunk_id = w.chunk_id AND s.chunk_id > 0 ANTI JOIN hits h ON h.source_file = s.doc_id::VARCHAR AND h.chunk_id = s.chunk_id)"""
)
def retrieve_chunks(spark, sf_dir):
    return flagship(spark, sf_dir)


_NAME_TOKENS = retrieval.question_tokens(NAMES_QUESTION)
_SEEDS = f"""{EDGES}, nodes AS (SELECT src AS name FROM edges UNION SELECT dst FROM edges),
entities AS (SELECT name FROM nodes WHERE len(list_filter({_list(_NAME_TOKENS)}, lambda t: contains(lower(name), t))) > 0 ORDER BY name LIMIT 40),
seeds AS (SELECT name, round(len(list_intersect({_list(_NAME_TOKENS)}, list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+(?:\\.[a-z0-9]+)?'), lambda t: length(t) > 1)))) / {len(_NAME_TOKENS)}, 9) AS score FROM entities)"""


@query(f"WITH {_SEEDS} SELECT name, score FROM seeds WHERE score > 0 ORDER BY score DESC, name LIMIT 6")
def lexical_seeds(spark, sf_dir):
    nodes = graph.nodes(triples(spark, sf_dir))
    none = spark.createDataFrame([], "name string")
    found = retrieval.lexical_seeds(retrieval.lexical_entities(nodes, _NAME_TOKENS), none, _NAME_TOKENS)
    return found.select("name", F.round("score", 9).alias("score"))


_HYBRID = f"""{EDGES}, n AS (SELECT subject AS name, pos * 2 AS place, source_file FROM triples UNION ALL SELECT object, pos * 2 + 1, source_file FROM triples), nodes AS (SELECT name, arg_min(source_file, place) AS source_file FROM n GROUP BY name),
scored AS (SELECT *, {_embedded('name', NAMES_QUESTION)} AS score, regexp_matches(lower(trim(name)), '{"|".join(m.replace(".", "[.]") for m in fixed.METADATA_MARKS)}') AS metadata FROM nodes),
hits AS (SELECT * FROM scored ORDER BY score DESC, name LIMIT {fixed.VECTOR_ENTITIES}), semantic AS (SELECT * FROM hits WHERE trim(name) <> '' AND NOT metadata ORDER BY score DESC, name LIMIT {fixed.SEEDS_EACH}),
entities AS (SELECT * FROM scored WHERE len(list_filter({_list(_NAME_TOKENS)}, lambda t: contains(lower(name), t))) > 0 ORDER BY name, source_file LIMIT {fixed.LEXICAL_ENTITIES}),
shares AS (SELECT name, source_file, len(list_intersect({_list(_NAME_TOKENS)}, regexp_extract_all(lower(name), '[a-z0-9]+(?:\\.[a-z0-9]+)?')))::DOUBLE / {len(_NAME_TOKENS)} AS lexical_score, regexp_matches(lower(trim(name)), '{"|".join("(?:" + p + ")" for p in fixed.VALUE_PATTERNS)}') AS value FROM entities ANTI JOIN semantic USING (name) WHERE NOT metadata),
lexical AS (SELECT *, lexical_score + CASE WHEN value THEN 0.05 ELSE 0 END AS score FROM shares WHERE lexical_score > 0 ORDER BY score DESC, name LIMIT {fixed.SEEDS_EACH})"""


@query(f"WITH {_HYBRID} SELECT name, score FROM scored")
def embedding_scores(spark, sf_dir):
    """Every node's similarity with a question."""
    q = F.array(*[F.lit(x) for x in plugins.embed_string(NAMES_QUESTION)])
    return plugins.embed(graph.nodes(triples(spark, sf_dir)), "name").select("name", F.round(vectors.dot(F.col("embedding"), q), 6).alias("score"))


@query(f"WITH {_HYBRID} SELECT name, source_file, round(score, 9) AS score, round(score, 9) AS semantic_score, 0.0::DOUBLE AS lexical_score, true AS from_vector, false AS from_lexical FROM semantic UNION ALL SELECT name, source_file, round(score, 9), 0.0::DOUBLE, round(lexical_score, 9), false, true FROM lexical")
def hybrid_seeds(spark, sf_dir):
    nodes = plugins.embed(graph.nodes(triples(spark, sf_dir)), "name")
    semantic = retrieval.semantic_seeds(vectors.top_k(nodes, plugins.embed_string(NAMES_QUESTION), fixed.VECTOR_ENTITIES, key="name"))
    seeds = retrieval.hybrid_seeds(semantic, retrieval.lexical_seeds(retrieval.lexical_entities(nodes, _NAME_TOKENS), semantic, _NAME_TOKENS))
    return seeds.select("name", "source_file", *[F.round(c, 9).alias(c) for c in ("score", "semantic_score", "lexical_score")], "from_vector", "from_lexical")


REPLIES = ["SUPPORTED", "the answer is UNSUPPORTED", "needs_correction: yes", "", "Insufficient evidence.", "It cannot be determined", "All fine", "429 Too Many Requests", "Quota exceeded"]


@query(
    f"""WITH r AS (SELECT unnest({_list(REPLIES)}) AS reply)
SELECT reply, CASE WHEN contains(upper(reply), 'NEEDS_CORRECTION') THEN 'NEEDS_CORRECTION' WHEN contains(upper(reply), 'UNSUPPORTED') THEN 'UNSUPPORTED' WHEN contains(upper(reply), 'SUPPORTED') THEN 'SUPPORTED' ELSE 'NEEDS_CORRECTION' END AS label,
 regexp_matches(lower(reply), '{"|".join(p.replace("'", "''") for p in fixed.SUSPICIOUS_PHRASES)}') AS suspicious, regexp_matches(lower(reply), '{"|".join(fixed.RATE_LIMIT_MARKS)}') AS rate_limit FROM r"""
)
def reply_labels(spark, sf_dir):
    r = spark.createDataFrame([(x,) for x in REPLIES], "reply string")
    return r.select("reply", T.validation_label(F.col("reply")).alias("label"), T.is_suspicious(F.col("reply")).alias("suspicious"), T.is_rate_limit(F.col("reply")).alias("rate_limit"))


UPLOADS = [("a b/ç.pdf", 10), ("..x__.PDF", 5), ("big.pdf", 60 << 20), ("note.txt", 1), ("___.pdf", 1)]


@query(
    f"""WITH u AS (SELECT unnest({_list([n for n, _ in UPLOADS])}) AS name, unnest({[s for _, s in UPLOADS]}) AS size)
SELECT name, size, CASE WHEN NOT lower(name) LIKE '%.pdf' THEN 400 WHEN size > 52428800 THEN 413 ELSE 200 END AS status, coalesce(nullif(trim(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'document') || '.pdf' AS stored FROM u"""
)
def upload_checks(spark, sf_dir):
    return sources.accepted_uploads(spark.createDataFrame(UPLOADS, "name string, size long"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five chunks that share most words with the question, and their neighbours."""
    chunks = _scored_chunks(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_file"), F.col("chunk_id").cast("long").alias("chunk_id"), "text", "score")
    hits = chunks.orderBy(F.desc("score"), "source_file", "chunk_id").limit(fixed.TOP_CHUNKS)
    return vectors.expand_neighbours(hits, chunks.drop("score")).select("source_file", "chunk_id", "score", "is_neighbor", F.sha2("text", 256).alias("hash"))
