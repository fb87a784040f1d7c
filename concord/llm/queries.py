"""Registered queries of the package: each applies one operator to its whole table and derives the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import decontaminate, filter_audit, grid_join, lattice, line_dedup, mixing, ngram_join, pseudonyms, quality, token_counts, toxicity, vector_codes, warc
from concord.llm.store import fold, materialize, new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(modulus: int, remainder: int):
    """True where the id's remainder is the given one; ids without a value are in no fold."""
    return F.coalesce(fold("doc_id", modulus) == remainder, F.lit(False))


@query()
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    vectors, network = quality.train(docs, labels, ~in_fold(3, 1))
    return quality.score(docs, vectors, network).select(
        "doc_id", in_fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query()
def op10_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, ~in_fold(5, 0))
    return toxicity.score(docs, model).select(
        "doc_id", in_fold(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


# words of a text, and every run of words that occurs as an item's window; long texts make long lists, so pieces are hashed
_SQL4 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS p
        FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS p FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)),
hit AS (SELECT dw.r, dw.i, dw.n, iw.item FROM dw JOIN iw USING (n, p)),
pos AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""


@query(_SQL4)
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


LEAST_REVISIT_BYTES = 1000


@query("""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT payload_digest, max(page_id) AS winner FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = winner OR winner IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM p LEFT JOIN w USING (payload_digest)
""")
def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", payload.alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("length")
    )
    # written out, so that its size is known to the planner and a payload's many copies can be dealt to several tasks
    shared = materialize(
        pages.filter(F.col("length") >= LEAST_REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    records = pages.join(shared, "digest", "left").select(
        name(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("warc_date"), F.when(revisit, name(F.col("first"))).alias("refers_to"),
        F.col("digest").alias("payload_digest"), F.col("length").alias("payload_length"), F.when(~revisit, F.col("html").cast("binary")).alias("payload"),
    )
    folder = new_folder(spark, "warc")
    warc.write(records, folder)
    back = warc.read(spark, folder)
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    full = F.col("record_type") == "response"
    return back.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(full, F.octet_length("payload")).otherwise(F.col("http_length")).cast("long").alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", number(F.col("refers_to")).alias("refers_to"),
    )


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    places = token_counts.write_tokens(table(spark, sf_dir, "documents"), folder)
    counts = token_counts.token_counts(spark, folder)
    return places.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")


@query()
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY 1) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1) USING (vec_id)
""")
def op6_embedding_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.linked_vectors(table(spark, sf_dir, "embeddings"))


# of this query only; a run over real data passes a secret of its own
QUERY_KEY = "test key"


@query()
def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY, count="n_replaced")


@query()
def op8_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), in_fold(10, 0))


@query("""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)),
shared AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 3),
marked AS (SELECT r, doc_id, pos, line, shared.key IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM l LEFT JOIN shared USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
""")
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def _codes_sql(rounds: int = 6, entries: int = 16, parts: int = 8) -> str:
    """The rounds one after the other: parts to their nearest entries, entries to the floor of their parts' means."""
    # the parts first, then a table of entries for each round
    steps = [f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
x AS MATERIALIZED (SELECT r, p, j, v[p * (len(v) // {parts}) + j + 1] AS c FROM k, range({parts}) AS a(p), range((SELECT max(len(v)) FROM k) // {parts}) AS b(j)),
e0 AS MATERIALIZED (SELECT p, r - 1 AS e, j, c FROM x WHERE r <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT r, p, e, sum((x.c - e{i}.c) * (x.c - e{i}.c))::BIGINT AS d FROM x JOIN e{i} USING (p, j) GROUP BY r, p, e) GROUP BY r, p)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT p, e, j, sum(c) AS s, count(*) AS n FROM x JOIN a{i} USING (r, p) GROUP BY p, e, j),
e{i + 1} AS MATERIALIZED (SELECT p, e, j, CASE WHEN n IS NULL THEN c ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS c FROM e{i} LEFT JOIN m{i} USING (p, e, j))""")
    return ",".join(steps) + f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
    (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) FROM e{rounds}) AS codebooks_sha256
FROM k JOIN (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r) USING (r)
"""


@query(_codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_name(books)).alias("codebooks_sha256"))


@query("""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END)
        || (CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
    FROM f LEFT JOIN marks USING (doc_id) GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
s AS (SELECT filter_order, i AS step, filter_order[i] AS filter, filter_order[:i - 1] AS before FROM o, range(1, 6) AS u(i)),
k AS (SELECT part, filter_order, step, filter, n, n_good, n_toxic, fails, contains(fails, filter) AS f,
        len(regexp_replace(before, '[^' || CASE WHEN fails = '' THEN '-' ELSE fails END || ']', '', 'g')) > 0 AS earlier FROM m, s),
c AS (SELECT part, filter_order, step, any_value(filter) AS filter, coalesce(sum(n) FILTER (NOT f AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (f AND NOT earlier), 0) AS removed,
        coalesce(sum(n) FILTER (f AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (fails = filter), 0) AS unique_fails,
        coalesce(sum(n_good) FILTER (f AND NOT earlier), 0) AS good_lost, coalesce(sum(n_toxic) FILTER (f AND NOT earlier), 0) AS toxic_lost FROM k GROUP BY 1, 2, 3)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM c
""")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.masks(table(spark, sf_dir, "documents"))
    return filter_audit.audit(masks, table(spark, sf_dir, "labels"))
