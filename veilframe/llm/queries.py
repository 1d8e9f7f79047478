"""The registered query of each operator: the operator over its whole table, and the digest columns asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import decontaminate, exact_dedup, lang_id, licenses, near_dup, packing, periodic_runs, pii, secrets, sharding, topk, toxicity, vector_codes
from veilframe.sources.tables import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizer files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _joined(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Spans, of some kinds, as kind:start:end joined by commas."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _span_columns(kinds: tuple[str, ...]) -> list[Column]:
    """Counts of the base kinds, the hash of the base spans, and all spans."""
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in kinds]
    return [*counts, F.sha2(_joined(spans, kinds), 256).alias("base_sha256"), _joined(spans).alias("spans")]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: fixed patterns, and random tokens by the test battery."""
    found = secrets.scan_secrets(_documents(spark, sf_dir))
    return found.select(F.col("doc.c0").alias("doc_id"), *_span_columns(secrets.BASE_KINDS))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.fit(docs)
    doc_id = F.col("doc.c0")
    return lang_id.identify(docs.select("doc_id", "text"), model).select(doc_id.alias("doc_id"), lang_id.held_out(doc_id).alias("held_out"), "lang_pred", "score")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, with its exact copies and verified links."""
    return near_dup.near_duplicates(_documents(spark, sf_dir)).drop("row")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: fixed patterns, and the conditional random field's spans."""
    found = pii.scan_personal(_documents(spark, sf_dir))
    return found.select(F.col("doc.c0").alias("doc_id"), *_span_columns(pii.KINDS))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and shard of every document, by its id."""
    return sharding.place(_documents(spark, sf_dir)).select(F.col("doc.c0").alias("doc_id"), "slot", "shard")


def files_of(documents: DataFrame) -> DataFrame:
    """Stand-in file tree: documents as files below their source and language, some named LICENSE."""
    folder = F.concat_ws("/", "source", "lang", F.concat(F.lit("p"), F.pmod("doc_id", F.lit(50)).cast("string")))
    path = (
        F.when(F.col("doc_id") % 97 == 0, F.concat_ws("/", "source", F.lit("LICENSE")))
        .when(F.col("doc_id") % 8 == 3, F.concat(folder, F.lit("/LICENSE")))
        .otherwise(F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    )
    return documents.select("doc_id", path.alias("path"), "text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licence of every document, as files of a tree."""
    files = files_of(table(spark, sf_dir, "documents"))
    found = licenses.scan_licenses(files)
    return found.select(F.col("doc.c0").alias("doc_id"), "path", "license", "score", "effective", "from_dir")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(_documents(spark, sf_dir), tokenizer_path())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, and the items they come from."""
    found = decontaminate.mark_contamination(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc.c0").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest_run",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from the labelled rows that are not held out."""
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    doc_id = F.col("doc.c0")
    return scored.select(
        doc_id.alias("doc_id"),
        toxicity.held_out(doc_id).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every vector whose id is divisible by 20, against all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code by member-resident Lloyd rounds, with its error and its label's."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    codebooks = vector_codes.fit(vectors)
    if codebooks is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = vector_codes.with_label_error(vector_codes.encode(vectors, codebooks), F.col("row.c2"))
    return coded.select(F.col("row.c0").alias("vec_id"), "code", "error", "label_error", F.lit(codebooks.sha256()).alias("codebooks_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document's text without white space, and whether it stays."""
    found = exact_dedup.exact_duplicates(_documents(spark, sf_dir))
    return found.select(F.col("doc.c0").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of repeating words of every document, a tenth of them rewritten to periodic ones, and digests of all."""
    found = periodic_runs.collapse_runs(_documents(spark, sf_dir), rewrite=F.crc32(F.col("doc_id").cast("string")), digest=True)
    return found.select(
        F.col("doc.c0").alias("doc_id"), "n_runs", "start", "length", "period", "exponent_milli",
        F.col("runs").alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_personal_data": op4_personal_data,
    "op5_sharding": op5_sharding,
    "op6_license_scan": op6_license_scan,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_topk": op10_topk,
    "op11_vector_codes": op11_vector_codes,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds of op11, unrolled: assignment a<r> to the entries of c<r>, whose floored means are c<r+1>."""

    def assigned(r: int) -> str:
        away = "list_sum(list_transform(list_zip(p.part, c.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"""a{r} AS MATERIALIZED (
  SELECT p.id, pos, min(CAST({away} AS HUGEINT) * {entries} + c.entry) AS best FROM p JOIN c{r} c USING (pos) GROUP BY p.id, pos
)"""

    def moved(r: int) -> str:
        return f"""c{r + 1} AS MATERIALIZED (
  SELECT c.pos, c.entry, coalesce(m.part, c.part) AS part FROM c{r} c LEFT JOIN (
    SELECT pos, entry, list(CAST(floor(CAST(total AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS part FROM (
      SELECT pos, entry, i, sum(x) AS total, count(*) AS n FROM (
        SELECT a.pos, a.best % {entries} AS entry, unnest(p.part) AS x, unnest(range(len(p.part))) AS i FROM a{r} a JOIN p USING (id, pos)
      ) GROUP BY pos, entry, i
    ) GROUP BY pos, entry
  ) m USING (pos, entry)
)"""

    steps = ",\n".join(f"{assigned(r)},\n{moved(r)}" for r in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT id, pos, v[pos * len(v) // {parts} + 1 : (pos + 1) * len(v) // {parts}] AS part FROM kept, (SELECT unnest(range({parts})) AS pos)
), c0 AS (
  SELECT pos, id - 1 AS entry, part FROM p WHERE id <= {entries}
),
{steps},
{assigned(rounds)}, coded AS (
  SELECT vec_id, label, code, error FROM kept JOIN (
    SELECT id, string_agg(printf('%02x', CAST(best % {entries} AS INTEGER)), '' ORDER BY pos) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY id
  ) USING (id)
), flat AS (
  SELECT pos, entry, unnest(part) AS x, unnest(range(len(part))) AS i FROM c{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos, entry, i)) FROM flat) AS codebooks_sha256
FROM coded
"""


ORACLE_SQL = {
    "op11_vector_codes": _lloyd_sql(),
    "op12_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha FROM documents
)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
  doc_id = first_value(doc_id) OVER g AS kept, sha AS text_sha256
FROM t WINDOW g AS (PARTITION BY sha ORDER BY n DESC, doc_id)
""",
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(CASE WHEN len(q.e) = len(c.e) THEN list_dot_product(q.e, c.e) ELSE list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1] * z[2], 0))) END AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
""",
    "op8_decontamination": rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, w[p:p + least(len(w), 10) - 1] AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM item WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM windows
), places AS (
  SELECT doc_id, size, p, w[p:p + size - 1] AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM words, sizes WHERE len(w) >= size)
), found AS (
  SELECT doc_id, p, size, item_id FROM places JOIN windows USING (size, words)
), hits AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS place FROM found) GROUP BY doc_id
), runs AS (
  SELECT doc_id, max(n) AS longest_run FROM (
    SELECT doc_id, count(*) AS n FROM (
      SELECT doc_id, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run
      FROM (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS place FROM found)
    ) GROUP BY doc_id, run
  ) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN runs USING (doc_id)
""",
}
