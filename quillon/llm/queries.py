"""The llm queries and, where SQL expresses them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, collocation, curve, merkle, mtree, ngram_join, packing, pii, quality, sharding, sp_suffix, token_files, windows

SECRET = "for the synthetic tables alone"


def secret(spark: SparkSession) -> str:
    """The key of the surrogates: spark.quillon.surrogates.secret, which real data must set."""
    return spark.conf.get("spark.quillon.surrogates.secret", SECRET)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.document_audio(_docs(spark, sf_dir))


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_docs(spark, sf_dir))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.repeated_passages(_docs(spark, sf_dir))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_docs(spark, sf_dir), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


def op6_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = mtree.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return mtree.top_k(v, v.where("vec_id % 100 = 0"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(_docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), ranks=tokenizer_path("byte_bpe_50k.tiktoken")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    out = sp_suffix.decode_ids(sp_suffix.encode_documents(_docs(spark, sf_dir), model), model)
    return out.select("doc_id", F.size("ids").alias("n_ids"), "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_private(_docs(spark, sf_dir), secret(spark)).select("doc_id", "text", F.size("entities").alias("n_entities"), F.concat_ws(",", F.array_sort(F.array_distinct("entities.kind"))).alias("kinds"))


def op10_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = curve.curve_pieces(_docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), ranks=tokenizer_path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_docs(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(_docs(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_audio_features, op2_sum_of_squares_packing, op3_histogram_shards, op4_repeated_passages, op5_ngram_jaccard, op6_mtree_top_k, op7_token_files, op8_sentencepiece, op9_surrogates, op10_bradley_terry, op11_hilbert_packing, op12_merkle_manifest, op13_collocations, pipeline)
}


def _merkle_sql(levels: int = 8) -> str:
    """16**levels leaves a source and as many sources at most. A level's only node is passed on as it is."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda t: "sha256(" + " || ".join([*map(value, ("doc_id", "source", "lang", "n_chars")), value(t)]) + ")"
    bit = "lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {bit})), 4294967295::BIGINT)"

    def tree(name: str, group: str, table: str) -> list[str]:
        """name0 to name{levels}: nodes of each level; name: each leaf's siblings, level by level."""
        out, by = [f"{name}0 AS (SELECT {group} AS g, i, d, count(*) OVER (PARTITION BY {group}) AS n FROM {table})"], "PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
        for k in range(levels):
            out.append(f"{name}{k}s AS (SELECT g, i, n, coalesce(string_agg(d, '') OVER ({by} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(d, '') OVER ({by} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z FROM {name}{k})")
            out.append(f"{name}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (any_value(n) + 15) // 16 AS n FROM {name}{k} GROUP BY g, i // 16)")
        joins = " ".join(f"JOIN {name}{k}s s{k} ON s{k}.g IS NOT DISTINCT FROM l.g AND s{k}.i = l.i // {16**k}" for k in range(levels))
        sides = ", ".join(f"{{'n': s{k}.n, 'a': s{k}.a, 'z': s{k}.z}}" for k in range(levels))
        return [*out, f"{name} AS (SELECT l.g, l.i, [{sides}] AS sides FROM {name}0 l {joins})"]

    folded = "list_reduce(list_prepend({'n': 0::BIGINT, 'a': t, 'z': ''}, list_filter(sides, lambda s: s.n > 1)), lambda f, s: {'n': 0::BIGINT, 'a': sha256(s.a || f.a || s.z), 'z': ''}).a"
    return f"""
WITH h AS (SELECT doc_id, source, {leaf("text")} AS d, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(text)} ELSE {leaf("text")} END AS t FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM h),
{", ".join(tree("v", "source", "l"))},
r AS (SELECT g AS source, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i FROM v{levels}),
{", ".join(tree("w", "0", "r"))},
o AS (SELECT l.doc_id, l.d, l.t, r.d AS subroot, list_concat(v.sides, w.sides) AS sides
      FROM l JOIN v ON v.g IS NOT DISTINCT FROM l.source AND v.i = l.i JOIN r ON r.source IS NOT DISTINCT FROM l.source JOIN w ON w.i = r.i),
q AS (SELECT *, (SELECT d FROM w{levels}) AS root, {folded} AS f FROM o)
SELECT doc_id, d AS leaf, subroot, root, sha256(list_reduce(list_prepend('', list_transform(sides, lambda s: s.a || s.z)), lambda x, y: x || y)) AS proof_sha256, f AS folded_root, f = root AS verified FROM q"""


ORACLE_SQL: dict[str, str] = {
    "op5_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 90 * (na + nb - k)),
r AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, m.c AS component_id FROM s JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = s.doc_id""",
    "op6_mtree_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op13_collocations": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT row_number() OVER () AS p, lang, list_filter(regexp_split_to_array(t, '[\x20\x09]+'), lambda x: x <> '') AS w
      FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
s AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
      FROM (SELECT p, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM p) WINDOW o AS (PARTITION BY p ORDER BY i)),
g AS (SELECT lang, k, CASE k WHEN 1 THEN w1 WHEN 2 THEN w1 || ' ' || w2 WHEN 3 THEN w1 || ' ' || w2 || ' ' || w3 ELSE w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 END AS phrase
      FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE phrase IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
x AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
      FROM c, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
u AS (SELECT c.* FROM c LEFT JOIN x ON x.lang = c.lang AND x.phrase = c.phrase WHERE x.longer IS NULL OR 100::HUGEINT * x.longer < 80::HUGEINT * c.a),
q AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM u),
v AS (SELECT q.lang, q.phrase, q.a, l.a AS l, r.a AS r, (2000000::HUGEINT * q.a // (l.a + r.a))::BIGINT AS score, cut
      FROM q JOIN f l ON l.lang = q.lang AND l.phrase = array_to_string(q.w[1 : cut], ' ') JOIN f r ON r.lang = q.lang AND r.phrase = array_to_string(q.w[cut + 1 :], ' ')),
y AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y)
SELECT z.lang, z.rank, z.phrase, z.a, z.l, z.r, n.n, z.score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000""",
    "op12_merkle_manifest": _merkle_sql(),
}
