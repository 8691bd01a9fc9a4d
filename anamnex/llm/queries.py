"""Queries of this subpackage and, where SQL can express them, the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, infill, jaccard, licenses, merkle, neardup, packing, pii, quality, toxicity, wordpiece
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpiece.token_counts(docs, tokenizer("word_bpe_49k.json")).select("doc_id", "n_words", "n_tokens")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), most=1024)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.default_templates(spark))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = bpe.round_trip(docs, tokenizer("byte_bpe_50k.json"))
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"), least=0.8)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest(chat.format_turns(chat.turn_rows(rows)))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.checked(docs, merkle.leaf(*(F.when(tampered, merkle.lower_ascii(F.col(c))).otherwise(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS)))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=1))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_removed")


QUERIES = {f.__name__: f for f in (
    op1_nearest_neighbours, op2_token_counts, op3_embedding_near_dedup, op4_toxicity, op5_best_fit_packing,
    op6_license_scan, op7_pii, op8_bpe, op9_ngram_jaccard_join, op10_chat_formatting,
    op11_merkle_manifest, op12_fill_in_middle, op13_quality_rules,
)}

#: Levels of 16 that the SQL below unrolls: trees of up to 16 ** LEVELS leaves.
LEVELS = 5


def merkle_sql() -> str:
    """The manifest as SQL, its levels one after another."""
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    steps = [
        f"rows AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf('text')} AS d, CASE WHEN {crc} % 5 = 0 THEN {leaf('translate(text, $$ABCDEFGHIJKLMNOPQRSTUVWXYZ$$, $$abcdefghijklmnopqrstuvwxyz$$)')} ELSE {leaf('text')} END AS found FROM documents)",
        "s0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM rows)",
        "s_p0 AS (SELECT tree, i AS leaf_i, i, '' AS proof, found AS folded FROM s0)",
        *unrolled("s"),
        "f0 AS (SELECT '' AS tree, tree AS of, d, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM s_top)",
        "f_p0 AS (SELECT tree, i AS leaf_i, i, '' AS proof, d AS folded FROM f0)",
        *unrolled("f"),
    ]
    fold = "p.folded"
    last = f"SELECT tree, leaf_i, proof, folded FROM s_p{LEVELS}"
    for k in range(LEVELS):  # the forest's levels, from the source's folded root
        steps.append(f"u{k} AS (SELECT c.leaf_i, c.k, c.l, c.r FROM f_sides c WHERE c.k = {k})")
        last = f"SELECT p.tree, p.leaf_i, p.proof || coalesce(u.l || u.r, '') AS proof, CASE WHEN u.k IS NULL THEN {fold} ELSE sha256(u.l || {fold} || u.r) END AS folded FROM ({last}) p JOIN f0 ON f0.of = p.tree LEFT JOIN u{k} u ON u.leaf_i = f0.i"
    return (
        f"WITH {', '.join(steps)}, folds AS ({last}) SELECT s0.doc_id, s0.d AS leaf, s_top.d AS subroot, f_top.d AS root, sha256(folds.proof) AS proof_sha256, folds.folded AS folded_root, folds.folded = f_top.d AS verified "
        "FROM s0 JOIN s_top ON s_top.tree = s0.tree JOIN folds ON folds.tree = s0.tree AND folds.leaf_i = s0.i CROSS JOIN f_top"
    )


def unrolled(t: str) -> list[str]:
    """Levels of the trees in {t}0: their runs {t}_g, roots {t}_top, paths {t}_p and sides of each leaf {t}_sides."""
    out, tops, sides = [], [f"SELECT tree, d FROM {t}0 WHERE n = 1"], []
    for k in range(LEVELS):
        out.append(f"{t}_g{k} AS (SELECT tree, i // 16 AS i, any_value(n) AS n, list(d ORDER BY i) AS ds FROM {t}{k} WHERE n > 1 GROUP BY tree, i // 16)")
        out.append(f"{t}{k + 1} AS (SELECT tree, i, (n + 15) // 16 AS n, sha256(array_to_string(ds, '')) AS d FROM {t}_g{k})")
        tops.append(f"SELECT tree, d FROM {t}{k + 1} WHERE n = 1")
        out.append(f"{t}_q{k} AS (SELECT p.*, coalesce(array_to_string(g.ds[1:p.i % 16], ''), '') AS l, coalesce(array_to_string(g.ds[p.i % 16 + 2:], ''), '') AS r, g.i IS NOT NULL AS more FROM {t}_p{k} p LEFT JOIN {t}_g{k} g ON g.tree = p.tree AND g.i = p.i // 16)")
        out.append(f"{t}_p{k + 1} AS (SELECT tree, leaf_i, i // 16 AS i, CASE WHEN more THEN proof || l || r ELSE proof END AS proof, CASE WHEN more THEN sha256(l || folded || r) ELSE folded END AS folded FROM {t}_q{k})")
        sides.append(f"SELECT leaf_i, {k} AS k, l, r FROM {t}_q{k} WHERE more")
    return [*out, f"{t}_top AS ({' UNION ALL '.join(tops)})", f"{t}_sides AS ({' UNION ALL '.join(sides)})"]


ORACLE_SQL: dict[str, str] = {
    "op10_chat_formatting": """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
    + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')) + 17 AS n
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""",
    "op11_merkle_manifest": merkle_sql(),
    "op12_fill_in_middle": """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM cut
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m, coalesce(array_to_string(units[b + 1:], ''), '') AS s
  FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
""",
    "op13_quality_rules": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM documents
), counted AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs
), windows AS (
  SELECT r, i, md5(array_to_string(words[i:i + 7], ' ')) AS w FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM counted WHERE len(words) >= 8)
), again AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1
), repeats AS (
  SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS pos FROM again) GROUP BY r
), lines AS (
  SELECT r, host, md5(text) AS document, regexp_replace(lower(array_to_string(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), ' ')), '[0-9]+', '0', 'g') AS line, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT r, host, text, unnest(lines) AS x FROM counted)
), hosts AS (
  SELECT host, count(DISTINCT md5(text)) AS size FROM docs GROUP BY host
), above AS (
  SELECT host, line FROM lines JOIN hosts USING (host) GROUP BY host, line, size HAVING count(DISTINCT document) > 10 AND count(DISTINCT document) * 100 > size
), removed AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS gone FROM lines JOIN above USING (host, line) GROUP BY r
), judged AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(repeats.n, 0) AS n_repeat_words, coalesce(gone, 0) AS words_removed
  FROM counted LEFT JOIN repeats USING (r) LEFT JOIN removed USING (r)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (words_removed > 0 AND (n_words - words_removed < 20 OR 2 * (n_words - words_removed) < n_words)) AS kept
FROM judged
""",
}
