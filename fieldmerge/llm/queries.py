"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmerge.llm import bpe, chats, dedup, katz, packing, phrases, pii, runs, secrets, simhash, syncmers, toxicity, urls
from fieldmerge.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ADDED = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, ADDED)
    return found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.collapse_and_render(table(spark, sf_dir, "conversations"))


def op7_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edits(table(spark, sf_dir, "documents"))


def _digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans spelled out."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in kinds]
    return found.select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))


def op1_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _digest(pii.find_personal_data(docs, pii.silver_lines(docs)), pii.KINDS)


def op9_zstd_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _digest(secrets.find_secrets(docs, known=secrets.learnt_identifiers(docs)), secrets.KINDS[:3])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(runs.with_periodic_tails(table(spark, sf_dir, "documents")))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.train(urls.labelled_urls(spark)))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_counterfactual_toxicity,
        op2_katz_backoff,
        op3_bpe_round_trip,
        op4_exact_dedup,
        op5_snapshot_collapse,
        op6_crf_personal_data,
        op7_closed_syncmers,
        op8_best_fit_packing,
        op9_zstd_secrets,
        op10_simhash_near_dedup,
        op11_periodic_runs,
        op12_url_filter,
        op13_phrase_collocations,
    )
}
ORACLES = {
    "op5_snapshot_collapse": """
        WITH t AS (
          SELECT DISTINCT conv_id, CASE WHEN conv_id IS NULL THEN concat_ws('|', turn, role, text) END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
        s AS (
          SELECT conv_id, own, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS told,
                 row_number() OVER (PARTITION BY conv_id, own ORDER BY turn, role, text) AS n, count(*) OVER (PARTITION BY conv_id, own) AS size
          FROM t),
        p AS (
          SELECT conv_id, n, size, string_agg(told, '') OVER (PARTITION BY conv_id, own ORDER BY n ROWS UNBOUNDED PRECEDING) AS prefix FROM s),
        w AS (
          SELECT min(conv_id) AS conv_id, CAST(max(size) AS BIGINT) AS n_turns, count(*) AS n_copies, prefix AS rendered FROM p WHERE n = size GROUP BY prefix)
        SELECT conv_id, n_turns, n_copies, rendered FROM w
        WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n < p.size AND p.prefix = w.rendered)
    """,
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op13_phrase_collocations": """
        WITH t AS (
          SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
                 string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
          FROM documents),
        p AS (SELECT lang, [x FOR x IN string_split_regex(u.piece, '[ \x09]+') IF x <> ''] AS w FROM (SELECT lang, unnest(pieces) AS piece FROM t) u),
        g AS (
          SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
          FROM (SELECT lang, w, s.size, unnest(range(1, len(w) - s.size + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) s(size) WHERE len(w) >= s.size)),
        f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY lang, size, phrase),
        totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
        c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 30),
        cuts AS (
          SELECT c.lang, c.size, c.phrase, c.a, k, l.a AS l, r.a AS r, (CAST(c.a AS HUGEINT) * 2000000) // (CAST(l.a AS HUGEINT) + r.a) AS score
          FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c
          LEFT JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.k], ' ')
          LEFT JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ')),
        scored AS (
          SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cuts),
        longer AS (
          SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longest
          FROM (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c WHERE size > 2)) GROUP BY ALL),
        kept AS (
          SELECT s.* FROM scored s LEFT JOIN longer o USING (lang, phrase)
          WHERE s.nth = 1 AND coalesce(100 * CAST(o.longest AS HUGEINT) < 80 * CAST(s.a AS HUGEINT), true)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
}
