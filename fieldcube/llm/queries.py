"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldcube.llm import exact_dedup, fill_middle, html_text, mixing, ngram_join, packing, pii, resharding, sstable, syncmers, token_counts, toxicity, turn_repair


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(_read(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_read(spark, sf_dir, "documents"), shingle=3, percent=90)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score_table(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_read(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_sections(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_edited(_read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_read(spark, sf_dir, "documents")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations")
    return turn_repair.digest(turn_repair.damage(turns), turns)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.transform(_read(spark, sf_dir, "documents")))


def op13_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.shard_table(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_toxicity": op3_toxicity,
    "op4_html_text": op4_html_text,
    "op5_token_counts": op5_token_counts,
    "op6_token_shards": op6_token_shards,
    "op7_syncmers": op7_syncmers,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
    "op11_turn_repair": op11_turn_repair,
    "op12_fill_middle": op12_fill_middle,
    "op13_resharding": op13_resharding,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op2_ngram_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0),
        shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 3 THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] ELSE array_to_string(w, ' ') END AS item FROM places),
        items AS (SELECT doc_id, item, count(*) OVER (PARTITION BY doc_id) AS n FROM shingles),
        sets AS (SELECT doc_id, any_value(array_to_string(w, ' ')) AS seq, count(item) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        reached AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x)
        SELECT doc_id, n AS n_shingles, CASE WHEN n > 0 THEN min(doc_id) OVER (PARTITION BY seq) ELSE doc_id END AS class_id,
               (SELECT min(y) FROM reached r WHERE r.x = sets.doc_id) AS component_id
        FROM sets""",
    "op11_turn_repair": r"""
        WITH RECURSIVE coded AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        summed AS (  -- crc32 of k: each byte, then eight shifts
            SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(k, '')])),
                      lambda x, b: CASE WHEN b >= 0 THEN xor(x, b) ELSE xor(x >> 1, (x & 1) * 3988292384) END), 4294967295) % 20 AS fault FROM coded),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM summed, range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i FROM damaged),
        seen AS (
            SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
                   lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM placed),
        rows AS (
            SELECT *, blank OR again AS gone, CASE WHEN NOT blank AND NOT again AND cut THEN 3 ELSE 0 END AS dear, count(*) OVER (PARTITION BY conv_id) AS n FROM seen),
        facts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (dear > 0) AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
        rules(x, l, y) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
        added(x, letters, y, cost) AS (
            SELECT x, '', x, 0 FROM range(4) t(x) UNION ALL SELECT x, 'I', y, 3 FROM rules WHERE l <> 's'
            UNION ALL SELECT a.x, 'II', b.y, 6 FROM rules a JOIN rules b ON a.y = b.x WHERE a.l <> 's' AND b.l <> 's'),
        paths AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS x, 0::BIGINT AS cost, '' AS audit FROM rows
            UNION ALL
            SELECT conv_id, i, x, cost, audit FROM (
                SELECT p.conv_id, r.i, e.y AS x, p.cost + a.cost + e.cost + CASE WHEN e.letter = 'D' THEN 0 ELSE r.dear END AS cost, p.audit || a.letters || e.letter AS audit,
                       row_number() OVER (PARTITION BY p.conv_id, e.y ORDER BY p.cost + a.cost + e.cost + CASE WHEN e.letter = 'D' THEN 0 ELSE r.dear END, p.audit || a.letters || e.letter) AS best
                FROM paths p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 JOIN added a ON a.x = p.x
                JOIN (SELECT x, 'K' AS letter, l, y, 0 AS cost FROM rules UNION ALL SELECT x, 'R', NULL, y, 3 FROM rules WHERE l <> 's' UNION ALL SELECT x, 'D', NULL, x, 4 FROM range(4) t(x)) e
                  ON e.x = a.y AND (e.letter = 'D' OR NOT r.gone) AND (e.letter <> 'K' OR e.l = substr(r.role, 1, 1)))
            WHERE best = 1),
        ended AS (
            SELECT p.conv_id, p.cost + a.cost AS cost, p.audit || a.letters AS audit
            FROM paths p JOIN (SELECT conv_id, max(i) AS n FROM rows GROUP BY conv_id) q ON p.conv_id IS NOT DISTINCT FROM q.conv_id AND p.i = q.n JOIN added a ON a.x = p.x AND a.y IN (0, 3)
            QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + a.cost, p.audit || a.letters) = 1),
        letters AS (
            SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS k FROM ended),
        counted AS (
            SELECT *, sum((letter <> 'I')::INT) OVER w AS i, sum((letter <> 'D')::INT) OVER w AS m, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id) AS total
            FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
        lines AS (  -- letters fix the roles: user and assistant in turn, after a system row if their number is odd
            SELECT c.conv_id, c.k, CASE WHEN letter = 'K' THEN r.role WHEN (m + total) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE r.text END AS line
            FROM counted c LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.i WHERE letter <> 'D'),
        repaired AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS sha FROM lines GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON o.conv_id IS NOT DISTINCT FROM f.conv_id
        LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id""",
    "op12_fill_middle": r"""
        WITH h AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
        u AS (
            SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines, [('0x' || substr(s, 8 * i - 7, 8))::BIGINT FOR i IN range(1, 5)] AS h FROM h),
        c AS (
            SELECT doc_id, t, lines, len(lines) AS n, least(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS a, greatest(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM u),
        p AS (
            SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:n], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p""",
}
