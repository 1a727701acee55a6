"""Registered queries of the text operators and their DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitrisk.llm import (chat, convrepair, decontam, hardnegatives, licenses, mixing, neighbourgraph, quality, simhash, tokencounts, tokenfile, urlmodel, warc)
from transitrisk.llm.common import ALNUM_WORD_RE, SPACED_WORD_RE, table

CONTROL_TURN = "</s>[INST] ok [/INST]"


def op1_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix-target examples of all conversations, read back from the formatted turns."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(CONTROL_TURN).alias("text"))
    return chat.conversation_digest(chat.write_examples(given.unionByName(extra)))


def op2_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of the whole text."""
    return (tokencounts.attribute_tokens(table(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), "section", "char_start", "char_end",
                    F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing"))


def op3_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlmodel.judge_urls(table(spark, sf_dir, "pages"))


def op4_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = tokenfile.write_tokens(table(spark, sf_dir, "documents"))
    return tokenfile.read_tokens(segments).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (quality.clean_documents(table(spark, sf_dir, "documents"), keep=("doc_id",), with_text=False)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines",
                    "n_words_left", "base_failed", "kept"))


def op7_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
            .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"))


def op8_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.per_row(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response, read back from the records."""
    return warc.read_index(warc.build_derivatives(table(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")


def op10_simhash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (simhash.near_duplicates(table(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), "fingerprint", "component_id"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector, labels of every 7th moved on by one."""
    given = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    found = hardnegatives.mine(given.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every 20th one."""
    return neighbourgraph.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation after damage."""
    given = table(spark, sf_dir, "conversations")
    found = convrepair.repair_report(convrepair.damage(given)).withColumnRenamed("conv_id", "__conv")
    asked = given.groupBy("conv_id").agg(F.lit(True).alias("__asked"))
    counts = [c for c, kind in found.dtypes if kind == "bigint" and c != "__conv"]
    return (asked.join(found, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
            .select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_chat_prefixes, op2_token_attribution, op3_url_model, op4_license_diagonals, op5_token_file, op6_line_cleaning,
    op7_positional_index, op8_cube_mixing, op9_warc_derivatives, op10_simhash_ring, op11_hard_negatives, op12_neighbour_graph,
    op13_conversation_repair, pipeline)}


def _escaped(c: str) -> str:
    c = f"replace({c}, '\\', '\\\\')"
    for control in chat.CONTROLS:
        c = f"replace({c}, '{control}', '{control[0]}\\{control[1:]}')"
    return c


def _op1_sql() -> str:
    marks = len(chat.TURN + chat.TEXT + chat.END)
    return rf"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{CONTROL_TURN}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TURN}'),
    g AS (
      SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum({marks} + length({_escaped('role')}) + length({_escaped('text')})) AS formatted_chars,
        count(*) FILTER (role = 'assistant') AS n_examples
      FROM t GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
      formatted_chars::BIGINT AS formatted_chars, n_examples FROM g"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op4_sql() -> str:
    templates = [(t, x, True) for t, x in licenses.PHRASES] + [(t, x, False) for t, x in licenses.NOTICES]
    rows = ", ".join(f"({i}, '{x}', {str(b).lower()}, string_split('{t}', ' '))" for i, (t, x, b) in enumerate(templates))
    k = licenses.K
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{ALNUM_WORD_RE}') AS words FROM documents),
    t(tid, label, base, words) AS (VALUES {rows}),
    tg AS (SELECT tid, label, base, len(words) AS len, p - 1 AS tpos, array_to_string(words[p:p + {k - 1}], ' ') AS g
           FROM (SELECT *, unnest(range(1, len(words) - {k - 2})) AS p FROM t)),
    dg AS (SELECT * FROM (SELECT rid, i - 1 AS pos, array_to_string(words[i:i + {k - 1}], ' ') AS g
             FROM (SELECT rid, words, unnest(range(1, len(words) - {k - 2})) AS i FROM d WHERE len(words) >= {k}))
           WHERE g IN (SELECT g FROM tg)),
    v AS (SELECT rid, tid, label, base, len, pos, tpos, pos - tpos AS diagonal FROM dg JOIN tg USING (g)),
    dia AS (SELECT rid, tid, label, base, len, diagonal, count(DISTINCT tpos) AS votes, min(pos) AS lo, max(pos) AS hi
            FROM v GROUP BY ALL),
    runs AS (SELECT rid, tid, diagonal, lo, hi, sum(fresh) OVER (PARTITION BY rid, tid ORDER BY diagonal) AS copy
             FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, tid ORDER BY diagonal) <= {licenses.GAP}
                              THEN 0 ELSE 1 END AS fresh FROM dia WHERE NOT base)),
    spans AS (SELECT rid, tid, copy, min(lo) AS first, max(hi) + {k} AS stop FROM runs GROUP BY ALL),
    cover AS (SELECT rid, tid, copy, label, len, count(DISTINCT tpos + j) AS covered
              FROM v JOIN runs USING (rid, tid, diagonal), range({k}) AS r(j) GROUP BY ALL),
    found AS (
      SELECT rid, label, true AS base, diagonal AS first, 1.0 AS coverage FROM dia WHERE base AND votes = len - {k - 1}
      UNION ALL
      SELECT rid, label, false, first, covered / len FROM cover JOIN spans USING (rid, tid, copy)
      WHERE covered / len >= {licenses.MIN_COVERAGE} AND stop - first <= {licenses.MAX_STRETCH} * len),
    r AS (SELECT rid, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
            string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM found GROUP BY rid)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
      last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
      coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN r USING (rid)"""


def _op6_sql() -> str:
    def chars(column, letters):
        return " + ".join(f"(length({column}) - length(replace({column}, '{c}', '')))" for c in letters)
    words = rf"regexp_extract_all({{}}, '{SPACED_WORD_RE}')"
    # every sign that is no letter, digit or underscore is doubled, so that neighbouring phrases need not share one
    phrase = "|".join(p.replace(" ", "  ") for p in quality.BOILERPLATE)
    theirs = (r"array_to_string(regexp_extract_all(regexp_replace(low, '([^\pL\pN_])', '\1\1', 'g'), "
              rf"'(?:^|[^\pL\pN_])({phrase})(?:$|[^\pL\pN_])', 1), ' ')")
    others = re.sub(r"\\u([0-9A-F]{4})|\\U([0-9A-F]{8})", lambda m: rf"\x{{{m[1] or m[2]}}}", quality.OTHER_SENTENCE_MARKS)
    marks = f"regexp_matches(line, '[{re.escape(quality.SENTENCE_MARKS)}{others}]')"
    w = quality.WINDOW_WORDS
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    d2 AS (SELECT rid, doc_id, text, {words.format('text')} AS words FROM d),
    lines AS (SELECT rid, line, len({words.format('line')}) AS n,
                translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
              FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
    judged AS (SELECT rid, line, n, coalesce(n > 0 AND (
                 (({chars('line', quality.SEPARATORS)}) >= 3 AND 4 * ({chars('line', quality.SEPARATORS)}) >= n)
                 OR (n >= 3 AND (({chars('line', quality.SYMBOLS)}) >= n OR ({chars('line', '!')}) >= n))
                 OR (n >= 10 AND NOT {marks})
                 OR (n_phrase > 0 AND {quality.LINE_WORDS_A_PHRASE_WORD} * n_phrase >= n)), false) AS bad
               FROM (SELECT *, len(regexp_extract_all({theirs}, '[^ ]+')) AS n_phrase FROM lines)),
    l AS (SELECT rid, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
            count(*) FILTER (bad) AS n_bad_lines, coalesce(sum(n) FILTER (NOT bad), 0) AS n_words_left
          FROM judged GROUP BY rid),
    wins AS (SELECT rid, i, array_to_string(words[i:i + {w - 1}], ' ') AS win
             FROM (SELECT rid, words, unnest(range(1, len(words) - {w - 2})) AS i FROM d2 WHERE len(words) > {w})),
    twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM wins) WHERE c > 1),
    rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, range({w}) AS r(k) GROUP BY rid),
    m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
            {chars('text', quality.SYMBOLS)} AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
            n_bad_lines, n_words_left
          FROM d2 JOIN l USING (rid) LEFT JOIN rep USING (rid)),
    b AS (SELECT *, n_words < {quality.MIN_WORDS}
            OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
      n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, n_bad_lines::BIGINT AS n_bad_lines,
      n_words_left::BIGINT AS n_words_left, base_failed,
      NOT base_failed AND 100 * n_words_left >= {quality.MIN_LEFT_PERCENT} * n_words AS kept FROM b"""


def _op7_sql() -> str:
    n = decontam.WINDOW_WORDS
    words = rf"regexp_extract_all({_LOWER}, '{ALNUM_WORD_RE}')"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS words FROM documents),
    b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS words FROM benchmark),
    bw AS (SELECT DISTINCT item, least(len(words), {n}) AS len, array_to_string(words[i:i + {n - 1}], ' ') AS win
           FROM (SELECT item, words, unnest(range(1, greatest(len(words) - {n - 2}, 2))) AS i FROM b WHERE len(words) > 0)),
    dw AS (SELECT rid, i, len, array_to_string(words[i:i + len - 1], ' ') AS win
           FROM (SELECT rid, words, len, unnest(range(1, len(words) - len + 2)) AS i
                 FROM d, (SELECT DISTINCT len FROM bw) WHERE len(words) >= len)),
    hit AS (SELECT DISTINCT rid, i, dw.len AS len, item FROM dw JOIN bw ON dw.win = bw.win AND dw.len = bw.len),
    marked AS (SELECT rid, count(DISTINCT w) AS n_hit
               FROM (SELECT rid, unnest(range(i, i + len)) AS w FROM hit) GROUP BY rid),
    items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid),
    terms AS (SELECT DISTINCT win, len, k - 1 AS off, split_part(win, ' ', k) AS term
              FROM (SELECT DISTINCT win, len, unnest(range(1, len + 1)) AS k FROM bw)),
    posts AS (SELECT rid, i - 1 AS pos, words[i] AS term FROM (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM d)
              WHERE words[i] IN (SELECT term FROM terms)),
    counts AS (SELECT term, count(*) AS n FROM posts GROUP BY term),
    ranked AS (SELECT win, len, off, term,
                 row_number() OVER (PARTITION BY win, len ORDER BY coalesce(n, 0), off) AS r,
                 ceil(len * {decontam.NEAR_PERCENT} / 100.0) AS least
               FROM terms LEFT JOIN counts USING (term)),
    places AS (SELECT rid, win, len, off, pos, least FROM posts JOIN ranked USING (term) WHERE r <= len - least + 1),
    near AS (SELECT rid, count(DISTINCT (win, len)) AS n_near FROM (
               SELECT a.rid, a.win, a.len FROM places a JOIN terms t ON t.win = a.win AND t.len = a.len
                 JOIN posts p ON p.rid = a.rid AND p.term = t.term AND p.pos - a.pos BETWEEN {1 - n} AND {n - 1}
                   AND p.pos - a.pos - (t.off - a.off) BETWEEN -{decontam.SLOP} AND {decontam.SLOP}
               GROUP BY a.rid, a.win, a.len, a.off, a.pos, a.least HAVING count(DISTINCT t.off) >= a.least) GROUP BY rid)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(items, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated,
      coalesce(n_near, 0)::BIGINT AS n_near
    FROM d LEFT JOIN marked USING (rid) LEFT JOIN items USING (rid) LEFT JOIN near USING (rid)"""


def _op11_sql() -> str:
    h = hardnegatives
    return f"""
    WITH v AS (
      SELECT row_number() OVER () AS no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor({h.SCALE} * x::DOUBLE)) AS q
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
    s AS (
      SELECT a.no AS a_no, a.vec_id AS anchor_id, a.label AS a_label, b.no AS b_no, b.vec_id AS b_id, b.label AS b_label,
        list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.no <> b.no WHERE a.vec_id % 50 = 0),
    p AS (SELECT a_no, anchor_id, b_no, b_id AS positive_id, score AS positive_score FROM s WHERE a_label = b_label
          QUALIFY row_number() OVER (PARTITION BY a_no ORDER BY score DESC, b_id NULLS LAST, b_no) <= {h.POSITIVES})
    SELECT p.anchor_id, positive_id,
      (row_number() OVER (PARTITION BY p.a_no, p.b_no ORDER BY score DESC, s.b_id NULLS LAST, s.b_no))::INTEGER AS rank,
      s.b_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.a_no = p.a_no AND s.a_label <> s.b_label
      AND {h.LOW_PERCENT} * positive_score <= 100 * score AND 100 * score <= {h.HIGH_PERCENT} * positive_score
    QUALIFY row_number() OVER (PARTITION BY p.a_no, p.b_no ORDER BY score DESC, s.b_id NULLS LAST, s.b_no) <= {h.NEGATIVES}"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_prefixes": _op1_sql(), "op4_license_diagonals": _op4_sql(), "op6_line_cleaning": _op6_sql(), "op7_positional_index": _op7_sql(),
            "op11_hard_negatives": _op11_sql()}
