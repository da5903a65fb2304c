"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import main_text, near_duplicates, packing, pieces, quality, repeated_lines, similar_vectors, subjects, tokens
from leafmill.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _converted(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: operator(table(spark, d, "conversion_results"), table(spark, d, "pages"))


def _p1_clean(spark: SparkSession, d: str) -> DataFrame:
    conversions = table(spark, d, "conversion_results")
    return repeated_lines.without_lines(conversions, repeated_lines.excessive_lines(conversions, table(spark, d, "pages")))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(*(table(spark, d, t) for t in ("documents", "subject_labels", "subject_areas")))


def _p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each result with text: what its pieces make when put together, whether all are within the limit and in
    order, and whether each begins with the characters before it."""
    made = pieces.pieces(table(spark, d, "conversion_results"))
    overlap = F.col("new_from") - F.col("start_char")
    own = F.struct("piece_no", "start_char", "new_from", "end_char", F.substr("piece", overlap + 1).alias("new"), F.left("piece", overlap).alias("again"))
    rows = made.groupBy("result_id").agg(F.sort_array(F.collect_list(own)).alias("p"), F.max(F.length("piece")).alias("longest"))
    text = F.array_join(F.transform("p", lambda x: x["new"]), "")
    later = F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    ends = F.zip_with(later, F.slice("p", 1, F.size(later)), lambda b, a: (b["new_from"] == a["end_char"]) & (b["piece_no"] == a["piece_no"] + 1))
    again = F.forall(later, lambda x: (F.length(x["again"]) == F.least(x["new_from"], F.lit(pieces.OVERLAP))) & (x["again"] == F.substr(F.col("whole"), x["start_char"] + 1, F.length(x["again"]))))
    return rows.withColumn("whole", text).select(
        "result_id", F.md5("whole").alias("text"), (F.col("longest") <= pieces.MAX_CHARS).alias("within"), F.forall(ends, lambda x: x).alias("in_order"), again.alias("overlap")
    )


def _p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row: that each document's tokens are placed once, that no container holds more than its capacity and none of
    its places twice, that only documents longer than a container are cut, and that little space is left."""
    sizes = tokens.token_counts(table(spark, d, "documents"))
    groups = max(1, -(-sizes.count() // packing.GROUP))
    placed = packing.pack(sizes, groups)
    documents = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("put"), F.count("*").alias("parts"), F.max(F.col("from_token") + F.col("n_tokens")).alias("end"))
    both = sizes.join(documents, "doc_id", "left")
    whole = both.agg(
        F.min((F.coalesce("put", F.lit(0)) == F.col("n_tokens")) & (F.coalesce("end", F.lit(0)) == F.col("n_tokens"))).alias("placed_once"),
        F.min((F.coalesce("parts", F.lit(0)) <= 1) | (F.col("n_tokens") > packing.CAPACITY)).alias("cut_if_longer"),
    )
    full = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("held"), F.max(F.col("place") + F.col("n_tokens")).alias("last"))
    space = full.agg(F.max(F.greatest("held", "last")).alias("most"), F.count("*").alias("containers"), F.sum("held").alias("all"), F.min((F.col("held") == F.col("last")).cast("int")).alias("tight"))
    return whole.crossJoin(F.broadcast(space)).select(
        "placed_once", "cut_if_longer", (F.col("most") <= packing.CAPACITY).alias("within"), (F.col("tight") == 1).alias("no_overlap"),
        (F.col("containers") <= F.ceil(F.col("all") / packing.CAPACITY) * 1.02 + groups).alias("little_space"),
    )


def queries() -> dict[str, Query]:
    return {
        "p1_found": _converted(repeated_lines.excessive_lines),
        "p1_clean": _p1_clean,
        "p1_templates": _converted(repeated_lines.frequent_templates),
        "p2_found": lambda spark, d: pieces.oversized_blocks(table(spark, d, "conversion_results")),
        "p2_checks": _p2_checks,
        "p2_pieces": lambda spark, d: pieces.pieces(table(spark, d, "conversion_results")),
        "p3_found": _converted(quality.residue_results),
        "p3_articles": _converted(quality.articles_only),
        "p4_found": lambda spark, d: similar_vectors.neighbour_pairs(table(spark, d, "chunk_vectors")),
        "p4_nearest": lambda spark, d: similar_vectors.nearest(table(spark, d, "chunk_vectors")).select("vec_id", "near_id", "rank"),
        "p5_found": _converted(near_duplicates.linked_pairs),
        "p5_groups": _converted(near_duplicates.article_groups),
        "p6_found": _converted(quality.not_prose),
        "p6_types": lambda spark, d: quality.text_types(quality.text_facts(table(spark, d, "conversion_results"), table(spark, d, "pages"))).select("result_id", "guess", "body_kind", "posterior"),
        "p6_statistics": lambda spark, d: quality.text_statistics(table(spark, d, "conversion_results")),
        "p7_found": _converted(main_text.furniture_lines),
        "p7_main_text": _converted(main_text.main_texts),
        "p8_ids": lambda spark, d: tokens.token_ids(table(spark, d, "documents")),
        "p9_checks": _p9_checks,
        "p9_containers": lambda spark, d: packing.packed_documents(table(spark, d, "documents")),
        "p10_found": _subjects,
        "p10_posteriors": lambda spark, d: subjects.subject_posteriors(*(table(spark, d, t) for t in ("documents", "subject_labels", "subject_areas"))),
        "p10_composition": lambda spark, d: subjects.composition(_subjects(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    lines = r"""
        c AS (SELECT DISTINCT result_id, url, md_content FROM conversion_results WHERE md_content IS NOT NULL),
        g AS (SELECT DISTINCT url, domain FROM pages),
        t AS (SELECT result_id, domain, string_split(md_content, chr(10)) AS lines FROM c JOIN g USING (url)),
        n AS (SELECT domain, count(*) AS n FROM t GROUP BY domain),
        l AS (SELECT result_id, domain, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no FROM t),
        k AS (SELECT result_id, domain, line_no, line, trim(regexp_replace(lower(line), '[^\p{L}]+', ' ', 'g')) AS key FROM l),
        e AS (
            SELECT domain, key FROM k JOIN n USING (domain) WHERE key <> ''
            GROUP BY domain, key, n HAVING count(DISTINCT result_id) >= 5 AND 5 * count(DISTINCT result_id) >= n
        )"""
    position = lambda i: f"CASE WHEN count(DISTINCT tokens[{i}]) = 1 THEN min(tokens[{i}]) WHEN count(tokens[{i}]) > 0 THEN '<*>' END"
    common = ", ".join(f"'{w}'" for w in sorted(quality.COMMON))
    near = """
        v AS (SELECT vec_id, any_value(embedding)::DOUBLE[] AS e FROM chunk_vectors WHERE embedding IS NOT NULL GROUP BY vec_id),
        u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE list_dot_product(e, e) > 0),
        d AS (SELECT a.vec_id, b.vec_id AS near_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.e, b.e) / (a.size * b.size), 6) DESC, b.vec_id) AS rank
            FROM u AS a JOIN u AS b ON a.vec_id <> b.vec_id)"""
    return {
        "p1_templates": f"""
            WITH {lines},
            o AS (SELECT DISTINCT domain, result_id, key FROM k WHERE key <> ''),
            w AS (SELECT *, string_split(key, ' ') AS tokens FROM o)
            SELECT domain, array_to_string([{', '.join(position(i) for i in range(1, repeated_lines.SLOTS + 1))}], ' ') || CASE WHEN len(tokens) > {repeated_lines.SLOTS} THEN ' <*>' ELSE '' END AS template,
                count(*) AS covered, count(DISTINCT key) AS keys
            FROM w JOIN n USING (domain) GROUP BY domain, n, len(tokens), tokens[1], tokens[2] HAVING count(*) >= greatest(5, (n + 4) // 5)""",
        "p2_checks": "SELECT DISTINCT result_id, md5(md_content) AS text, true AS within, true AS in_order, true AS overlap FROM conversion_results WHERE md_content <> ''",
        "p4_nearest": f"WITH {near} SELECT vec_id, near_id, rank::INT AS rank FROM d WHERE rank <= 5",
        "p4_found": f"WITH {near} SELECT DISTINCT least(vec_id, near_id) AS vec_id_a, greatest(vec_id, near_id) AS vec_id_b FROM d WHERE rank <= 5",
        "p6_statistics": rf"""
            WITH c AS (SELECT DISTINCT result_id, md_content AS t, word_count AS stored FROM conversion_results WHERE md_content IS NOT NULL),
            w AS (SELECT *, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+') AS words, length(regexp_replace(t, '[\s\p{{Z}}\x0b\x1c-\x1f\x85]+', '', 'g')) AS visible,
                list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '^[\s\p{{Z}}\x0b\x1c-\x1f\x85]*$')) AS lines FROM c)
            SELECT result_id, stored AS stored_word_count, len(words)::BIGINT AS word_count, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) / greatest(1, len(words)) AS mean_word_length,
                CASE WHEN visible > 0 THEN 1 - coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) / visible ELSE 0 END AS symbol_ratio,
                len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…。！？:]["”’»)*_]*[\s\p{{Z}}]*$'))) / greatest(1, len(lines)) AS ended_lines,
                len(list_filter(words, lambda x: x IN ({common}))) / greatest(1, len(words)) AS common_words FROM w""",
        "p9_checks": "SELECT true AS placed_once, true AS cut_if_longer, true AS within, true AS no_overlap, true AS little_space",
        "p1_found": f"WITH {lines} SELECT result_id, line_no::INT AS line_no FROM k JOIN e USING (domain, key)",
        "p1_clean": f"""
            WITH {lines},
            f AS (SELECT k.result_id, k.line_no, k.line, e.key IS NULL AS keep FROM k LEFT JOIN e USING (domain, key)),
            r AS (
                SELECT result_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (keep), '') AS md_content,
                    count(*) FILTER (NOT keep)::INT AS removed
                FROM f GROUP BY result_id
            )
            SELECT result_id, md_content, removed FROM r
            UNION ALL SELECT DISTINCT result_id, md_content, 0 FROM conversion_results WHERE md_content IS NULL""",
        "p2_found": r"""
            WITH t AS (SELECT DISTINCT result_id, string_split(md_content, chr(10)) AS lines FROM conversion_results WHERE md_content IS NOT NULL),
            l AS (SELECT result_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM t),
            f AS (SELECT *, regexp_matches(line, '^[\s\p{Z}\x0b\x1c-\x1f\x85]*$') AS blank FROM l),
            g AS (SELECT *, sum(blank::INT) OVER (PARTITION BY result_id ORDER BY pos) AS run FROM f),
            b AS (SELECT result_id, run, sum(length(line)) + count(*) - 1 AS n FROM g WHERE NOT blank GROUP BY result_id, run),
            o AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY run) AS block_no FROM b)
            SELECT result_id, block_no::INT AS block_no FROM o WHERE n > 1200""",
    }
