"""DuckDB SQL of those pN_ queries that SQL can express, over the whole tables, by the plain definition of the cases."""

# Not in the consistent form, by its definition: wide and half-width forms, radicals, other spaces, other dots, the micro
# sign, Cyrillic letters, Greek letters that look Latin, invisible and control characters; or not composed.
_APART = (
    r"[\x{FF01}-\x{FFEE}\x{2F00}-\x{2FD5}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{119E}\x{2027}\x{2219}\x{22C5}\x{30FB}\x{318D}\x{B5}\p{Cyrillic}ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοϲϳ"
    r"\p{Cf}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{3164}\x{FE00}-\x{FE0F}\x{1}-\x{8}\x{E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}]"
)


def _not_consistent(column: str) -> str:
    return f"(nfc_normalize({column}) <> {column} OR regexp_matches({column}, '{_APART}'))"


_FIELDS = """
    f AS (SELECT DISTINCT 'question_bank_candidate' AS table_name, id AS record_id, stem AS x FROM question_bank_candidate WHERE length(stem) >= 200
          UNION SELECT 'question_bank_candidate', id, explanation FROM question_bank_candidate WHERE length(explanation) >= 200
          UNION SELECT 'chunks', rag_input_id, content FROM chunks WHERE length(content) >= 200)"""
_FLAT = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"

_PAIRS = r"""
        t AS (SELECT DISTINCT id, lower(concat_ws(' ', stem, option_1, explanation)) AS x FROM question_bank_candidate),
        w AS (SELECT id, unnest(regexp_extract_all(x, '[\p{L}\p{N}_]+')) AS w FROM t),
        c AS (SELECT id, w, count(*) AS n FROM w GROUP BY ALL),
        s AS (SELECT id, sum(n) AS size, string_agg(w || ' ' || n, ' ' ORDER BY w) AS bag FROM c GROUP BY id HAVING sum(n) >= 40),
        k AS (SELECT c.* FROM c JOIN s USING (id)),
        p AS (SELECT a.id AS id_a, b.id AS id_b, sum(least(a.n, b.n)) AS shared FROM k a JOIN k b ON a.w = b.w AND a.id < b.id GROUP BY ALL),
        l AS (SELECT id_a, id_b FROM p JOIN s sa ON sa.id = id_a JOIN s sb ON sb.id = id_b WHERE shared >= 0.7 * (sa.size + sb.size - shared))"""
_SPANS = f"""{_FIELDS},
        w AS (SELECT table_name, record_id, md5(x) AS text, CAST(i AS INT) AS i, md5(substring(x, CAST(i AS INT), 200)) AS h FROM (SELECT *, unnest(range(1, length(x) - 198)) AS i FROM f)),
        s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT table_name || record_id) > 1),
        g AS (SELECT *, CASE WHEN i > 200 + lag(i) OVER (PARTITION BY table_name, record_id, text ORDER BY i) THEN 1 ELSE 0 END AS fresh FROM w WHERE h IN (SELECT h FROM s)),
        n AS (SELECT *, sum(fresh) OVER (PARTITION BY table_name, record_id, text ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM g),
        v AS (SELECT table_name, record_id, text, CAST(min(i) - 1 AS INT) AS start, CAST(max(i) + 199 AS INT) AS stop FROM n GROUP BY table_name, record_id, text, span),
        d AS (SELECT DISTINCT 'question_bank_candidate' AS table_name, id AS record_id, 'stem' AS field_name, stem AS x FROM question_bank_candidate
              UNION SELECT 'question_bank_candidate', id, 'explanation', explanation FROM question_bank_candidate UNION SELECT 'chunks', rag_input_id, 'content', content FROM chunks)"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_PAIRS} SELECT id_a, id_b FROM l",
    "p1_groups": f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT id_a AS a, id_b AS b FROM l UNION SELECT id_b, id_a FROM l),
        r AS (SELECT id, id AS reached FROM s UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached)
        SELECT s.id, min(s.id) OVER (PARTITION BY bag) AS class_id, (SELECT min(reached) FROM r WHERE r.id = s.id) AS group_id FROM s""",
    "p2_found": f"""
        SELECT DISTINCT 'chunks' AS table_name, rag_input_id AS record_id, 'content' AS field_name FROM chunks WHERE {_not_consistent('content')}
        UNION SELECT 'chunks', rag_input_id, 'mapped_detail' FROM chunks WHERE {_not_consistent('mapped_detail')}
        UNION SELECT 'exam_scope', id, 'detail' FROM exam_scope WHERE {_not_consistent('detail')}""",
    "p3_found": "SELECT DISTINCT id FROM source_chunk WHERE length(content) > 1400",
    "p7_found": f"""
        WITH {_FIELDS},
        w AS (SELECT table_name, record_id, md5(substring(x, CAST(i AS INT), 200)) AS h FROM (SELECT *, unnest(range(1, length(x) - 198)) AS i FROM f)),
        s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT table_name || record_id) > 1)
        SELECT DISTINCT table_name, record_id FROM w WHERE h IN (SELECT h FROM s)""",
    "p7_spans": f"WITH {_SPANS} SELECT d.table_name, d.record_id, field_name, start, stop, substring(x, start + 1, stop - start) AS passage FROM v JOIN d ON d.table_name = v.table_name AND d.record_id = v.record_id AND md5(x) = text",
    "p7_shares": f"""WITH {_SPANS}, c AS (SELECT d.table_name, d.record_id, sum(stop - start) AS covered FROM v JOIN d ON d.table_name = v.table_name AND d.record_id = v.record_id AND md5(x) = text GROUP BY ALL),
        t AS (SELECT table_name, record_id, sum(coalesce(length(x), 0)) AS characters FROM d GROUP BY ALL)
        SELECT t.table_name, t.record_id, CAST(characters AS BIGINT) AS characters, CAST(coalesce(covered, 0) AS BIGINT) AS covered, CASE WHEN characters > 0 THEN coalesce(covered, 0) / characters ELSE 0.0 END AS share FROM t LEFT JOIN c ON c.table_name = t.table_name AND c.record_id = t.record_id""",
    "p9_found": f"""
        WITH d AS (SELECT doc_id, {_FLAT.format('text')} AS x FROM documents), e AS (SELECT item_id, {_FLAT.format('item_text')} AS x FROM eval_items),
        a AS (SELECT DISTINCT doc_id, substring(x, CAST(i AS INT), 100) AS h FROM (SELECT *, unnest(range(1, length(x) - 98)) AS i FROM d WHERE length(x) >= 100)),
        b AS (SELECT DISTINCT item_id, substring(x, CAST(i AS INT), 100) AS h FROM (SELECT *, unnest(range(1, length(x) - 98)) AS i FROM e WHERE length(x) >= 100))
        SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (h)""",
}
