from oracle import decision_sql  # noqa: F401
from oracle.kit import CTES, SQL, r

W = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
CTES["c_lex"] = f"""
SELECT question_id, company_id, row_number() OVER (PARTITION BY question_id ORDER BY found DESC, chunk_id) AS rank_no, chunk_id, {r('found / greatest(n_words, 1)', 6)} AS score FROM (
SELECT q.question_id, q.company_id, c.chunk_id, len(q.w) AS n_words, len(list_intersect(q.w, c.w)) AS found FROM (SELECT *, {W.format('question')} AS w FROM c_questions) q JOIN (SELECT *, {W.format('chunk_text')} AS w FROM c_chunks) c ON q.company_id = c.company_id) x
WHERE found > 0 QUALIFY rank_no <= 5"""
CTES["c_lexfull"] = """
SELECT * FROM c_lex UNION ALL SELECT question_id, q.company_id, k, chunk_id, 0 FROM c_questions q JOIN (SELECT company_id, chunk_id, row_number() OVER (PARTITION BY company_id ORDER BY chunk_id) AS k FROM c_chunks WHERE chunk_text <> '') c ON q.company_id = c.company_id
WHERE k <= 5 AND question_id NOT IN (SELECT question_id FROM c_lex)"""
CTES["c_latest"] = "SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY finding_date DESC, seq DESC) AS rank_no FROM c_findings QUALIFY rank_no <= 5"
CTES["c_context"] = """
SELECT q.question_id, q.company_id, question, trim(concat_ws(chr(10) || chr(10), CASE WHEN k.t IS NOT NULL THEN concat('Retrieved document context:', chr(10), k.t) END, CASE WHEN narrative IS NOT NULL THEN concat('Latest CAM narrative:', chr(10), narrative) END,
  CASE WHEN final_score IS NOT NULL THEN concat('Latest risk snapshot:', chr(10), '- Final risk score: ', format('{:.1f}', final_score), chr(10), '- Risk category: ', risk_category, chr(10), '- Decision: ', decision) END,
  CASE WHEN f.t IS NOT NULL THEN concat('Recent research findings:', chr(10), f.t) END)) AS context
FROM c_questions q LEFT JOIN (SELECT question_id, string_agg(concat('[', doc_type, '] ', chunk_text), chr(10) ORDER BY rank_no) AS t FROM c_lexfull l JOIN c_chunks c ON l.chunk_id = c.chunk_id GROUP BY 1) k ON q.question_id = k.question_id
LEFT JOIN c_narrative n ON q.company_id = n.company_id LEFT JOIN c_blended b ON q.company_id = b.company_id
LEFT JOIN (SELECT company_id, string_agg(concat('- [', severity, '] ', finding_type, ': ', summary), chr(10) ORDER BY rank_no) AS t FROM c_latest GROUP BY 1) f ON q.company_id = f.company_id"""
_DOT = "list_inner_product({0}, {1})"
SQL.update({
    "top_1_vector_topk": f"""SELECT company_id::BIGINT AS query_id, company_id, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, chunk_id) AS rank_no, chunk_id, score FROM (
SELECT v.company_id, chunk_id, {r("list_inner_product(v.e, m.m) / (sqrt(list_inner_product(v.e, v.e)) * sqrt(list_inner_product(m.m, m.m)))", 6)} AS score
FROM (SELECT chunk_id, company_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM c_vectors) v JOIN (SELECT company_id, list(a ORDER BY i) AS m FROM (SELECT company_id, i, avg(x) AS a FROM (
  SELECT company_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM c_vectors) z GROUP BY 1, 2) y GROUP BY 1) m ON v.company_id = m.company_id) s QUALIFY rank_no <= 5""",
    "top_2_lexical_topk": "SELECT * FROM c_lex",
    "top_3_lexical_fallback": "SELECT * FROM c_lexfull",
    "top_4_picked_lines": """SELECT question_id, unnest(range(len(p)))::BIGINT AS pos, unnest(p) AS line FROM (SELECT question_id, (CASE WHEN len(m) > 0 THEN m ELSE l END) AS p FROM (
SELECT question_id, l, list_filter(l, lambda s: len(list_filter(k, lambda w: contains(lower(s), w))) > 0) AS m FROM (SELECT question_id, list_filter(list_transform(string_split(context, chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS l,
  list_transform(list_filter(string_split_regex(question, '\\s+'), lambda w: length(w) > 3), lambda w: lower(w)) AS k FROM c_context) a) b) c""",
    "mem_4_contexts": "SELECT * FROM c_context",
})
