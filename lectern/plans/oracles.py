"""SQL twins of the registered queries, for DuckDB over the same tables."""

import re

from lectern import fixed_values as V
from lectern.plans import inputs as I


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, **columns: str) -> str:
    """SQL concatenation of a ``{name}`` template with column expressions."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = []
    for position, piece in enumerate(pieces):
        if position % 2:
            parts.append(f"({columns[piece]})::VARCHAR")
        elif piece:
            parts.append(quoted(piece))
    return "(" + " || ".join(parts) + ")"


def shown(value: str) -> str:
    return f"coalesce(({value})::VARCHAR, {quoted(V.UNANSWERED)})"


def payload(prompt: str, temperature: float) -> str:
    return (
        f"CASE WHEN {prompt} IS NOT NULL THEN to_json({{'model': {quoted(I.MODEL)}, "
        f"'messages': [{{'role': 'user', 'content': {prompt}}}], "
        f"'max_tokens': {V.MAX_TOKENS}, 'temperature': {temperature}}})::VARCHAR END"
    )


def stripped(text: str) -> str:
    return f"trim({text}, {quoted(V.WHITESPACE)})"


def letter(number: str) -> str:
    return f"substr('ABCD', ({number} % 4 + 1)::INT, 1)"


def activity_time(timestamp: str) -> str:
    return f"strftime({timestamp}, '%b %d, %I:%M %p')"


def chunk_id(document: str, page: str, chunk: str) -> str:
    return (
        f"substr(sha256({document} || '#' || {page} // 16 || '#' || {chunk} // 64), 1, 16)"
        f" || substr(sha256({document} || '#' || {page} || '#' || {chunk}), 1, 48)"
    )


ANSWER_ORDER = ", ".join(I.ANSWER_ORDER)
PREFIX = quoted(I.FILE_PREFIX)
BASE = quoted(I.BASE_DIR + "/")
LETTERS = "[" + ", ".join(quoted(x) for x in V.LETTERS) + "]"

def report_changes(graded: str) -> str:
    return f"""SELECT user_id, class_level, {quoted(V.REPORT_BAND)} AS proficiency,
               'Session ' || session_id || ': ' || count(*) || ' quizzes' AS strong_points,
               strong_points AS weak_points, max(created_at) AS changed_at, 1 AS change_rank,
               session_id AS change_id
        FROM {graded} GROUP BY user_id, session_id, class_level"""


def latest_memory(changes: str) -> str:
    return f"""SELECT * EXCLUDE (change_rank, change_id) FROM {changes}
        QUALIFY row_number() OVER (PARTITION BY user_id
                    ORDER BY changed_at DESC, change_rank DESC, change_id DESC) = 1"""


# Shared sub-queries; each names the ones it needs.
PARTS = {
    "page": ([], f"""
        SELECT doc_id, lang, n_chars, {stripped("replace(text, chr(10), ' ')")} AS t,
               {PREFIX} || lpad((doc_id % 13 + 1)::VARCHAR, 2, '0') || '.pdf' AS file_name,
               ((doc_id // 13) % 5 + 1)::INT AS page_number
        FROM documents"""),
    "chunk": (["page"], f"""
        SELECT {chunk_id("doc_id", "page_number", "o")} AS chunk_id,
               {V.CLASS_LEVEL}::INT AS class_level, lang AS language,
               replace(file_name, '.pdf', '') AS chapter, page_number,
               substring(t, (o * 800 + 1)::INT, 1000) AS text_content, doc_id
        FROM (SELECT *, unnest(range(0, ceil(length(t) / 800.0)::BIGINT)) AS o
              FROM page WHERE length(t) > 0)"""),
    "vector": ([], f"""
        SELECT {chunk_id("vec_id", "((vec_id // 13) % 5 + 1)", "0")} AS chunk_id,
               embedding::DOUBLE[] AS v
        FROM embeddings"""),
    "question": ([], """
        SELECT vec_id AS question_id,
               'What is topic ' || label || ' in item ' || vec_id AS question
        FROM embeddings
        UNION ALL SELECT item_id + 100000000, text FROM benchmark"""),
    "hit": (["vector"], f"""
        SELECT question_id, rank::INT AS rank, chunk_id, d * d AS distance
        FROM (SELECT question_id, chunk_id, d,
                     row_number() OVER (PARTITION BY question_id ORDER BY d, chunk_id) AS rank
              FROM (SELECT q.vec_id AS question_id, chunk_id,
                           list_distance(q.embedding::DOUBLE[], v) AS d
                    FROM embeddings q CROSS JOIN vector))
        WHERE rank <= {V.ANSWER_TOP_K}"""),
    "found": (["chunk", "hit"], "SELECT *, right(chapter, 2) AS nn FROM hit JOIN chunk USING (chunk_id)"),
    "context": (["found"], f"""
        SELECT question_id, count(*) AS n_chunks, string_agg({filled(
            V.CONTEXT_BLOCK, class_level=shown("class_level"), chapter_no=shown("nn"),
            page_number=shown("page_number"), text_content=shown("text_content"),
        )}, {quoted(V.BLOCK_SEPARATOR)} ORDER BY rank) AS context
        FROM found GROUP BY question_id"""),
    "asked": (["question", "context"], f"""
        SELECT question_id, question, coalesce(context, {quoted(V.NO_CONTEXT)}) AS context,
               coalesce(n_chunks, 0) AS n_chunks, context IS NOT NULL AS found
        FROM question LEFT JOIN context USING (question_id)"""),
    "message": ([], """
        SELECT 'c' || conv_id AS session_id, 'u' || (conv_id % 20) AS user_id, turn, role,
               text AS content,
               TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS timestamp
        FROM conversations"""),
    "chat": (["message"], """
        SELECT session_id, user_id, turn, content AS prompt, raw_response, timestamp,
               sha256(session_id || '#' || turn) AS log_id
        FROM (SELECT *, lead(role) OVER w AS next_role, lead(content) OVER w AS raw_response
              FROM message WINDOW w AS (PARTITION BY session_id ORDER BY turn))
        WHERE role = 'user' AND next_role = 'assistant'"""),
    "session": (["message", "chat"], f"""
        SELECT session_id, user_id,
               coalesce(renamed, CASE WHEN length(content) > {V.TITLE_CHARS}
                   THEN left(content, {V.TITLE_CHARS}) || {quoted(V.ELLIPSIS)}
                   ELSE content END) AS title,
               timestamp AS created_at,
               greatest(timestamp, coalesce(last, timestamp)) AS updated_at
        FROM (SELECT * FROM message WHERE role = 'user'
              QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn) = 1)
        LEFT JOIN (SELECT session_id, max(timestamp) AS last FROM chat GROUP BY 1)
             USING (session_id)
        LEFT JOIN (SELECT session_id, CASE WHEN length(content) > {V.TITLE_CHARS}
                       THEN left(content, {V.TITLE_CHARS}) || {quoted(V.ELLIPSIS)}
                       ELSE content END AS renamed FROM message
                   WHERE role = 'system'
                   QUALIFY row_number() OVER (
                       PARTITION BY session_id ORDER BY timestamp DESC, renamed DESC) = 1)
             USING (session_id)"""),
    "topic": (["message"], f"""
        SELECT session_id, count(*)::INT AS n_messages,
               string_agg(content, {quoted(V.TOPIC_SEPARATOR)} ORDER BY turn) AS topics
        FROM (SELECT * FROM message WHERE role = 'user' QUALIFY row_number() OVER (
                  PARTITION BY session_id ORDER BY turn DESC) <= {V.TOPIC_MESSAGES})
        GROUP BY session_id"""),
    "topic_request": (["topic"], f"""
        SELECT session_id, prompt, {payload("prompt", V.QUIZ_TEMPERATURE)} AS payload
        FROM (SELECT session_id, {filled(V.QUIZ_PROMPT, topics="topics")} AS prompt
              FROM topic)"""),
    "library": ([], f"""
        SELECT {PREFIX} || '-' || (doc_id // 50) || '.txt' AS file_name,
               sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS length,
               md5(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS digest
        FROM documents GROUP BY 1"""),
    "answer": ([], f"""
        SELECT *, starts_with(given, answer_key) AS is_right
        FROM (SELECT *, coalesce(choice, {quoted(V.UNANSWERED)}) AS given
              FROM (SELECT l_orderkey AS attempt_id,
                           row_number() OVER (PARTITION BY l_orderkey ORDER BY {ANSWER_ORDER})
                               AS question_no,
                           'Part ' || l_partkey || ' "line" ' || l_linenumber AS question,
                           CASE WHEN l_quantity >= 3 THEN {letter("l_suppkey")} || '. '
                                || l_returnflag || l_linestatus END AS choice,
                           {letter("l_partkey")} AS answer_key,
                           l_returnflag || l_linestatus AS state
                    FROM lineitem))"""),
    "grade": (["answer"], f"""
        SELECT attempt_id, score, total, total - score AS wrong,
               CASE WHEN score >= {V.HIGH_SCORE} THEN 'High'
                    WHEN score >= {V.MEDIUM_SCORE} THEN 'Medium' ELSE 'Low' END AS proficiency
        FROM (SELECT attempt_id, count(*) FILTER (is_right)::INT AS score,
                     count(*)::INT AS total
              FROM answer GROUP BY attempt_id)"""),
    "head": ([], """
        SELECT o_orderkey AS attempt_id, o_custkey::VARCHAR AS user_id,
               o_custkey || '-' || year(o_orderdate) AS session_id, o_orderdate AS created_at,
               (o_custkey % 3 + 8)::INT AS class_level
        FROM orders"""),
    "graded": (["head", "grade"], """
        SELECT *, 'Attempt ' || attempt_id || ': ' || score || '/' || total || ', '
                  || proficiency AS analysis
        FROM head JOIN grade USING (attempt_id)"""),
    "breakdown": (["answer"], f"""
        SELECT attempt_id, count(*) FILTER (is_right)::INT AS score, count(*)::INT AS total,
               count(*) FILTER (NOT is_right)::INT AS wrong,
               string_agg({filled(
                   V.BREAKDOWN_LINE, question_no="question_no",
                   tag=f"CASE WHEN is_right THEN {quoted(V.CORRECT_TAG)} ELSE {quoted(V.WRONG_TAG)} END",
                   question="question", choice="given", answer_key="answer_key",
               )}, {quoted(V.BLOCK_SEPARATOR)} ORDER BY question_no) AS breakdown
        FROM answer GROUP BY attempt_id"""),
    "grade_change": (["graded"], """
        SELECT user_id, class_level, proficiency, analysis AS strong_points,
               analysis AS weak_points, created_at AS changed_at,
               0 AS change_rank, attempt_id::VARCHAR AS change_id
        FROM graded"""),
    "report_change": (["graded"], report_changes("graded")),
    "memory": (["grade_change", "report_change"], latest_memory(
        "(SELECT * FROM grade_change UNION ALL SELECT * FROM report_change)")),
    "evaluation": (["breakdown"], f"""SELECT attempt_id, prompt, {payload("prompt", V.EVALUATION_TEMPERATURE)} AS payload
        FROM (SELECT attempt_id, CASE WHEN wrong = 0
                  THEN {filled(V.PERFECT_SCORE_PROMPT, score="score", total="total",
                               breakdown="breakdown")}
                  ELSE {filled(V.EVALUATION_PROMPT, score="score", total="total",
                               breakdown="breakdown")} END AS prompt
              FROM breakdown)"""),
    "report": (["graded"], f"""SELECT session_id, n_quizzes, prompt,
               CASE WHEN n_quizzes = 0 THEN {quoted(V.NO_QUIZZES)} END AS reply,
               {payload("prompt", V.REPORT_TEMPERATURE)} AS payload
        FROM (SELECT session_id, coalesce(n, 0) AS n_quizzes,
                     {filled(V.REPORT_PROMPT, evaluations="evaluations")} AS prompt
              FROM (SELECT DISTINCT session_id FROM head) LEFT JOIN (
                  SELECT session_id, count(*) AS n, string_agg({filled(
                      V.QUIZ_OUTPUT, quiz_no="i", analysis=shown("analysis"),
                  )}, {quoted(V.BLOCK_SEPARATOR)} ORDER BY i) AS evaluations
                  FROM (SELECT *, row_number() OVER (PARTITION BY session_id
                            ORDER BY created_at, attempt_id::VARCHAR) AS i FROM graded)
                  GROUP BY session_id) USING (session_id))"""),
    "reply": ([], f"""
        SELECT p_partkey AS part_id,
               CASE WHEN p_partkey % 11 = 0 THEN 'No quiz today.'
                    WHEN p_partkey % 13 = 0 THEN 'Sure! ' || replace(quiz, '"answer":', '"answer"')
                    ELSE 'Sure! ' || quiz || ' done' END AS reply
        FROM (SELECT p_partkey, to_json([{{
                  'question': 'Which ' || p_name || '?',
                  'options': ['A. ' || p_brand, 'B) ' || p_type, 'C. ' || p_size, 'D. other'],
                  'answer': {letter("p_partkey")}}}])::VARCHAR AS quiz
              FROM part)"""),
    "quiz": (["reply"], r"""
        SELECT part_id, (i + 1)::INT AS question_no,
               json_extract_string(j, '$.question') AS question,
               json_extract_string(j, '$.options[*]') AS options,
               json_extract_string(j, '$.answer') AS answer
        FROM (SELECT part_id, i, json_extract(js, '$[' || i || ']') AS j
              FROM (SELECT part_id, js,
                           unnest(range(0, json_array_length(js)::BIGINT)) AS i
                    FROM (SELECT part_id, regexp_extract(reply, '\[.*\]', 0, 's') AS js
                          FROM reply)
                    WHERE json_valid(js)))"""),
    "envelope": ([], """
        SELECT doc_id,
               to_json({'choices': [{'message': {
                   'content': CASE WHEN doc_id % 3 = 0 OR doc_id % 7 = 0 THEN ''
                                   WHEN doc_id % 11 = 0 THEN ' short reply '
                                   WHEN doc_id % 5 = 0
                                   THEN '```json' || chr(10) || '{}' || chr(10) || '``` ' || text
                                   ELSE text END,
                   'reasoning_content': CASE WHEN doc_id % 7 = 0 THEN ''
                                             ELSE 'Because ' || text END}}]}) AS e
        FROM documents"""),
    "reply_text": (["envelope"], """
        SELECT doc_id, json_extract_string(e, '$.choices[0].message.content') AS c,
               json_extract_string(e, '$.choices[0].message.reasoning_content') AS r
        FROM envelope"""),
}


def with_parts(select: str, *names: str) -> str:
    """``WITH`` the named sub-queries and all they need, in order of definition."""
    needed, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += PARTS[name][0]
    ctes = [f"{name} AS ({PARTS[name][1]})" for name in PARTS if name in needed]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + select


STRIP_PREFIX = r"'^[A-Z][.)]\s*', ''"


def relabelled(source: str, key: str) -> str:
    """Re-lettered quiz rows of ``source (key, question_no, question, options[], answer)``."""
    raw = f"regexp_replace(o, {STRIP_PREFIX})"
    return f"""SELECT {key}, question_no, question,
               array_to_string(CASE WHEN fits THEN list_transform(mixed, lambda x, i:
                   {LETTERS}[(i - 1) % 6 + 1] || '. ' || x) ELSE options END, ' | ') AS options,
               CASE WHEN fits THEN list_filter(list_transform(mixed, lambda x, i:
                   CASE WHEN x = regexp_replace(correct, {STRIP_PREFIX})
                        THEN {LETTERS}[(i - 1) % 6 + 1] END),
                   lambda x: x IS NOT NULL)[-1] ELSE answer END AS answer
        FROM (SELECT *, len(options) >= 2 AND key <> '' AND correct IS NOT NULL AS fits
              FROM (SELECT *, list_filter(options, lambda o: starts_with(o, key))[1] AS correct,
                           list_transform(list_sort(list_transform(options, lambda o:
                               md5(question || {raw}) || {raw})),
                               lambda x: substr(x, 33)) AS mixed
                    FROM (SELECT *, {stripped("answer")} AS key FROM {source})))"""


def letter_counts(text: str) -> str:
    return f"""list_transform(string_split('a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r,s,t,u,v,w,x,y,z', ','),
        lambda x: length({text}) - length(replace({text}, x, '')))"""


# The stand-in model of the whole jobs: its reply text by request length ``n``; it fails when
# the length is a multiple of five.
STUB_REPLY = """('The request has ' || n || ' characters: [{"question": "Length?", "options": ["A. '
    || n || '", "B) ' || (n + 1) || '", "C. 0"], "answer": "A"}]')"""


ORACLES = {
    "chunk_documents": with_parts("SELECT * EXCLUDE (doc_id) FROM chunk", "chunk"),
    "chunk_stats": with_parts(
        """SELECT chapter, count(DISTINCT doc_id) AS pages, count(*) AS chunks
        FROM chunk GROUP BY chapter""", "chunk",
    ),
    "chapter_page_keys": with_parts(
        f"""SELECT doc_id AS document_key, chapter, right(chapter, 2) AS chapter_no, page_number,
               {PREFIX} || right(chapter, 2) || '.pdf' AS pdf_filename,
               {BASE} || {PREFIX} || right(chapter, 2) || '.pdf' AS pdf_path,
               greatest(0, least(n_chars % 9 - 2, file_pages - 1))::INT AS page_index
        FROM (SELECT *, replace(file_name, '.pdf', '') AS chapter,
                     max(page_number) OVER (PARTITION BY file_name) AS file_pages FROM page)""",
        "page",
    ),
    "append_new_chunks": with_parts(
        """SELECT * EXCLUDE (doc_id), doc_id NOT IN (SELECT doc_id FROM labels) AS is_new
        FROM chunk""", "chunk",
    ),
    "binary_listing": with_parts("SELECT file_name, length FROM library", "library"),
    "requested_documents": with_parts(
        f"""SELECT request_id, file_name, length IS NOT NULL AS loaded, length, digest
        FROM (SELECT 'label ' || doc_id AS request_id,
                     {PREFIX} || '-' || (doc_id // 50) || '.txt' AS file_name FROM labels
              UNION ALL SELECT 'item ' || item_id, 'gone-' || item_id || '.txt' FROM benchmark)
        LEFT JOIN library USING (file_name)""", "library",
    ),
    "extract_pages": """
        SELECT 'doc' || doc_id || '.txt' AS file_name, (i + 1)::INT AS page_number,
               pages[i + 1] AS text
        FROM (SELECT doc_id, pages, unnest(range(0, len(pages))) AS i
              FROM (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents))""",
    "embed_texts": with_parts(
        f"""SELECT chunk_id, array_to_string({letter_counts("text_content")}, ',') AS embedding
        FROM chunk""", "chunk",
    ),
    "knn_topk": with_parts("SELECT * REPLACE (round(distance, 6) AS distance) FROM hit", "hit"),
    "retrieve_chunks": with_parts(
        """SELECT question_id, rank, round(distance, 6) AS distance, chunk_id, class_level,
               language, chapter, page_number, text_content FROM found""", "found",
    ),
    "retrieve_stored": with_parts(
        """SELECT question_id, rank, round(distance, 6) AS distance, chunk_id, class_level,
               language, chapter, page_number, text_content FROM found""", "found",
    ),
    "retrieve_context": with_parts("SELECT * FROM context", "context"),
    "retrieve_sources": with_parts(
        f"""SELECT question_id,
               (row_number() OVER (PARTITION BY question_id ORDER BY rank))::INT AS source_no,
               class_level, nn AS chapter, page_number,
               {BASE} || {PREFIX} || nn || '.pdf' AS pdf_path,
               {PREFIX} || nn || '.pdf' AS pdf_filename,
               {filled(V.SOURCE_LABEL, class_level="class_level", chapter_no="nn",
                       page_number="page_number")} AS label
        FROM (SELECT * FROM found QUALIFY row_number() OVER (
                  PARTITION BY question_id, nn, page_number ORDER BY rank) = 1)""", "found",
    ),
    "retrieve_with_default": with_parts("SELECT * FROM asked", "asked"),
    "answer_prompts": with_parts(
        f"""SELECT question_id, prompt, reply, {payload("prompt", V.ANSWER_TEMPERATURE)} AS payload
        FROM (SELECT question_id,
                     CASE WHEN found THEN {filled(V.ANSWER_PROMPT, context="context",
                                                  question="question")} END AS prompt,
                     CASE WHEN NOT found THEN {filled(
                         V.NO_CONTEXT_REPLY, class_level=str(V.CLASS_LEVEL),
                         syllabus=quoted(I.SYLLABUS))} END AS reply
              FROM asked)""", "asked",
    ),
    "chat_pairs": with_parts("SELECT session_id, user_id, turn, prompt, raw_response, timestamp FROM chat", "chat"),
    "session_messages": with_parts(
        """SELECT session_id, (n - 1) * 2 + 1 AS message_no, 'user' AS role, prompt AS content
        FROM numbered UNION ALL
        SELECT session_id, (n - 1) * 2 + 2, 'assistant', raw_response FROM numbered""".replace(
            "numbered",
            """(SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, turn)
                AS n FROM chat)""",
        ), "chat",
    ),
    "session_state": with_parts("SELECT * FROM session", "session"),
    "session_titles": with_parts(
        f"""SELECT session_id, coalesce(nullif(title, ''), {quoted(V.NEW_CHAT)}) AS title,
               left(coalesce(nullif(title, ''), {quoted(V.UNTITLED)}), {V.DISPLAY_TITLE_CHARS})
                   AS display_title
        FROM (SELECT DISTINCT session_id FROM message) LEFT JOIN session USING (session_id)""",
        "message", "session",
    ),
    "sessions_by_recency": with_parts(
        f"""SELECT *, row_number() OVER (
                   PARTITION BY user_id ORDER BY updated_at DESC, session_id) AS recency_rank,
               {activity_time("updated_at")} AS last_active
        FROM session""", "session",
    ),
    "recent_topics": with_parts("SELECT * FROM topic", "topic"),
    "quiz_prompts": with_parts("SELECT * FROM topic_request", "topic_request"),
    "format_activity_time": f"""
        SELECT event_id, CASE WHEN event_type = 'error' THEN left(props, {V.RAW_TIME_CHARS})
                              ELSE {activity_time("ts")} END AS shown FROM events""",
    "chat_log_fanout": with_parts(
        f"""SELECT 'raw_chat_history' AS table_name, session_id AS row_key,
               user_id || '|' || prompt || '|' || raw_response AS row_value, timestamp FROM chat
        UNION ALL SELECT 'business_dashboard', log_id,
               {filled(V.METRIC_NAME, user_id="user_id")} || '|{V.METRIC_VALUE}', timestamp
        FROM chat
        UNION ALL SELECT 'chat_sessions', session_id, '', max(timestamp)
        FROM chat GROUP BY session_id""", "chat",
    ),
    "dashboard_totals": with_parts(
        """SELECT 'total_queries' AS metric, count(*) AS value FROM events
        UNION ALL SELECT 'unique_students', count(DISTINCT user_id) FROM memory""", "memory",
    ),
    "queries_by_metric": f"""
        SELECT {filled(V.METRIC_NAME, user_id="user_id")} AS metric_name, count(*) AS queries
        FROM events GROUP BY 1""",
    "students_by_day": """
        SELECT ts::DATE::VARCHAR AS day, count(DISTINCT user_id) AS students, true AS estimate_is_close
        FROM events GROUP BY 1""",
    "quiz_extract": with_parts(
        "SELECT * REPLACE (array_to_string(options, ' | ') AS options) FROM quiz", "quiz"
    ),
    "quiz_relabel": with_parts(relabelled("quiz", "part_id"), "quiz"),
    "grade_quiz": with_parts("SELECT * FROM grade", "grade"),
    "grade_submitted": with_parts(
        f"""SELECT attempt_id, score, total, total - score AS wrong,
               CASE WHEN score >= {V.HIGH_SCORE} THEN 'High'
                    WHEN score >= {V.MEDIUM_SCORE} THEN 'Medium' ELSE 'Low' END AS proficiency
        FROM (SELECT attempt_id, count(*)::INT AS total,
                     count(*) FILTER (starts_with(
                         CASE WHEN attempt_id % 3 = 0 AND question_no = questions
                              THEN {quoted(V.UNANSWERED)} ELSE given END, answer_key))::INT AS score
              FROM (SELECT *, count(*) OVER (PARTITION BY attempt_id) AS questions FROM answer)
              GROUP BY attempt_id)""", "answer",
    ),
    "quiz_breakdown": with_parts("SELECT * FROM breakdown", "breakdown"),
    "evaluation_prompts": with_parts("SELECT * FROM evaluation", "evaluation"),
    "quiz_history_rows": with_parts(
        """SELECT sha256(attempt_id::VARCHAR) AS quiz_id, session_id, user_id, questions,
               user_answers, correct_answers, score, total, analysis AS strong_point,
               analysis AS weak_point, created_at
        FROM graded JOIN (
            SELECT attempt_id,
                   '[' || string_agg(to_json({'question': question,
                       'options': ['A. ' || state, 'B. ' || state, 'C. ' || state, 'D. ' || state],
                       'answer': answer_key})::VARCHAR, ',' ORDER BY question_no) || ']' AS questions,
                   '[' || string_agg(coalesce(to_json(choice)::VARCHAR, 'null'), ','
                       ORDER BY question_no) || ']' AS user_answers,
                   '[' || string_agg(to_json(answer_key)::VARCHAR, ',' ORDER BY question_no)
                       || ']' AS correct_answers
            FROM answer GROUP BY attempt_id) USING (attempt_id)""", "graded",
    ),
    "session_quizzes": with_parts(
        f"""SELECT session_id, attempt_id::VARCHAR AS quiz_id, score, total, analysis, created_at,
               row_number() OVER (PARTITION BY session_id
                   ORDER BY created_at DESC, attempt_id::VARCHAR) AS attempt_rank,
               score || '/' || total AS score_label, {activity_time("created_at")} AS taken
        FROM graded""", "graded",
    ),
    "user_memory_current": with_parts("SELECT * FROM memory", "memory"),
    "memory_replaced": with_parts(
        f"""SELECT * EXCLUDE (changed_at) FROM ({latest_memory("grade_change")})
        WHERE user_id NOT IN (SELECT user_id FROM graded WHERE wrong = 0)
        UNION ALL SELECT * EXCLUDE (changed_at) FROM ({latest_memory(
            "(" + report_changes("(SELECT * FROM graded WHERE wrong = 0)") + ")")})""",
        "grade_change",
    ),
    "session_report_input": with_parts("SELECT * FROM report", "report"),
    "clean_completions": with_parts(
        f"""SELECT doc_id,
               {stripped(f"coalesce(nullif(c, ''), nullif(r, ''), {quoted(V.EMPTY_RESPONSE)})")}
                   AS answer,
               {stripped("regexp_replace(" + stripped("coalesce(nullif(c, ''), nullif(r, ''), '')")
                         + ", '```.*?```', '', 'gs')")} AS report,
               CASE WHEN length(a) > {V.MIN_ANALYSIS_CHARS} THEN a
                    ELSE {quoted(V.DEFAULT_ANALYSIS)} END AS analysis
        FROM (SELECT *, {stripped("regexp_replace(coalesce(nullif(" + stripped("c")
              + ", ''), nullif(" + stripped("r") + ", '')), '```.*?```', '', 'gs')")} AS a
              FROM reply_text)""", "reply_text",
    ),
    "complete_prompts": with_parts(
        """SELECT session_id,
               CASE WHEN length(payload) % 5 = 0 THEN '[]'
                    ELSE length(payload) || ' characters' END AS response,
               CASE WHEN length(payload) % 5 = 0 THEN 'ValueError: no answer' END AS error
        FROM topic_request""", "topic_request",
    ),
    "answer_questions": with_parts(
        f"""SELECT question_id, CASE WHEN n % 5 <> 0 THEN {STUB_REPLY} END AS answer,
               CASE WHEN n % 5 <> 0 THEN n_sources ELSE 0 END::INT AS n_sources,
               CASE WHEN n % 5 <> 0 THEN first_source END AS first_source,
               CASE WHEN n % 5 = 0 THEN 'ValueError: no answer' END AS error
        FROM (SELECT question_id, length({payload("prompt", V.ANSWER_TEMPERATURE)}) AS n,
                     n_sources, first_source
              FROM (SELECT question_id, count(DISTINCT (nn, page_number)) AS n_sources,
                           arg_min(label, rank) AS first_source,
                           {filled(V.ANSWER_PROMPT, question="any_value(question)", context=
                                   f"string_agg(block, {quoted(V.BLOCK_SEPARATOR)} ORDER BY rank)")}
                               AS prompt
                    FROM (SELECT *, {filled(
                              V.CONTEXT_BLOCK, class_level="class_level", chapter_no="nn",
                              page_number="page_number", text_content="text_content")} AS block,
                              {filled(V.SOURCE_LABEL, class_level="class_level",
                                      chapter_no="nn", page_number="page_number")} AS label
                          FROM (SELECT *, right(chapter, 2) AS nn,
                                       row_number() OVER (PARTITION BY question_id
                                           ORDER BY d, chunk_id) AS rank
                                FROM (SELECT q.item_id AS question_id, q.text AS question, c.*,
                                             list_distance(c.v, q.v) AS d
                                      FROM (SELECT *, {letter_counts("text_content")}::DOUBLE[]
                                                AS v FROM chunk) c
                                      CROSS JOIN (SELECT *, {letter_counts("text")}::DOUBLE[]
                                                AS v FROM benchmark) q))
                          WHERE rank <= {V.ANSWER_TOP_K})
                    GROUP BY question_id))""", "chunk",
    ),
    "generate_quizzes": with_parts(
        relabelled(
            """(SELECT session_id, 1::INT AS question_no, 'Length?' AS question,
                       ['A. ' || n, 'B) ' || (n + 1), 'C. 0'] AS options, 'A' AS answer
                FROM (SELECT session_id, length(payload) AS n FROM topic_request)
                WHERE n % 5 <> 0)""", "session_id",
        ), "topic_request",
    ),
    "evaluate_attempts": with_parts(
        f"""SELECT attempt_id, user_id, score, total, proficiency,
               CASE WHEN n % 5 = 0 THEN {quoted(V.DEFAULT_ANALYSIS)} ELSE {STUB_REPLY} END
                   AS analysis
        FROM graded JOIN (SELECT attempt_id, length(payload) AS n FROM evaluation)
             USING (attempt_id)""", "graded", "evaluation",
    ),
    "report_sessions": with_parts(
        f"""SELECT session_id, n_quizzes,
               CASE WHEN n_quizzes = 0 THEN reply
                    WHEN n % 5 = 0 THEN {quoted(V.REPORT_FAILED)} ELSE {STUB_REPLY} END AS report
        FROM (SELECT *, length(payload) AS n FROM report)""", "report",
    ),
    "stream_chat_log": with_parts(
        f"""SELECT log_id, {filled(V.METRIC_NAME, user_id="user_id")} AS metric_name,
               {quoted(V.METRIC_VALUE)} AS metric_value, timestamp FROM chat""", "chat",
    ),
    "stream_history": with_parts(
        "SELECT session_id, user_id, prompt, raw_response, timestamp FROM chat", "chat"
    ),
    "stream_sessions": with_parts(
        "SELECT session_id, max(timestamp) AS updated_at FROM chat GROUP BY session_id", "chat"
    ),
    "stream_students": with_parts(
        "SELECT count(DISTINCT user_id) AS students, true AS estimate_is_close FROM graded", "graded"
    ),
    "stream_dashboard": with_parts(
        """SELECT 'total_queries' AS metric, count(*) AS value FROM events
        UNION ALL SELECT 'unique_students', count(DISTINCT user_id) FROM memory""", "memory",
    ),
}
